import __spark_entry__


def test_flagship(spark):
    found = __spark_entry__.entry(spark)
    assert found.columns == ["user_id", "region_idx", "start_i", "end_i", "mean_value"] and found.count() > 0


def test_every_oracle_has_its_query():
    names = __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(names) and len(names) > 50
