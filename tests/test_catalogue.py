"""Every query against its SQL on the smallest tables; queries without SQL give rows."""

import pytest

from meterline.plans import catalogue

from .compare import connect, rows_of
from .conftest import DATA


@pytest.fixture(scope="module")
def con():
    return connect(DATA)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, con, name):
    found = catalogue.QUERIES[name](spark, str(DATA)).toPandas()
    if name in catalogue.ORACLE:
        assert rows_of(found) == rows_of(con.execute(catalogue.ORACLE[name]).df())
    else:
        assert len(found)
    assert len(set(found.columns)) == len(found.columns)


def test_word_confidence_splits_a_text_once(spark, tmp_path):
    text = " ".join(["word"] * 20_000)
    spark.createDataFrame([(1, 0, "user", text), (1, 1, "user", "  "), (2, 0, "user", "a b  c")], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    found = catalogue.QUERIES["word_confidence"](spark, str(tmp_path))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
    assert sorted(map(tuple, found.collect())) == [(1, 0, 20_000, 0.5), (1, 1, 0, None), (2, 0, 3, 0.667)]
