import re

import corpus_pipeline
import pytest

import __spark_entry__
from meterline.llm import decontaminate, near_dedup, registry, toxicity, workspace

from ..conftest import DATA
from .test_dedup import plain_components, plain_cut
from .test_filters import plain_hits


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_stages_against_plain_versions(spark):
    """Each stage on all that the one before it kept."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, total = docs.columns, docs.count()
    told = {name: stage for name, stage in corpus_pipeline.STAGES}
    assert list(told) == ["toxicity", "near_dedup", "substring_dedup", "decontamination", "bpe"]
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    chain = toxicity.fit_chain(docs, labels, toxicity.CATEGORIES)
    toxic = {r.doc_id for r in toxicity.score(docs, chain).where("toxic").collect()}
    kept = told["toxicity"](spark, docs, str(DATA)).cache()
    assert kept.columns == columns and set(ids(kept)) == set(ids(docs)) - toxic and len(toxic) < total / 2
    texts = {r.doc_id: r.text for r in kept.collect()}
    one = told["near_dedup"](spark, kept, str(DATA)).cache()
    assert one.columns == columns and ids(one) == sorted(i for i, (_, c) in plain_components(texts, 80).items() if c == i)
    cut = told["substring_dedup"](spark, one, str(DATA)).cache()
    assert cut.columns == columns and ids(cut) == ids(one)
    assert {r.doc_id: r.text for r in cut.collect()} == plain_cut({r.doc_id: r.text for r in one.collect()})
    assert all(r.n_chars == len(r.text) for r in cut.collect())
    items = [tuple(r) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").select("item_id", "text").collect()]
    clean = told["decontamination"](spark, cut, str(DATA)).cache()
    assert clean.columns == columns and ids(clean) == sorted(r.doc_id for r in cut.collect() if not plain_hits(r.text, [i for i in items if shares(r.text, i[1])])[2])
    last = told["bpe"](spark, clean, str(DATA))
    assert ids(last) == ids(clean) and last.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, corpus_pipeline.run(spark, str(DATA)).collect()))


def shares(text, item):
    """A quick look that spares the plain search most pairs: any word of five letters or more in common."""
    long = lambda t: set(re.findall("[a-z0-9\x80-\U0010ffff]{5,}", t.lower()))
    return bool(long(text) & long(item))


def test_all_are_registered():
    names = __spark_entry__.queries()
    assert set(registry.QUERIES) | {"pipeline"} <= set(names)
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 11))


def test_empty_tables(spark, no_docs):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, no_docs, str(DATA)).count() == 0, name


def tables_left(spark):
    top = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{workspace.shared_root(spark)}/meterline")
    store = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return {s.getPath().getName() for s in store.listStatus(top)} if store.exists(top) else set()


def test_a_run_leaves_no_tables(spark):
    before = tables_left(spark)
    with workspace.lifetime(spark):
        rows = corpus_pipeline.run(spark, str(DATA))
        assert len(tables_left(spark) - before) == 1  # what the rows are read from
        assert rows.count() > 0
        near_dedup.near_duplicates(spark.read.parquet(f"{DATA}/documents.parquet")).count()
    assert tables_left(spark) == before


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://somewhere:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context
        conf = {}

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        workspace.shared_root(Session)


def test_edge_rows(spark, edge_docs):
    docs = edge_docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(DATA))
        assert docs.columns == edge_docs.columns, name
        assert docs.where("doc_id is null").count() == 1, name


def test_operators_name_their_limits():
    assert (near_dedup.BANDS, decontaminate.WINDOW, toxicity.SAMPLE_ROWS) == (32, 8, 10_000)
