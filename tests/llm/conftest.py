import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(texts, ids=None):
        ids = list(range(len(texts))) if ids is None else ids
        rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in zip(ids, texts, strict=True)]
        return spark.createDataFrame(rows, DOCS).repartition(3)

    return make


#: Texts that every operator must take: null, empty, blank, one word, odd characters, copies, and a very long one.
EDGE = [None, "", " \n\t ", "word", "Word", "é ñ ß 日本語 😀", "a b c d e f g h i j", "a b c d e f g h i j", "\x00 a\r\nb", "x" * 5000, " ".join(f"w{i % 977}" for i in range(60000)), "same line " * 40 + "\n" + "same line " * 40]


@pytest.fixture(scope="session")
def edge_docs(make_docs):
    """Edge texts, a null id, a repeated row, and extra columns whose names operators might use themselves."""
    docs = make_docs([*EDGE, "no id", EDGE[6]], [*range(len(EDGE)), None, 6])
    for name in ("row", "bucket", "digest_a", "n_words", "shard", "kept", "component_id", "_gone", "ids", "spans"):
        docs = docs.withColumn(name, F.lit(1))
    return docs


@pytest.fixture(scope="session")
def no_docs(make_docs, spark):
    return spark.createDataFrame([], DOCS)
