"""Five stages from raw documents to encoded text; each one works on all that the stage before it kept.

Every stage takes (spark, docs, sf_dir) with the columns of ``documents`` and gives them back; the last gives one row of token
figures per document. A stage's result is written to the shared folder and read again by the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from meterline.llm import bpe, decontaminate, near_dedup, substring_dedup, toxicity
from meterline.llm.workspace import Workspace, lifetime, settle, table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain finds toxic go."""
    settle(spark)
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays."""
    settle(spark)
    return near_dedup.keep_one(docs)


def substring_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has are cut out; every document stays."""
    settle(spark)
    return substring_dedup.without_repeats(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of any benchmark item go."""
    settle(spark)
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of what is left."""
    settle(spark)
    return bpe.digests(bpe.encode_decode(docs))


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_dedup", near_dedup_stage),
    ("substring_dedup", substring_dedup_stage),
    ("decontamination", decontamination_stage),
    ("bpe", encoding_stage),
]
#: SQL can't train the chain or merge tokens; the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage. A stage's intermediate tables go when its result is written, the result itself when the next one's is;
    the last one stays for whoever reads the rows (see ``workspace.lifetime``)."""
    docs, ws, last = table(spark, sf_dir, "documents"), Workspace(spark, "pipeline"), None
    for name, stage in STAGES:
        with lifetime(spark):
            docs = ws.write(stage(spark, docs, sf_dir), name)
        if last:
            ws.drop(last)
        last = name
    return docs
