"""Shared storage for intermediate tables, and small helpers every operator uses.

Operators return lazy DataFrames over tables that they have written, so those tables must outlive the call. Whoever asked for
the result ends them: ``with lifetime(spark): ...`` removes on leaving whatever was written inside, ``clear(spark)`` all that
this application has written. The pipeline does so after each stage.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join may be broadcast only when it was counted and holds at most this many rows of a few bytes each.
BROADCAST_ROWS = 1_000_000
#: A task that writes a table holds a row group of about so many bytes.
ROW_GROUP_BYTES = 16 << 20
#: Folders that still hold tables, by application, in the order of writing.
_WRITTEN: dict[str, list[str]] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. Only where all executors are threads of the driver a local folder of our own
    stands in for it; on a cluster a folder that no one has named would be a different one on every machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="meterline-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _written(spark: SparkSession) -> list[str]:
    return _WRITTEN.setdefault(spark.sparkContext.applicationId, [])


@contextmanager
def lifetime(spark: SparkSession) -> Iterator[None]:
    """Remove on leaving every table that operators write inside; results over them must be stored or collected before."""
    before = len(_written(spark))
    try:
        yield
    finally:
        clear(spark, before)


def clear(spark: SparkSession, after: int = 0) -> None:
    """Remove the tables of this application; results that still read them can't be evaluated any more."""
    held = _written(spark)
    while len(held) > after:
        _delete(spark, held.pop())


def settle(spark: SparkSession) -> None:
    """Have the executors collect their garbage between two stages of very different needs: a collector that sees no pressure keeps
    the heap that the stage before has grown, and the next one's Python workers come on top. One short task for each core."""
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).selectExpr("java_method('java.lang.System', 'gc') as done").write.format("noop").mode("overwrite").save()


class Workspace:
    """Written tables of one run of one operator. They survive lost executors and cut the lineage."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_root(spark)}/meterline/{label}-{uuid.uuid4().hex}"
        _written(spark).append(self.root)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.option("parquet.block.size", ROW_GROUP_BYTES).parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Free tables that nothing reads any more."""
        for name in names:
            _delete(self.spark, self.path(name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def without(docs: DataFrame, gone: DataFrame, label: str) -> DataFrame:
    """``docs`` less the rows whose doc_id is in the one column of ``gone``; rows without doc_id stay. The ids are written and
    counted: up to BROADCAST_ROWS they are broadcast and no text moves, beyond that both sides are shuffled."""
    column = free_name(docs, "gone")
    ids = Workspace(docs.sparkSession, label).write(gone.toDF(column).where(f"{column} is not null").distinct(), "gone")
    if ids.count() <= BROADCAST_ROWS:
        ids = F.broadcast(ids)
    return docs.join(ids, docs["doc_id"] == ids[column], "left_anti")
