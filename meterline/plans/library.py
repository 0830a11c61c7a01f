"""A library of documents as tables: an append-only run log, documents by kind, and what follows from them."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ledger
from ..sources import documents
from . import schemas
from .config import Config, current_hashes

LOG = f"track_id string, stage string, started_at string, status string, path string, schema_version string, content_sha256 string, config_hash string, run {schemas.RUN}, error string"
FACTS = "track_id string, title string, artist string, has_video boolean, created_at string"
TOOL = "0.1.0"


class Library:
    """Tables under one folder that all executors see. Runs of a stage over many tracks are one job; its rows appear when it commits."""

    def __init__(self, spark: SparkSession, root: str, config: Config | None = None):
        self.spark, self.root, self.config = spark, root.rstrip("/"), config or Config()

    def _read(self, name: str, ddl: str) -> DataFrame:
        try:
            return self.spark.read.schema(ddl).parquet(f"{self.root}/{name}")
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], ddl)

    def log(self) -> DataFrame:
        return self._read("log", LOG)

    def facts(self) -> DataFrame:
        return self._read("facts", FACTS)

    def documents(self, kind: str) -> DataFrame:
        """The newest document of each track of one kind."""
        held = self._read(f"documents/{kind}", "track_id string, document string, content_sha256 string, started_at string")
        return ledger.latest(held, ["track_id"]).select(documents.parsed(F.col("document"), kind).alias("d")).select("d.*")

    def current(self) -> DataFrame:
        return self.spark.createDataFrame(current_hashes(self.config), "stage string, current_hash string")

    def entries(self) -> DataFrame:
        return ledger.latest(self.log(), ["track_id", "stage"])

    def manifests(self) -> DataFrame:
        return documents.manifests_of(self.entries(), self.facts())

    def track_ids(self) -> DataFrame:
        return self.facts().select("track_id").distinct().orderBy("track_id")

    def add_tracks(self, tracks: DataFrame) -> None:
        """New tracks (track_id, title, artist, has_video); those known already are left alone."""
        new = tracks.join(self.facts().select("track_id"), "track_id", "left_anti").dropDuplicates(["track_id"])
        fields = [F.col(c) for c in ("track_id", "title", "artist", "has_video")]
        new.select(*fields, F.lit(self._now()).alias("created_at")).write.mode("append").parquet(f"{self.root}/facts")

    @staticmethod
    def _now() -> str:
        return datetime.now(timezone.utc).isoformat(timespec="microseconds").replace("+00:00", "Z")

    def store(self, kind: str, rows: DataFrame, usage: DataFrame | None = None, device: str | None = None) -> None:
        """Write documents and their log rows; usage: (track_id, api_usage) of a run that cost something."""
        at = self._now()
        documents.with_hash(rows, kind).withColumn("started_at", F.lit(at)).write.mode("append").parquet(f"{self.root}/documents/{kind}")
        written = self._read(f"documents/{kind}", "track_id string, document string, content_sha256 string, started_at string").where(F.col("started_at") == at)
        spent = written.join(usage, "track_id", "left") if usage is not None else written.withColumn("api_usage", F.lit(None).cast(schemas.USAGE))
        hashes = dict(current_hashes(self.config))
        run = F.struct(F.lit(at).alias("started_at"), F.lit(None).cast("double").alias("duration_seconds"), F.lit(TOOL).alias("tool_version"), F.lit(device).cast("string").alias("device"), F.col("api_usage").cast(schemas.USAGE).alias("api_usage"))
        self._append(spent.select("track_id", F.lit(kind).alias("stage"), F.lit(at).alias("started_at"), F.lit("ok").alias("status"), F.lit(f"{kind}.json").alias("path"), F.lit(schemas.VERSIONS[kind]).alias("schema_version"), "content_sha256", F.lit(hashes.get(kind)).cast("string").alias("config_hash"), run.alias("run"), F.lit(None).cast("string").alias("error")))

    def fail(self, stage: str, errors: DataFrame, usage: DataFrame | None = None) -> None:
        """Record failures (track_id, error); money already spent is recorded with them, the earlier entry's path and hash are gone."""
        at = self._now()
        spent = errors.join(usage, "track_id", "left") if usage is not None else errors.withColumn("api_usage", F.lit(None).cast(schemas.USAGE))
        run = F.struct(F.lit(at).alias("started_at"), F.lit(None).cast("double").alias("duration_seconds"), F.lit(TOOL).alias("tool_version"), F.lit(None).cast("string").alias("device"), F.col("api_usage").cast(schemas.USAGE).alias("api_usage"))
        none = F.lit(None).cast("string")
        self._append(spent.select("track_id", F.lit(stage).alias("stage"), F.lit(at).alias("started_at"), F.lit("failed").alias("status"), none.alias("path"), none.alias("schema_version"), none.alias("content_sha256"), none.alias("config_hash"), run.alias("run"), F.substring("error", 1, 500).alias("error")))

    def _append(self, rows: DataFrame) -> None:
        rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in self.spark.createDataFrame([], LOG).schema)).write.mode("append").parquet(f"{self.root}/log")

    def status(self) -> DataFrame:
        """(track_id, title, stage, shown): recorded states, stale where the configuration has changed since."""
        entries = documents.manifest_entries(self.manifests())
        return ledger.shown_status(entries, self.current()).join(self.facts().select("track_id", "title"), "track_id").select("track_id", "title", "stage", "shown").orderBy("track_id", "stage")

    def work_list(self, stage: str) -> DataFrame:
        return ledger.work_list(self.facts().select("track_id"), self.entries().withColumn("artifact_exists", F.col("path").isNotNull()), self.current(), stage)

    def costs(self) -> DataFrame:
        return ledger.ledger(self.manifests())
