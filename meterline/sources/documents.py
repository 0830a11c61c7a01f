"""JSON documents as rows: scans with fixed schemas, canonical text with its hash, sinks, and the manifest view."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import schemas


def read(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Documents of one kind, one per file; anything that isn't of the schema fails the scan."""
    return spark.read.schema(schemas.schema(kind)).option("multiLine", True).option("mode", "FAILFAST").json(path)


def parsed(text: Column, kind: str) -> Column:
    return F.from_json(text, schemas.DDL[kind], {"mode": "FAILFAST"})


def canonical(document: Column | str) -> Column:
    """One-line JSON of a struct in its field order, absent fields left out."""
    return F.to_json(document)


def pretty(text: str) -> str:
    """The stored form of a canonical line: two-space indent, UTF-8, a line feed at the end."""
    return json.dumps(json.loads(text), ensure_ascii=False, indent=2) + "\n"


def with_hash(documents: DataFrame, kind: str) -> DataFrame:
    """(track_id, document text, content_sha256) of rows of a document's columns; fields are put into schema order."""
    fields = [F.col(f.name).cast(f.dataType).alias(f.name) for f in schemas.schema(kind).fields]
    text = canonical(F.struct(*fields))
    return documents.select("track_id", text.alias("document"), F.sha2(text.cast("binary"), 256).alias("content_sha256"))


def faults(documents: DataFrame, kind: str) -> DataFrame:
    """(track_id, constraint) for each value-domain constraint that a document breaks."""
    broken = F.array_compact(F.array(*(F.when(~F.expr(rule), F.lit(rule)) for rule in schemas.CONSTRAINTS[kind])))
    return documents.select("track_id", F.explode(broken).alias("constraint"))


def write(documents: DataFrame, kind: str, path: str) -> None:
    """Store documents as a table of one kind, replaced as a whole when the job commits."""
    with_hash(documents, kind).write.mode("overwrite").parquet(f"{path}/{kind}")


def stored(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """The columns of the stored documents of one kind."""
    table = spark.read.schema("track_id string, document string, content_sha256 string").parquet(f"{path}/{kind}")
    return table.select(parsed(F.col("document"), kind).alias("d")).select("d.*")


def track_ids(documents: DataFrame) -> DataFrame:
    return documents.select("track_id").distinct().orderBy("track_id")


def resolve(names: DataFrame, files: DataFrame) -> DataFrame:
    """names (name) with track_id: a name of 16 hex digits is an id, any other is a path of files (path, track_id); null if neither."""
    joined = names.join(files.select(F.col("path").alias("name"), F.col("track_id").alias("_of_file")), "name", "left")
    return joined.withColumn("track_id", F.when(F.col("name").rlike("^[0-9a-f]{16}$"), F.col("name")).otherwise(F.col("_of_file"))).drop("_of_file")


def manifest_entries(manifests: DataFrame) -> DataFrame:
    """(track_id, stage, status, path, config_hash, content_sha256, error), one row per entry that is there."""
    each = [F.struct(F.lit(s).alias("stage"), *(F.col(f"documents.{s}.{c}").alias(c) for c in ("status", "path", "config_hash", "content_sha256", "error"))) for s in ("source", "audio_features", "lyrics", "video", "structure")]
    stems = F.struct(F.lit("stems").alias("stage"), F.col("stems.status").alias("status"), F.lit(None).cast("string").alias("path"), F.col("stems.config_hash").alias("config_hash"), F.lit(None).cast("string").alias("content_sha256"), F.col("stems.error").alias("error"))
    return manifests.select("track_id", F.inline(F.array(*each, stems))).where("status is not null")


def manifests_of(log: DataFrame, facts: DataFrame) -> DataFrame:
    """Manifest rows from the newest log rows (track_id, stage, status, path, schema_version, content_sha256, config_hash, run, error) and
    facts (track_id, title, artist, has_video, created_at); a stage without a row is pending, video not applicable without video."""
    stages = ("source", "audio_features", "lyrics", "video", "structure")
    entry = schemas.ENTRY
    held = F.struct(*(F.col(c) for c in ("status", "path", "schema_version", "content_sha256", "config_hash", "run", "error"))).cast(entry)
    by_track = log.groupBy("track_id").agg(*(F.max(F.when(F.col("stage") == s, held)).alias(f"_{s}") for s in (*stages, "stems")))
    joined = facts.join(by_track, "track_id", "left")
    blank = lambda status: F.expr(f"cast(named_struct('status', '{status}', 'path', null, 'schema_version', null, 'content_sha256', null, 'config_hash', null, 'run', null, 'error', null) as {entry})")
    default = lambda s: F.when(~F.col("has_video"), blank("not_applicable")).otherwise(blank("pending")) if s == "video" else blank("pending")
    documents = F.struct(*(F.coalesce(F.col(f"_{s}"), default(s)).alias(s) for s in stages)).alias("documents")
    stems = F.when(F.col("_stems").isNotNull(), F.struct(F.col("_stems.status"), F.lit(None).cast("boolean").alias("retained"), F.col("_stems.config_hash"), F.col("_stems.run"), F.col("_stems.error"), F.lit(None).cast("string").alias("warning"))).alias("stems")
    return joined.select(F.lit(schemas.VERSIONS["manifest"]).alias("schema_version"), "track_id", "title", "artist", "has_video", "created_at", documents, stems)


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))
