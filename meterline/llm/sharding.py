"""Sharding by fixed virtual slots.

Records are hashed into a fixed number of slots, bytes are summed per slot, and a versioned table maps slots to shards. Only
the map is edited when shards are added or have become uneven; records keep their slots for good. The map has one row per
slot and version, so it is small whatever the data hold: the driver plans it, and it may be broadcast.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .workspace import Workspace, table

SLOTS = 4096
#: Copies of one record that a task writes out at once.
RUN = 65_536
MAP_SCHEMA = "version int, n_shards int, virtual_slot int, shard int"


def virtual_slot(n_slots: int = SLOTS):
    """The slot of a record: a hash of its doc_id, its text's checksum, and the number of the copy among equal records."""
    return F.pmod(F.xxhash64("doc_id", "text_crc32", "copy"), F.lit(n_slots)).cast("int")


def plan_map(slot_bytes: dict[int, int], n_shards: int, previous: dict[int, int] | None = None, n_slots: int = SLOTS) -> dict[int, int]:
    """Shard of each slot. Without a previous map, largest slots first to the lightest shard. With one, slots stay but for those
    whose move from the heaviest to the lightest shard makes the two more even, until no move does."""
    sizes = [slot_bytes.get(s, 0) for s in range(n_slots)]
    order = sorted(range(n_slots), key=lambda s: (-sizes[s], s))
    if previous is None:
        lightest = [(0, 0, k) for k in range(n_shards)]
        placed: dict[int, int] = {}
        for s in order:
            held, count, k = heapq.heappop(lightest)
            placed[s] = k
            heapq.heappush(lightest, (held + sizes[s], count + 1, k))
        return placed
    placed = {s: previous[s] if previous[s] < n_shards else n_shards - 1 for s in range(n_slots)}
    held = [0] * n_shards
    for s, k in placed.items():
        held[k] += sizes[s]
    while n_shards > 1:
        high, low = max(range(n_shards), key=lambda k: (held[k], -k)), min(range(n_shards), key=lambda k: (held[k], k))
        gap = held[high] - held[low]
        movable = [s for s in order if placed[s] == high and 0 < sizes[s] < gap]
        if not movable:
            return placed
        s = min(movable, key=lambda s: (abs(gap - 2 * sizes[s]), s))
        placed[s] = low
        held[high] -= sizes[s]
        held[low] += sizes[s]
    return placed


class SlotMap:
    """The stored map: each edit is appended as a new version, and earlier versions stay readable."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def append(self, placed: dict[int, int], n_shards: int, version: int) -> None:
        rows = [(version, n_shards, s, k) for s, k in sorted(placed.items())]
        self.spark.createDataFrame(rows, MAP_SCHEMA).coalesce(1).write.mode("append").parquet(self.path)

    def read(self, version: int) -> DataFrame:
        return self.spark.read.schema(MAP_SCHEMA).parquet(self.path).where(F.col("version") == version)

    def planned(self, version: int) -> dict[int, int]:
        return {r.virtual_slot: r.shard for r in self.read(version).collect()}


def slot_bytes(rows: DataFrame) -> dict[int, int]:
    """Bytes by slot of rows (virtual_slot, size); at most one entry per slot reaches the driver."""
    return {r[0]: r[1] for r in rows.groupBy("virtual_slot").agg(F.sum("size")).collect()}


def sized(docs: DataFrame, n_slots: int = SLOTS) -> DataFrame:
    """(doc_id, size, text_crc32, copy, virtual_slot). Equal records are counted before anything is shuffled by them, and dealt out
    again as copies 0, 1, ..., each with a slot of its own, so that one record that makes up much of a table fills no slot."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    counts = own.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("n"))
    copy = lambda low, high: F.explode(F.sequence(low, high)).alias("copy")
    few = counts.where(F.col("n") <= RUN).select("doc_id", "size", "text_crc32", copy(F.lit(0).cast("long"), F.col("n") - 1))
    # Runs of copies are dealt to different tasks before they are written out one by one.
    runs = counts.where(F.col("n") > RUN).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(RUN).cast("long"))).alias("at"))
    many = runs.hint("rebalance").select("doc_id", "size", "text_crc32", copy(F.col("at"), F.least(F.col("at") + RUN, F.col("n")) - 1))
    copies = few.union(many)
    return copies.withColumn("virtual_slot", virtual_slot(n_slots))


def assign(rows: DataFrame, mapped: DataFrame) -> DataFrame:
    """``rows`` (doc_id, size, text_crc32, copy, virtual_slot) with shard, and slot: the place in the shard, gapless from 0. Places
    follow virtual slots, so a shard's places come from per-slot counts and never from one sort of a whole shard."""
    counts = rows.groupBy("virtual_slot").agg(F.count("*").alias("n")).join(F.broadcast(mapped.select("virtual_slot", "shard")), "virtual_slot")
    # One row per slot at most: a window over all of them is small.
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1))
    places = counts.select("virtual_slot", "shard", F.coalesce(before, F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size", "copy"))
    return rows.withColumn("_within", within).join(F.broadcast(places), "virtual_slot").withColumn("slot", (F.col("_before") + F.col("_within") - 1).cast("long")).drop("_before", "_within")


def shard(docs: DataFrame, n_shards: int = 8, *, n_slots: int = SLOTS) -> DataFrame:
    """(doc_id, size, text_crc32, copy, shard, slot, virtual_slot) for each row of ``docs`` (doc_id, text; more columns are ignored).

    Shards are near equal in bytes; size is the text's UTF-8 bytes (null: none) plus 1. Equal rows, those without doc_id and text
    among them, are numbered and lie in slots of their own. Rows of equal texts are no unit here: slots take single records, and
    text_crc32 tells which belong together. A very long text counts with all its bytes, in the one shard that has it. An empty
    table gives no rows.
    """
    ws = Workspace(docs.sparkSession, "sharding")
    rows = ws.write(sized(docs, n_slots), "sized")
    stored = SlotMap(docs.sparkSession, ws.path("slot-map"))
    stored.append(plan_map(slot_bytes(rows), n_shards, n_slots=n_slots), n_shards, 1)
    return assign(rows, stored.read(1))


def op6_virtual_slot_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard(table(spark, sf_dir, "documents"), 8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")
