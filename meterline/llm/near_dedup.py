"""Near-duplicate documents by b-bit MinHash.

Every document's minima give 32 band keys of four minima each, and their four low bits are packed into eight longs. Documents
that share a band key meet in blocks of bounded size; there the packed signatures are compared by bit counts, corrected for
chance collisions, and what may reach the threshold is confirmed on the full sets of word shingles. Documents of the same words
are one class from the start, by a 128-bit cryptographic digest of their words, so groups of copies of any size cost one row.

Blocks are tested in rounds with connected components in between, since two members of a component need no further test. First
come the blocks of a few bands; then all other small buckets that still hold several components, and of large ones a few
members of each component; last, whole, the large buckets that still hold several: all that isn't in a bucket's largest
component meets all others. So a large group of near copies falls together in the first rounds, at a few blocks per document;
only a large bucket of many documents that are *not* linked has all its pairs of blocks tested.

A pair at similarity 0.85 shares no band with probability (1 - 0.85^4)^32 = 6e-11, at 0.8 with 5e-8, and the floor of the
estimate lies six standard deviations under the threshold.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks
from .components import connected_components
from .workspace import BROADCAST_ROWS, Workspace, table, without

BANDS, ROWS, BITS = 32, 4, 4
MINIMA = BANDS * ROWS
LONGS = MINIMA * BITS // 64
#: Bands of the first round: enough to link most near copies.
FIRST_BANDS = 4
#: About so many members of a component stand for it in a large bucket, in the round before the last.
MEMBERS = 8
#: A block of a bucket holds about so many documents and shingles.
BLOCK_DOCS, BLOCK_SHINGLES = 256, 400_000

_MULTIPLIERS = np.random.default_rng(7).integers(1, 1 << 31, MINIMA, dtype=np.uint64).astype(np.uint32) * np.uint32(2) + np.uint32(1)
_SALTS = np.random.default_rng(8).integers(1, 1 << 63, BANDS, dtype=np.uint64)


def minima(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """MINIMA x sets: the minima of each non-empty set under as many multiplicative hashes."""
    short = (values >> np.uint64(32)).astype(np.uint32)
    out = np.zeros((MINIMA, len(offsets) - 1), np.uint32)
    if len(offsets) > 1:
        for k, by in enumerate(_MULTIPLIERS):
            out[k] = np.minimum.reduceat(short * by, offsets[:-1])
    return out


def pack(low: np.ndarray) -> np.ndarray:
    """sets x LONGS: the low BITS bits of all minima of a set side by side."""
    nibbles = (low.T & np.uint32((1 << BITS) - 1)).astype(np.uint64).reshape(low.shape[1], LONGS, 64 // BITS)
    return np.bitwise_or.reduce(nibbles << (np.arange(64 // BITS, dtype=np.uint64) * np.uint64(BITS)), axis=2)


def estimate(packed: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Similarity of each of ``packed`` with each of ``other`` by bit counts, less the collisions that chance gives."""
    differ = packed[:, None, :] ^ other[None, :, :]
    differ |= differ >> np.uint64(2)
    differ |= differ >> np.uint64(1)
    differ &= np.uint64(0x1111111111111111)
    equal = 1 - np.bitwise_count(differ).sum(axis=2, dtype=np.int64) / MINIMA
    return (equal - 2.0**-BITS) / (1 - 2.0**-BITS)


def _lists(values: np.ndarray) -> pa.Array:
    rows, wide = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * wide), pa.array(np.ascontiguousarray(values).view(np.int64).ravel()))


def _sketch(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks.chunks(batches, "text"):
            words = blocks.Words(part.column(1), blocks.WHITESPACE)
            values, offsets = blocks.shingles(words, k)
            sizes = np.diff(offsets)
            some = np.flatnonzero(sizes)
            starts = offsets[:-1][some]
            low = minima(values, np.append(starts, len(values)))
            quads = low.reshape(BANDS, ROWS, -1).astype(np.uint64)
            keys = blocks.mix((quads[:, 0] << np.uint64(32) | quads[:, 1]) + _SALTS[:, None])
            keys = blocks.mix(keys ^ (quads[:, 2] << np.uint64(32) | quads[:, 3]))
            digests = np.frombuffer(b"".join(words.digests()), np.int64).reshape(-1, 2)
            bands, packed = np.zeros((len(sizes), BANDS), np.uint64), np.zeros((len(sizes), LONGS), np.uint64)
            bands[some], packed[some] = keys.T, pack(low)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(sizes.astype(np.int64)), *(pa.array(np.ascontiguousarray(digests[:, i])) for i in (0, 1)), _lists(bands), _lists(packed)],
                names=["doc_id", "n_shingles", "words_a", "words_b", "bands", "packed"],
            )

    return run


def _root(parent: list[int], x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def links_in_block(values: np.ndarray, offsets: np.ndarray, packed: np.ndarray, left: np.ndarray, right: np.ndarray, group: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links between members of different groups, one of ``left`` with one of ``right``, that join the groups as all links would.

    All intersections come from products of 0/1 matrices over the shingles that several members hold, some thousand columns at
    a time; memory stays at members x columns.
    """
    n = len(offsets) - 1
    sizes = np.diff(offsets)
    floor = percent / 100 - 6 * np.sqrt(percent / 100 * (1 - percent / 100) / MINIMA) / (1 - 2.0**-BITS)
    wanted = np.outer(left, right) | np.outer(right, left)
    wanted &= group[:, None] != group[None, :]
    wanted[np.tril_indices(n)] = False
    if not wanted.any():
        return []
    wanted &= estimate(packed, packed) >= floor
    if not wanted.any():
        return []
    if n == 2:
        both = len(np.intersect1d(values[offsets[0] : offsets[1]], values[offsets[1] : offsets[2]], assume_unique=True))
        return [(0, 1)] if 100 * both >= percent * (sizes[0] + sizes[1] - both) else []
    _, column, held = np.unique(values, return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(n), sizes)
    shared = held > 1
    column, owner = (np.cumsum(shared) - 1)[column[shared[column]]], owner[shared[column]]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    both = np.zeros((n, n), np.int64)
    width = 4096
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        lo, hi = np.searchsorted(column, [at, at + width])
        some = np.zeros((n, width), np.float32)
        some[owner[lo:hi], column[lo:hi] - at] = 1
        both += (some @ some.T).astype(np.int64)
    wanted &= 100 * both >= percent * (sizes[:, None] + sizes[None, :] - both)
    of = np.unique(group, return_inverse=True)[1].tolist()
    parent, out = list(range(n)), []
    for a, b in np.argwhere(wanted).tolist():
        if (x := _root(parent, of[a])) != (y := _root(parent, of[b])):
            parent[max(x, y)] = min(x, y)
            out.append((a, b))
    return out


def _confirm(k: int, percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows arrive sorted by task; a run of equal tasks is one block."""

    def done(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        part = pa.Table.from_batches(rows).combine_chunks().to_batches()[0]
        col = {name: part.column(i) for i, name in enumerate(part.schema.names)}
        values, offsets = blocks.shingles(blocks.Words(col["text"], blocks.WHITESPACE), k)
        ids, task = col["doc_id"].to_numpy(), np.stack([col[x].to_numpy() for x in ("bucket", "left", "right")], axis=1)
        packed = col["packed"].values.to_numpy(zero_copy_only=False)[col["packed"].offsets[0].as_py() :][: len(ids) * LONGS].reshape(-1, LONGS).view(np.uint64)
        block, group = col["block"].to_numpy(), col["component"].to_numpy()
        edges = np.flatnonzero(np.append(True, (task[1:] != task[:-1]).any(axis=1)))
        a, b = [], []
        for lo, hi in zip(edges, np.append(edges[1:], len(ids)), strict=True):
            if hi - lo > 1:
                of = offsets[lo : hi + 1]
                for x, y in links_in_block(values[of[0] : of[-1]], of - of[0], packed[lo:hi], block[lo:hi] == task[lo, 1], block[lo:hi] == task[lo, 2], group[lo:hi], percent):
                    a.append(ids[lo + x])
                    b.append(ids[lo + y])
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for part in blocks.chunks(batches, "text"):
            task = np.stack([part.column(part.schema.get_field_index(x)).to_numpy() for x in ("bucket", "left", "right")], axis=1)
            cut = 0
            if size >= blocks.CHUNK_BYTES:
                last = held[-1].slice(held[-1].num_rows - 1)
                ends = [last.column(last.schema.get_field_index(x))[0].as_py() for x in ("bucket", "left", "right")]
                same = (task == ends).all(axis=1)
                cut = len(same) if same.all() else int(np.argmin(same))
                if cut < len(same):
                    if cut:
                        held.append(part.slice(0, cut))
                    yield done(held)
                    held, size = [], 0
                    part = part.slice(cut)
            held.append(part)
            size += int(blocks.lengths(part.column(part.schema.get_field_index("text"))).sum())
        if held:
            yield done(held)

    return run


def _tested(ws: Workspace, name: str, texts: DataFrame, classes: DataFrame, rows: DataFrame, k: int, percent: int) -> DataFrame | None:
    """Links found by the tasks in ``rows`` (doc_id, bucket, block, left, right, component), None where there are none."""
    rows = ws.write(rows.select("doc_id", "bucket", "block", "left", "right", "component"), f"{name}-tasks")
    wanted = rows.select("doc_id").distinct()
    if not (n := wanted.count()):
        return None
    if n <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    held = texts.join(wanted, "doc_id", "left_semi").join(classes.select("doc_id", "packed"), "doc_id")
    met = rows.join(held, "doc_id").repartition("bucket", "left", "right").sortWithinPartitions("bucket", "left", "right")
    links = ws.write(blocks.map_arrow(met.select("bucket", "left", "right", "block", "doc_id", "component", "packed", "text"), _confirm(k, percent), "a long, b long"), name)
    ws.drop(f"{name}-tasks")
    return None if links.isEmpty() else links


def _labelled(ws: Workspace, name: str, placed: DataFrame, found: DataFrame | None) -> DataFrame:
    """The rows of ``placed`` whose bucket holds several components, with their component, the number ``c`` of its members in the
    bucket and the first of them, and the bucket's largest component, members and ``some``, the members that stand for all."""
    rows = placed.withColumn("component", F.col("doc_id"))
    if found is not None:
        known = found.withColumnsRenamed({"node": "doc_id", "component": "of"})
        known = F.broadcast(known) if known.count() <= BROADCAST_ROWS // 8 else known
        # Written, since the counts and the tasks read it: the join would run anew for each of them.
        rows = ws.write(placed.join(known, "doc_id", "left").select("doc_id", "bucket", "n_blocks", F.coalesce("of", "doc_id").alias("component")), f"{name}-labels")
    sizes = rows.groupBy("bucket", "component").agg(F.count("*").alias("c"), F.min("doc_id").alias("lead"))
    stats = sizes.groupBy("bucket").agg(F.sum("c").alias("n"), F.sum(F.least("c", F.lit(MEMBERS))).alias("some"), F.max_by("component", "c").alias("top"), F.max("c").alias("top_n"), F.count("*").alias("k")).where("k > 1")
    # One row for each component of a bucket: where there are many, AQE splits the rows of a large one.
    sizes = ws.write(sizes.join(stats, "bucket"), f"{name}-sizes")
    return rows.join(F.broadcast(sizes) if sizes.count() <= BROADCAST_ROWS // 4 else sizes, ["bucket", "component"])


def _components(ws: Workspace, texts: DataFrame, classes: DataFrame, k: int, percent: int, block_docs: int) -> DataFrame | None:
    """(node, component) of the linked classes; None where no two are."""
    members = classes.select("doc_id", "n_shingles", F.xxhash64("doc_id", "words_a", "words_b").alias("mixed"), F.posexplode("bands").alias("band", "bucket"))
    # Buckets of several classes; those with the same members are one.
    buckets = (
        members.groupBy("bucket")
        .agg(F.count("*").alias("n"), F.sum("n_shingles").alias("size"), F.bit_xor("mixed").alias("who"), F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.min("band").alias("band"))
        .where("n > 1 and least < most")
        .groupBy("n", "who", "least", "most")
        .agg(F.min(F.struct("band", "bucket")).alias("x"), F.min("size").alias("size"))
        .select("x.bucket", F.greatest(F.ceil(F.col("n") / block_docs), F.ceil(F.col("size") / BLOCK_SHINGLES)).cast("int").alias("n_blocks"))
    )
    placed = ws.write(members.join(buckets, "bucket").select("doc_id", "bucket", "band", "n_blocks"), "members")

    def block(salt: int, n_blocks):
        return F.pmod(F.xxhash64("doc_id", "bucket", F.lit(salt)), n_blocks).cast("int")

    def within(rows: DataFrame, salt: int, n_blocks) -> DataFrame:
        return rows.withColumn("block", block(salt, n_blocks)).withColumn("left", F.col("block")).withColumn("right", F.col("block"))

    def first(found: DataFrame | None) -> DataFrame:
        return within(placed.where(F.col("band") < FIRST_BANDS).withColumn("component", F.col("doc_id")), 1, F.col("n_blocks"))

    def some(found: DataFrame | None) -> DataFrame:
        rows = _labelled(ws, "some", placed.where((F.col("band") >= FIRST_BANDS) | (F.col("n_blocks") > 1)), found)
        stands = (F.col("n_blocks") == 1) | (F.col("doc_id") == F.col("lead")) | (block(3, F.ceil(F.col("c") / MEMBERS)) == 0)
        return within(rows.where(stands), 2, F.when(F.col("n_blocks") == 1, 1).otherwise(F.ceil(F.col("some") / block_docs)))

    def rest(found: DataFrame | None) -> DataFrame:
        # The largest component has the blocks from 0 on, the others those behind; each of these meets every block.
        rows = _labelled(ws, "rest", placed.where("n_blocks > 1"), found).withColumn("others", F.ceil(F.col("n_blocks") * (F.col("n") - F.col("top_n")) / F.col("n")).cast("int"))
        inner = F.col("component") == F.col("top")
        rows = rows.withColumn("block", F.when(inner, block(4, F.col("n_blocks"))).otherwise(F.col("n_blocks") + block(4, F.col("others"))))
        meets = F.explode(F.sequence(F.when(inner, F.col("n_blocks")).otherwise(0), F.col("n_blocks") + F.col("others") - 1)).alias("other")
        return rows.select("*", meets).withColumn("left", F.greatest("block", "other")).withColumn("right", F.least("block", "other"))

    found = None
    for tasks in (first, some, rest):
        links = _tested(ws, tasks.__name__, texts, classes, tasks(found), k, percent)
        ws.drop(f"{tasks.__name__}-labels")
        if links is not None:
            links = links if found is None else links.union(found.toDF("a", "b"))
            found = connected_components(links, Workspace(ws.spark, f"near-dedup-{tasks.__name__}"))
    ws.drop("members")
    return found


def near_duplicates(docs: DataFrame, *, words: int = 5, percent: int = 80, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs`` (doc_id long, text string; more columns are ignored).

    Two documents are linked when the Jaccard similarity of their sets of ``words``-word shingles is at least ``percent`` / 100;
    component_id is the smallest doc_id reachable over links, kept marks the document that carries it. A document of fewer
    words has its whole sequence as one shingle. Null or empty texts have no shingle and are linked with nothing. Rows with the
    same doc_id are one node, whatever their texts: each gets the same component. A null doc_id gives a null component and is kept.
    An empty table gives an empty result. A very long text is held whole by one task, in memory of some tens of times its bytes.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "near-dedup")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketches = ws.write(blocks.map_arrow(texts, _sketch(words), "doc_id long, n_shingles long, words_a long, words_b long, bands array<long>, packed array<long>"), "sketches")
    filled = sketches.where("n_shingles > 0 and doc_id is not null")
    key = ["words_a", "words_b"]
    classes = ws.write(filled.groupBy(*key).agg(F.min_by(F.struct("doc_id", "n_shingles", "bands", "packed"), "doc_id").alias("x")).select(*key, "x.*"), "classes")
    found = _components(ws, texts, classes, words, percent, block_docs)
    # A class keeps its smallest doc_id only; doc_ids with several texts, an empty one among them, link their classes.
    a_text = F.struct(*key)
    several = sketches.where("doc_id is not null").groupBy("doc_id").agg(F.min(a_text).alias("low"), F.max(a_text).alias("high")).where("low < high").select("doc_id")
    several = ws.write(several, "several")
    if m := several.count():
        several = F.broadcast(several) if m <= BROADCAST_ROWS else several
        same = sketches.join(several, "doc_id", "left_semi").where("n_shingles > 0").select("doc_id", *key).distinct()
        same = same.withColumnRenamed("doc_id", "b").join(classes.select(*key, F.col("doc_id").alias("a")), key).select("a", "b")
        found = connected_components(same if found is None else same.union(found.toDF("a", "b")), ws)
    elif found is None:
        found = spark.createDataFrame([], "node long, component long")
    known = classes.select(*key, F.col("doc_id").alias("node")).join(found, "node", "left").select(*key, F.coalesce("component", "node").alias("component"))
    linked = sketches.select("doc_id", "n_shingles", F.when(F.expr("n_shingles > 0 and doc_id is not null"), F.col("words_a")).alias("words_a"), "words_b").join(known, key, "left")
    if m:
        own = several.join(found.toDF("doc_id", "own"), "doc_id")
        linked = linked.join(F.broadcast(own) if m <= BROADCAST_ROWS else own, "doc_id", "left").withColumn("component", F.coalesce("component", "own"))
    component = F.coalesce("component", "doc_id")
    return linked.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, *, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that carry their group's smallest doc_id (and those without doc_id), all columns unchanged. An empty
    table stays empty; for texts see ``near_duplicates``."""
    return without(docs, near_duplicates(docs, percent=percent).where("not kept").select("doc_id"), "near-dedup-gone")


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), percent=85)
