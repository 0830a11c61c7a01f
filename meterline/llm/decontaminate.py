"""Benchmark decontamination by winnowing.

Fingerprints of a text are the hashes of its k-word grams that are the smallest in some run of ``guarantee - k + 1`` grams, so
every shared span of ``guarantee`` words shares a fingerprint. The fingerprints of documents are joined with those of the
benchmark, and each hit is extended to the benchmark windows around it, which are then compared word by word. Benchmark items of fewer words than a window are one
window each and are looked up by their own length.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import blocks
from .workspace import BROADCAST_ROWS, Workspace, table, without

WINDOW, GRAM = 8, 5
#: A benchmark of so much text goes to the workers whole; the fingerprints of a larger one are joined with those of the documents.
BLOCK_BYTES = 16 << 20


def fingerprints(grams: np.ndarray, inside: np.ndarray, first: np.ndarray, span: int) -> np.ndarray:
    """Positions whose gram is the smallest (the last of equal ones) among some ``span`` consecutive grams of its text; in a text
    of fewer grams, the smallest of all."""
    n = len(grams)
    if not n:
        return np.zeros(0, np.int64)
    at = np.flatnonzero(inside)
    text = np.searchsorted(first, at, "right") - 1
    values, m = grams[at], len(at)
    chosen = np.zeros(m, bool)
    best = np.arange(m)
    for step in range(1, span):
        j = np.minimum(np.arange(m) + step, m - 1)
        better = (text[j] == text) & (values[j] <= values[best]) & (np.arange(m) + step < m)
        best = np.where(better, j, best)
    # A run that would reach over the end of its text is none, unless the whole text is shorter than a run.
    full = np.zeros(m, bool)
    full[: max(0, m - span + 1)] = text[: max(0, m - span + 1)] == text[span - 1 :]
    start = np.ones(m, bool)
    start[1:] = text[1:] != text[:-1]
    chosen[best[full | (start & ~full)]] = True
    return at[chosen]


class Benchmark:
    """Windows and fingerprints of benchmark items as sorted arrays."""

    def __init__(self, ids: list, texts: list[str | None], window: int = WINDOW, gram: int = GRAM):
        self.window, self.gram, self.span = window, gram, window - gram + 1
        self.words = words = blocks.Words(pa.array(texts, pa.string()), blocks.NOT_ALNUM)
        #: Distinct ids in ascending order; items are numbers of these.
        self.ids = sorted(set(ids))
        number = {item: k for k, item in enumerate(self.ids)}
        of = np.array([number[item] for item in ids], np.int64)
        #: By length: sorted window hashes and, beside them, the item of each and its first word.
        self.windows: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for length in sorted({window} | set(words.counts[(words.counts > 0) & (words.counts < window)].tolist())):
            hashes, whole = words.windows(length)
            if length < window:
                some = words.first[:-1][words.counts == length]
            else:
                some = np.flatnonzero(whole)
            item = of[words.text_of[some]]
            order = np.lexsort((item, hashes[some]))
            self.windows[length] = hashes[some][order], item[order], some[order]
        grams, inside = words.windows(gram)
        self.prints = np.unique(grams[fingerprints(grams, inside & (words.counts >= window)[words.text_of] if len(grams) else inside, words.first, self.span)])

    @staticmethod
    def _ranges(keys: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each key that is asked: (index of the asker, index of the key), all pairs."""
        lo, hi = np.searchsorted(keys, asked, "left"), np.searchsorted(keys, asked, "right")
        n = hi - lo
        who = np.repeat(np.arange(len(asked)), n)
        return who, np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())

    def _same(self, words: blocks.Words, at: np.ndarray, own: np.ndarray, length: int) -> np.ndarray:
        """Whether the ``length`` words from each of ``at`` on are the benchmark's from ``own`` on."""
        a, b = (np.repeat(x, length) + np.tile(np.arange(length), len(x)) for x in (at, own))
        mine = self.words
        sizes = words.ends[a] - words.starts[a]
        good = sizes == mine.ends[b] - mine.starts[b]
        on = np.flatnonzero(good)
        ends = np.cumsum(sizes[on])
        step = np.arange(ends[-1] if len(ends) else 0)
        before = ends - sizes[on]
        differ = words.low[np.repeat(words.starts[a[on]] - before, sizes[on]) + step] != mine.low[np.repeat(mine.starts[b[on]] - before, sizes[on]) + step]
        good[on] &= np.bincount(np.repeat(np.arange(len(on)), sizes[on]), differ, len(on)) == 0
        return good.reshape(-1, length).all(axis=1)

    def search(self, words: blocks.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words hit (one flag each), and (text, item) pairs of items with an occurring window."""
        n = len(words.hashes)
        delta = np.zeros(n + 1, np.int64)
        text, item = [], []
        for length, (keys, items, firsts) in self.windows.items():
            if not n or not len(keys):
                continue
            hashes, whole = words.windows(length)
            if length == self.window:
                grams, inside = words.windows(self.gram)
                found = fingerprints(grams, inside, words.first, self.span)
                found = found[_among(grams[found], self.prints)]
                # Extend: every window that contains the hit.
                at = np.unique((found[:, None] - np.arange(self.span)[None, :]).ravel())
                at = at[at >= 0]
            else:
                at = np.arange(n)
            at = at[whole[at]]
            at = at[_among(hashes[at], keys)]
            who, which = self._ranges(keys, hashes[at])
            same = self._same(words, at[who], firsts[which], length)
            who, which = who[same], which[same]
            sure = at[np.unique(who)]
            delta[sure] += 1
            delta[sure + length] -= 1
            text.append(words.text_of[at[who]])
            item.append(items[which])
        if not text:
            return np.zeros(n, bool), np.zeros(0, np.int64), np.zeros(0, np.int64)
        pairs = np.unique(np.stack([np.concatenate(text), np.concatenate(item)], axis=1), axis=0)
        return np.cumsum(delta[:n]) > 0, pairs[:, 0], pairs[:, 1]


def _among(values: np.ndarray, keys: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(values), bool)
    return keys[np.minimum(np.searchsorted(keys, values), len(keys) - 1)] == values


def _spans(words: blocks.Words, hit: np.ndarray) -> pa.Array:
    """For each text the runs of hit words as (start, end) word indices within the text, half-open."""
    n = len(hit)
    first = np.zeros(n, bool)
    first[words.first[:-1][words.counts > 0]] = True
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:] = hit[:-1]
    after[:-1] = hit[1:]
    opens = np.flatnonzero(hit & (first | ~before))
    last = np.zeros(n, bool)
    last[words.first[1:][words.counts > 0] - 1] = True
    closes = np.flatnonzero(hit & (last | ~after)) + 1
    of = words.text_of[opens]
    base = words.first[of]
    ends = np.searchsorted(of, np.arange(len(words.counts) + 1))
    pair = pa.StructArray.from_arrays([pa.array(opens - base), pa.array(closes - base)], names=["start", "end"])
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pair)


SCHEMA = "doc_id long, n_words long, spans array<struct<start:long,end:long>>, items array<{}>"


def _searched(ids: list, texts: list[str | None], kind: pa.DataType, window: int, gram: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        benchmark = None
        for part in blocks.chunks(batches, "text"):
            benchmark = benchmark or Benchmark(ids, texts, window, gram)
            words = blocks.Words(part.column(1), blocks.NOT_ALNUM)
            hit, text, item = benchmark.search(words)
            named = pa.array(benchmark.ids, kind).take(pa.array(item))
            found = pa.ListArray.from_arrays(pa.array(np.searchsorted(text, np.arange(len(words.counts) + 1)).astype(np.int32)), named)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(words.counts.astype(np.int64)), _spans(words, hit), found], names=["doc_id", "n_words", "spans", "items"])

    return run


def contamination(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, gram: int = GRAM, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_words, spans, items) for each row of ``docs``; benchmark has (item_id, text). More columns are ignored.

    Spans are maximal runs of hit words (start, end) counted in words of the document; items are the ids with an occurring
    window, ascending. A window is ``window`` consecutive words of an item; a shorter item, but not an empty one, is one window.
    Null or empty texts have no words and hit nothing; null item_ids are left out, other ids keep their type; items with equal
    texts all count. Repeated documents give repeated rows, an empty table none; an empty benchmark hits nothing. A very long text
    is searched whole, in memory of some tens of times its bytes. A benchmark of up to ``block_bytes`` of text goes to the workers
    whole: one pass without a shuffle. Beyond that fingerprints are joined by a shuffle, and only documents that share one with an
    item meet its text.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items = benchmark.select("item_id", F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    of_id = items.schema["item_id"].dataType
    schema, kind = SCHEMA.format(of_id.simpleString()), to_arrow_type(of_id)
    total = items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    if total <= block_bytes:
        rows = items.collect()
        return blocks.map_arrow(texts, _searched([r[0] for r in rows], [r[1] for r in rows], kind, window, gram), schema)
    ws = Workspace(spark, "decontaminate")
    items = ws.write(items.withColumn("item", F.monotonically_increasing_id()), "items")
    rows = ws.write(texts.withColumn("row", F.monotonically_increasing_id()), "rows")
    lengths = [r[0] for r in blocks.map_arrow(items.select("item", "text"), _short(window), "n long").distinct().collect()]
    prints = lambda of, key, whole: blocks.map_arrow(of.select(key, "text"), _prints(key, lengths, whole, window, gram), f"{key} long, print long")
    # Hashes meet, not texts; what shares one is searched word by word.
    pairs = ws.write(prints(rows, "row", False).join(prints(items, "item", True), "print").select("row", "item").distinct(), "pairs")
    hit = pairs.select("row").distinct()
    if hit.count() <= BROADCAST_ROWS:
        hit = F.broadcast(hit)
    held = pairs.join(items, "item").groupBy("row").agg(F.collect_list(F.struct("item_id", F.col("text").alias("words"))).alias("near"))
    found = blocks.map_arrow(rows.join(hit, "row", "left_semi").join(held, "row").select("row", "text", "near"), _extended(kind, window, gram), "row long, " + schema.split(", ", 2)[2])
    joined = blocks.map_arrow(rows.select("row", "doc_id", "text"), _counted, "row long, doc_id long, n_words long").join(found, "row", "left")
    empty = lambda c: F.coalesce(c, F.array().cast(found.schema[c].dataType)).alias(c)
    return joined.select("doc_id", "n_words", empty("spans"), empty("items"))


def _short(window: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Lengths of the items that have fewer words than a window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks.chunks(batches, "text"):
            counts = np.unique(blocks.Words(part.column(1), blocks.NOT_ALNUM, hashes=False).counts)
            yield pa.RecordBatch.from_arrays([pa.array(counts[(counts > 0) & (counts < window)])], names=["n"])

    return run


def _prints(key: str, lengths: list[int], whole_items: bool, window: int, gram: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Distinct fingerprints of each text, and hashes of its windows of the lengths that short items have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks.chunks(batches, "text"):
            words = blocks.Words(part.column(1), blocks.NOT_ALNUM)
            grams, inside = words.windows(gram)
            at = fingerprints(grams, inside & (words.counts >= window)[words.text_of] if len(grams) else inside, words.first, window - gram + 1)
            values, owner = [grams[at]], [words.text_of[at]]
            for length in lengths:
                hashes, inside = words.windows(length)
                at = np.flatnonzero(inside & (words.counts == length)[words.text_of] if whole_items else inside) if len(hashes) else np.zeros(0, np.int64)
                values.append(blocks.mix(hashes[at] + np.uint64(length)))
                owner.append(words.text_of[at])
            values, owner = np.concatenate(values), np.concatenate(owner)
            order = np.lexsort((values, owner))
            values, owner = values[order], owner[order]
            fresh = np.ones(len(values), bool)
            fresh[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(owner[fresh])), pa.array(values[fresh].view(np.int64))], names=[key, "print"])

    return run


def _extended(kind: pa.DataType, window: int, gram: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Spans and items of texts, each of which has the items that share a hash with it; others of a chunk may only add true hits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks.chunks(batches, "text"):
            near = part.column(2).flatten()
            items = set(zip(near.field(0).to_pylist(), near.field(1).to_pylist(), strict=True))
            ids, texts = zip(*sorted(items), strict=True)
            benchmark = Benchmark(list(ids), list(texts), window, gram)
            words = blocks.Words(part.column(1), blocks.NOT_ALNUM)
            hit, text, item = benchmark.search(words)
            named = pa.array(benchmark.ids, kind).take(pa.array(item))
            found = pa.ListArray.from_arrays(pa.array(np.searchsorted(text, np.arange(len(words.counts) + 1)).astype(np.int32)), named)
            yield pa.RecordBatch.from_arrays([part.column(0), _spans(words, hit), found], names=["row", "spans", "items"])

    return run


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in blocks.chunks(batches, "text"):
        words = blocks.Words(part.column(2), blocks.NOT_ALNUM, hashes=False)
        yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(words.counts.astype(np.int64))], names=["row", "doc_id", "n_words"])


def report(found: DataFrame, *, items: int = 2) -> DataFrame:
    """Digest columns of ``contamination``: a document is contaminated by at least ``items`` items."""
    names = F.array_join(F.array_sort(F.col("items").cast("array<string>")), ",")
    return found.select(
        "doc_id",
        "n_words",
        F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(names.cast("binary"), 256).alias("items_sha256"),
        (F.size("items") >= items).alias("contaminated"),
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame, *, items: int = 1) -> DataFrame:
    """The rows of ``docs`` in which windows of fewer than ``items`` items occur, all columns unchanged; rows without doc_id stay, and
    an empty table stays empty. A doc_id that occurs more than once goes with all its rows."""
    return without(docs, contamination(docs, benchmark).where(F.size("items") >= items).select("doc_id"), "contaminated")


def op8_winnowing_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


OP8_SQL = r"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents),
b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark),
bw as (select distinct item_id, least(len(w), 8) k, array_to_string(w[i:i + least(len(w), 8) - 1], ' ') g from (select item_id, w, unnest(range(1, greatest(len(w) - 8, 0) + 2)) i from b where len(w) > 0)),
lens as (select distinct k from bw),
dw as (select doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') g from (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) i from d, lens where len(w) >= k)),
hits as (select dw.doc_id, dw.k, dw.i, bw.item_id from dw join bw on dw.k = bw.k and dw.g = bw.g),
words as (select doc_id, count(distinct p) n_hit from (select doc_id, unnest(range(i, i + k)) p from (select distinct doc_id, k, i from hits)) group by 1),
items as (select doc_id, count(*) n_items, string_agg(item_id::varchar, ',' order by item_id::varchar) names from (select distinct doc_id, item_id from hits) group by 1)
select d.doc_id, len(d.w)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items, sha256(coalesce(names, '')) items_sha256, coalesce(n_items, 0) >= 2 contaminated
from d left join words using (doc_id) left join items using (doc_id)
"""
