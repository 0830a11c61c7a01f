r"""Repeated passages across documents, by line hashing down to parts of lines.

A line's words (``[^\x20\x09-\x0D]+``, A-Z lower-cased) are cut into units at places that the words themselves choose: a word
opens a unit when its key is the least among its REACH neighbours on either side in the line; a word behind the end of a
sentence comes before all others. A short line is one unit; in a long one a passage that stands in other surroundings is cut
alike but for its outermost words. A unit's digest is a 128-bit hash of its words, so case and spacing don't matter. Digests
are grouped over all documents and the earliest occurrence by (doc_id, unit) stays. A later occurrence is a repeat; repeats
one after another make up a passage, which is removed when it has at least ``min_words`` words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import blocks
from .workspace import BROADCAST_ROWS, Workspace, free_name, table

#: Shorter repeats (headings, licence lines, names) recur in unrelated texts and aren't passages.
MIN_WORDS = 30
#: A unit inside a line has more than so many words.
REACH = 3
#: The key of a word comes from its first and last eight bytes as numbers, times these factors, modulo this prime; words inside
#: a sentence come later by 2^33.
PRIME, HEAD, TAIL, INSIDE = 4_294_967_291, 433_494_437, 715_827_883, 1 << 33
_PLACE = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
UNIT = "doc_id long, version int, unit int, start int, n_bytes int, n_words int, shape int, digest_a long, digest_b long"


def openings(words: blocks.Words) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first word of each unit, and for each word the first word of its line."""
    n = len(words.starts)
    line = np.searchsorted(np.flatnonzero(words.data == 0x0A), words.starts)
    opens = np.ones(n, bool)
    opens[1:] = (line[1:] != line[:-1]) | (words.text_of[1:] != words.text_of[:-1])
    at = np.flatnonzero(opens)
    sizes = np.diff(np.append(at, n))
    of = np.repeat(at, sizes)
    place = np.arange(n) - of
    head = words.heads(words.starts, words.ends).byteswap() % np.uint64(PRIME)
    sizes_of = np.minimum(words.ends - words.starts, 8)
    tail = (words.heads(words.ends - sizes_of, words.ends).byteswap() >> (np.uint64(64) - np.uint64(8) * sizes_of.astype(np.uint64))) % np.uint64(PRIME)
    key = (head * np.uint64(HEAD) + tail * np.uint64(TAIL)) % np.uint64(PRIME)
    last = words.low[words.ends - 1]
    stop = (last == 0x2E) | (last == 0x21) | (last == 0x3F)
    key[1:] += np.where(stop[:-1] & ~opens[1:], 0, INSIDE).astype(np.uint64)
    key[:1] += np.uint64(INSIDE)
    some = np.flatnonzero((place >= REACH) & (place + REACH < np.repeat(sizes, sizes)))
    for d in range(1, REACH + 1):
        some = some[key[some - d] > key[some]]
        some = some[key[some + d] >= key[some]]
    opens[some] = True
    return np.flatnonzero(opens), of


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in blocks.chunks(batches, "text"):
        words = blocks.Words(part.column(2), blocks.WHITESPACE, hashes=False)
        at, line = openings(words)
        if not len(at):
            continue
        n = len(words.starts)
        counts = np.diff(np.append(at, n))
        place = np.arange(n, dtype=np.uint64) - np.repeat(at.astype(np.uint64), counts)
        digests = []
        for which, step in enumerate(_PLACE):
            values = blocks.mix(words.hash_of(words.starts, words.ends, which) + place * step)
            digests.append(blocks.mix(np.add.reduceat(values, at) ^ (counts.astype(np.uint64) * step)))
        text = words.text_of[at]
        base = words.offsets[text]
        final = at + counts - 1
        after = np.append(words.starts[1:], len(words.data))[final]
        after = np.minimum(after, words.offsets[text + 1])
        next_line = np.append(line[1:], n)[final]
        # Bytes up to the next word, then whether the unit closes its line, then whether it opens one.
        shape = (after - words.ends[final]) << 2 | (next_line != line[final]).astype(np.int64) << 1 | (line[at] == at)
        columns = [np.arange(len(at)) - np.searchsorted(text, text), words.starts[at] - base, words.ends[final] - words.starts[at], counts, shape]
        yield pa.RecordBatch.from_arrays(
            [*(part.column(i).take(pa.array(text)) for i in (0, 1)), *(pa.array(c.astype(np.int32)) for c in columns), *(pa.array(d.view(np.int64)) for d in digests)],
            names=[f.split()[0] for f in UNIT.split(", ")],
        )


def repeated_units(docs: DataFrame, ws: Workspace) -> DataFrame:
    """Every unit of ``docs`` that occurs earlier, with its document, place and shape, the place of the earliest occurrence, the
    run of repeats that it belongs to, and the words of that run."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    texts = texts.select("doc_id", F.hash("text").alias("version"), "text")
    units = ws.write(blocks.map_arrow(texts, _units, UNIT), "units")
    digest, place = ["digest_a", "digest_b"], F.struct("doc_id", "version", "unit")
    groups = units.groupBy(*digest).agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    groups = ws.write(groups, "groups")
    # Units meet their group by a shuffle at every size; AQE splits what a common digest brings together.
    # Equal rows of a document hold the same units; each counts once.
    repeats = units.join(groups, digest).where(place > F.col("first")).drop(*digest).distinct()
    run = F.col("unit") - F.row_number().over(Window.partitionBy("doc_id", "version").orderBy("unit"))
    return repeats.withColumn("run", run).withColumn("run_words", F.sum("n_words").over(Window.partitionBy("doc_id", "version", "run")))


def repeated_passages(docs: DataFrame, *, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, unit, start, end, n_words, passage_words, first_doc_id, first_unit): the units of all passages to remove, and where
    the earliest occurrence of each stays. With ``min_words=1`` it is every later occurrence of any unit.

    ``docs``: (doc_id, text); more columns are ignored. unit counts the document's units from 0; start and end are byte offsets
    in the UTF-8 text, half-open, from a unit's first word to the end of its last. Null or empty texts have no units; rows with a
    null doc_id take no part. Equal rows are one document. Rows with the same doc_id and different texts are different documents,
    in an order that depends on nothing but their texts. A unit that occurs again in its own document is a repeat as well. A very
    long text is held whole by one task; a very long word is hashed on its own. An empty table gives no rows.
    """
    found = repeated_units(docs, Workspace(docs.sparkSession, "substring-dedup")).where(F.col("run_words") >= min_words)
    return found.select(
        "doc_id", "unit", "start", (F.col("start") + F.col("n_bytes")).alias("end"), "n_words", F.col("run_words").cast("int").alias("passage_words"), F.col("first.doc_id").alias("first_doc_id"), F.col("first.unit").alias("first_unit")
    )


def without_repeats(docs: DataFrame, *, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with every repeated passage cut from its text; n_chars, where there is one, follows the text.

    The white space behind a passage goes with it, but for the line feed of a line whose beginning stays. All rows stay; a
    document made up of repeats is left with an empty text. Other columns, whatever their names, are unchanged, and so are null
    texts and rows without doc_id. An empty table stays empty.
    """
    ws = Workspace(docs.sparkSession, "cut-repeats")
    found = repeated_units(docs, ws).where(F.col("run_words") >= min_words)
    end, gap = F.col("start") + F.col("n_bytes"), F.shiftright("shape", 2)
    passages = found.groupBy("doc_id", "version", "run").agg(
        F.min(F.struct("start", "shape")).alias("a"), F.max(F.struct(end.alias("end"), gap.alias("gap"), "shape")).alias("b")
    )
    stop = F.col("b.end") + F.when((F.col("a.shape").bitwiseAND(1) == 1) | (F.col("b.shape").bitwiseAND(2) == 0), F.col("b.gap")).otherwise(0)
    of, version, cut, held = (free_name(docs, x) for x in ("of", "version", "cuts", "bytes"))
    spans = passages.select(F.col("doc_id").alias(of), F.col("version").alias(version), F.struct(F.col("a.start").alias("start"), stop.alias("stop")).alias("span"))
    cuts = ws.write(spans.groupBy(of, version).agg(F.sort_array(F.collect_list("span")).alias(cut)), "cuts")
    if (cuts.agg(F.sum(F.size(cut))).first()[0] or 0) <= BROADCAST_ROWS:
        cuts = F.broadcast(cuts)
    # An array of bytes is cut between characters, since words begin and end there.
    kept = F.expr(
        f"array_join(transform(sequence(0, size(`{cut}`)), i -> cast(substring(`{held}`, if(i = 0, 0, `{cut}`[i - 1].stop) + 1,"
        f" if(i = size(`{cut}`), octet_length(text), `{cut}`[i].start) - if(i = 0, 0, `{cut}`[i - 1].stop)) as string)), '')"
    )
    joined = docs.join(cuts, (docs["doc_id"].cast("long") == cuts[of]) & (F.hash(docs["text"].cast("string")) == cuts[version]), "left").withColumn(held, F.col("text").cast("binary"))
    changed = joined.withColumn("text", F.when(F.col(cut).isNotNull(), kept).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.when(F.col(cut).isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return changed.select(*(f"`{c}`" for c in docs.columns))


def op5_line_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))


_LOW = "translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: Units are compared as strings of words, not by digest.
OP5_SQL = rf"""
with a as (select doc_id, regexp_extract_all(text, '[\x20\x09-\x0D]+|[^\x20\x09-\x0D]+') t from documents where doc_id is not null and text is not null),
b as (select doc_id, unnest(range(1, len(t) + 1)) i, unnest(t) x from a),
c as (select *, sum(strlen(x)) over w - strlen(x) s, sum(len(x) - len(replace(x, chr(10), ''))) over w line from b window w as (partition by doc_id order by i)),
d as (select doc_id, i, s, strlen(x) n, line, {_LOW} x, row_number() over (partition by doc_id, line order by i) - 1 p, count(*) over (partition by doc_id, line) c,
  lag(x) over (partition by doc_id, line order by i) before from c where not regexp_matches(x, '^[\x20\x09-\x0D]')),
e as (select *, (('0x' || rpad(substr(hex(x), 1, 16), 16, '0'))::ubigint % {PRIME} * {HEAD} + ('0x' || right(hex(x), 16))::ubigint % {PRIME} * {TAIL}) % {PRIME} + case when right(before, 1) in ('.', '!', '?') then 0 else {INSIDE} end k from d),
f as (select *, p = 0 or p >= {REACH} and p + {REACH} < c
  and min(k) over (partition by doc_id, line order by i rows between {REACH} preceding and 1 preceding) > k
  and min(k) over (partition by doc_id, line order by i rows between 1 following and {REACH} following) >= k opens from e),
g as (select *, sum(opens::int) over (partition by doc_id order by i) - 1 unit from f),
h as (select doc_id, unit, min(s) s, max(s + n) e, count(*) n, string_agg(x, ' ' order by i) u from g group by 1, 2),
j as (select *, first_value(doc_id) over (partition by u order by doc_id, unit) fd, first_value(unit) over (partition by u order by doc_id, unit) fu from h),
k as (select *, unit - row_number() over (partition by doc_id order by unit) r from j where (doc_id, unit) <> (fd, fu)),
l as (select *, sum(n) over (partition by doc_id, r) t from k)
select doc_id, unit::int unit, s::int as start, e::int as "end", n::int n_words, t::int passage_words, fd first_doc_id, fu::int first_unit from l where t >= {MIN_WORDS}
"""
