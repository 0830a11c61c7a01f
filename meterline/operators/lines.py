"""Lines of text on a timeline: markup, flags, anchoring of supplied lines to observed words, repetition."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.rounding import half_even, rounded
from . import intervals
from .series import many_tasks


@dataclass(frozen=True)
class LineRules:
    confidence: float = 0.5
    long_word: float = 2.5
    no_speech: float = 0.5
    compression: float = 2.4
    overlap_db: float = -15.0
    overlap_share: float = 0.8


def parse_supplied(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, source_line_index, text, hint_seconds, label) of every line that isn't blank without its time stamps; label is null for
    a line to be sung and set for section markup. All stamps are removed, the first gives the hint."""
    raw = texts.select(key, F.posexplode(F.split(F.regexp_replace(F.col(text), "\r\n?", "\n"), "\n")).alias("source_line_index", "_raw")).withColumn("_raw", F.trim(F.regexp_replace("_raw", r"^\s+|\s+$", "")))
    lines = raw.select(key, "source_line_index", T.without_stamps(F.col("_raw")).alias("text"), T.stamp_seconds(F.col("_raw")).alias("hint_seconds")).where("text <> ''")
    return lines.withColumn("label", F.when(T.is_markup(F.col("text")), T.markup_label(F.col("text"))))


def clamped(start: Column, end: Column, duration: Column) -> tuple[Column, Column]:
    """Times moved into [0, duration], the end not before the start."""
    first = F.least(F.greatest(start, F.lit(0.0)), duration)
    return first, F.least(F.greatest(end, first), duration)


def words_of(words: Column) -> Column:
    """Observed words in document form: blank ones dropped, times and confidence rounded."""
    held = F.filter(words, lambda w: F.trim(w["text"]) != "")
    return F.transform(
        held,
        lambda w: F.struct(F.trim(w["text"]).alias("text"), rounded(w["start"], "seconds").alias("start_seconds"), rounded(w["end"], "seconds").alias("end_seconds"), rounded(w["probability"], "ratio").alias("confidence")),
    )


def mean_confidence(words: Column) -> Column:
    """Mean word confidence, null without words."""
    total = F.aggregate(words, F.lit(0.0), lambda s, w: s + w["confidence"])
    return F.when(F.size(words) > 0, total / F.size(words))


def line_flags(base: Column, words: Column, no_speech: Column, compression: Column, loud_share: Column, outside: Column, rules: LineRules = LineRules()) -> Column:
    """Flags of a line in fixed order: those it has, then low confidence (once), long word, non-lexical, overlap, outside activity.

    ``words``: array of structs with confidence, start_seconds and end_seconds; ``no_speech`` and ``compression`` are null where the
    line comes from no segment.
    """
    low = (mean_confidence(words) < rules.confidence) & ~F.array_contains(base, "low_confidence")
    long = F.exists(words, lambda w: w["end_seconds"] - w["start_seconds"] > rules.long_word)
    lexical = F.coalesce((no_speech > rules.no_speech) | (compression > rules.compression), F.lit(False))
    more = F.array(
        F.when(F.coalesce(low, F.lit(False)), "low_confidence"),
        F.when(long, "long_word_duration"),
        F.when(lexical, "possibly_non_lexical"),
        F.when(loud_share >= rules.overlap_share, "overlapping_vocals"),
        F.when(outside, "outside_vocal_activity"),
    )
    return F.concat(base, F.array_compact(more))


def flag_outside(lines: DataFrame, regions: DataFrame, keys: Sequence[str], *, width: float) -> DataFrame:
    """``lines`` (keys..., start, end) with outside: true where no region is strictly overlapped."""
    inside = intervals.overlapping(lines, regions, keys, width=width).select(*keys, "start", "end").distinct().withColumn("_in", F.lit(True))
    return lines.join(inside, [*keys, "start", "end"], "left").withColumn("outside", F.col("_in").isNull()).drop("_in")


def flagged_ratio(lines: DataFrame, keys: Sequence[str], flags: str = "flags") -> DataFrame:
    return lines.groupBy(*keys).agg(rounded(F.avg((F.size(flags) > 0).cast("double")), "ratio").alias("lines_flagged_ratio"))


def language_source(pinned: Column, n_regions: Column, detected: Column, fallback: str = "en") -> tuple[Column, Column]:
    """(language, how it came about): pinned by configuration, the fallback where nothing is sung, else what was detected."""
    language = F.when(pinned.isNotNull(), pinned).when(n_regions == 0, F.lit(fallback)).otherwise(detected)
    how = F.when(pinned.isNotNull(), "pinned").when(n_regions == 0, "default_no_vocal_activity").otherwise("detected_vocal_window")
    return language, how


def pair_words(lines: DataFrame, keys: Sequence[str], supplied: str = "supplied", observed: str = "observed") -> DataFrame:
    """(keys..., word_idx, text, start, end, confidence): supplied words on the times of observed ones, spread evenly where the counts
    differ. ``supplied``: array of strings; ``observed``: array of structs (text, start, end)."""
    n, m = F.size(supplied), F.size(observed)
    each = lines.where((n > 0) & (m > 0)).select(*keys, observed, n.alias("_n"), m.alias("_m"), F.posexplode(supplied).alias("word_idx", "text"))
    j = F.when(F.col("_n") == 1, F.lit(0)).otherwise(half_even(F.col("word_idx") * (F.col("_m") - 1) / (F.col("_n") - 1)))
    met = each.withColumn("_o", F.element_at(observed, (j + 1).cast("int")))
    ratio = rounded(T.indel_ratio(T.normal_token(F.col("text")), T.normal_token(F.col("_o.text"))), "ratio")
    return met.select(*keys, "word_idx", "text", F.col("_o.start").alias("start"), F.col("_o.end").alias("end"), ratio.alias("confidence"))


def interpolate_unanchored(lines: DataFrame, keys: Sequence[str], order: str = "line_idx") -> DataFrame:
    """Times for lines that found no anchor, from the anchored lines around them in file order: the start is the hint, or the end of
    the last anchored line (0 without one); the end is the next anchored start, at most 10 s on, or 4 s on where there is none."""
    w = Window.partitionBy(*keys).orderBy(order)
    back = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    before = F.coalesce(F.last(F.when(F.col("anchored"), F.col("end")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    after = F.last(F.when(F.col("anchored"), F.col("start")), ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, -1))
    held = lines.withColumn("_before", before).withColumn("_after", after)
    start = F.when(F.col("anchored"), F.col("start")).otherwise(F.coalesce("hint_seconds", "_before"))
    timed = held.withColumn("_start", start)
    end = F.when(F.col("anchored"), F.col("end")).when(F.col("_after") > F.col("_start"), F.least(F.col("_after"), F.col("_start") + 10)).otherwise(F.col("_start") + 4)
    return timed.withColumn("end", end).withColumn("start", F.col("_start")).drop("_before", "_after", "_start")


def ordered(lines: DataFrame, keys: Sequence[str], order: str = "line_idx") -> DataFrame:
    """``lines`` with place: by start, in file order where starts are equal."""
    return lines.withColumn("place", (F.row_number().over(Window.partitionBy(*keys).orderBy("start", order)) - 1).cast("long"))


# Anchoring: the cursor moves from line to line, so a track's lines go through one function in order.

LOOKAHEAD, HINT_BEFORE, HINT_AFTER = 400, 5.0, 20.0


def indel(a: str, b: str) -> float:
    """Normalised Indel similarity by bit-parallel longest common subsequence."""
    if a == b:
        return 1.0
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    mask = (1 << len(a)) - 1
    row = mask
    for c in b:
        u = row & places.get(c, 0)
        row = (row + u | row - u) & mask
    return 2.0 * (len(a) - row.bit_count()) / (len(a) + len(b))


def _halves_up(x: float) -> float:
    return math.floor(x * 1000 + 0.5) / 1000


def _sorted_text(words: list[str]) -> str:
    return " ".join(sorted(w for w in words if w))


def best_window(wanted: list[str], stream: list[str], starts: range) -> tuple[float, int, int]:
    """(score, start, end) of the window of the stream that is most like the wanted tokens, all compared sorted; of equal ones the
    first, and the shortest of those. (0, 0, 0) without windows.

    Two texts can't be more alike than their lengths allow, so windows are scored from the highest such bound down, and the
    search ends where the bound falls under the best score. A window of just these tokens can't be beaten and is looked for first;
    with blanks in the stream a longer one might start before it, so then it isn't.
    """
    target, same = _sorted_text(wanted), sorted(wanted)
    if "" not in stream[starts.start : starts.stop + len(wanted)]:
        for a in starts:
            if sorted(stream[a : a + len(wanted)]) == same:
                return 1.0, a, a + len(wanted)
    sizes = range(max(1, len(wanted) - 2), len(wanted) + 4)
    windows = []
    for a in starts:
        for b in (a + n for n in sizes if a + n <= len(stream)):
            text = _sorted_text(stream[a:b])
            total = len(target) + len(text)
            windows.append((2.0 * min(len(target), len(text)) / total if total else 1.0, a, b, text))
    windows.sort(key=lambda w: (-w[0], w[1], w[2]))
    best = (-1.0, 0, 0)  # score, then start and end negated, so that the largest is the one wanted
    for bound, a, b, text in windows:
        if bound < best[0]:
            break
        best = max(best, (indel(target, text), -a, -b))
    return (best[0], -best[1], -best[2]) if windows else (0.0, 0, 0)


def _starts(hint: float | None, cursor: int, times: list[float]) -> range:
    """Where a line may start: around its hint, or a stretch from the cursor on."""
    if hint is None:
        return range(cursor, min(len(times), cursor + LOOKAHEAD))
    near = [i for i, t in enumerate(times) if hint - HINT_BEFORE <= t <= hint + HINT_AFTER]
    return range(near[0], near[-1] + 1) if near else range(0)


def spread(n: int, m: int) -> list[int]:
    """For each of n places its counterpart among m, evenly, ties to even."""
    return [round(i * (m - 1) / (n - 1)) if n > 1 else 0 for i in range(n)]


def anchor_track(lines: list[dict], words: list[dict], least: float) -> list[dict]:
    """Lines in file order (tokens, normal, hint_seconds) on words in time order (normal, start, end). A line without a hint is looked
    for behind all that has been placed before it."""
    stream, times = [w["normal"] for w in words], [w["start"] for w in words]
    out, cursor = [], 0
    for line in lines:
        score, a, b = best_window(line["normal"], stream, _starts(line["hint_seconds"], cursor, times)) if line["normal"] else (0.0, 0, 0)
        if b == 0 or score < least:
            out.append({"start": None, "end": None, "anchored": False, "confidence": None, "words": [], "flags": ["low_confidence", "unaligned", "timing_interpolated"]})
            continue
        seen = [words[a + j] for j in spread(len(line["tokens"]), b - a)]
        alike = [_halves_up(indel(n, o["normal"])) for n, o in zip(line["normal"], seen, strict=True)]
        placed = [(t, o["start"], o["end"], c) for t, o, c in zip(line["tokens"], seen, alike, strict=True)]
        out.append({"start": words[a]["start"], "end": words[b - 1]["end"], "anchored": True, "confidence": _halves_up(sum(alike) / len(alike)), "words": placed, "flags": []})
        cursor = max(cursor, b)
    return out


WORDS = "array<struct<text:string,start:double,end:double,confidence:double>>"
PLACED = "line_idx long, text string, hint_seconds double, start double, end double, anchored boolean, confidence double, flags array<string>, w_text array<string>, w_start array<double>, w_end array<double>, w_confidence array<double>"


def anchor_lines(lines: DataFrame, words: DataFrame, key: str = "track_id", *, least: float = 0.6) -> DataFrame:
    """(key, line_idx, text, hint_seconds, start, end, anchored, confidence, flags, words) of supplied lines (key, line_idx, text,
    hint_seconds) placed on observed words (key, word_idx, text, start, end), with times for those that found no place.

    Tokens are brought to normal form by column functions; the search itself depends on where the line before it ended, so it is
    one grouped function per track. A track's lines and words are one group; tracks run in parallel, dealt out by number, as they
    are few bytes for the time they take. Words come back as one array for each field, which Arrow makes without a step per word.
    """
    key_type = dict(lines.dtypes)[key]
    tasks = many_tasks(lines.sparkSession)
    split = lines.select(key, F.col("line_idx").cast("long"), "text", F.col("hint_seconds").cast("double"), T.tokens(F.col("text")).alias("tokens"))
    left = split.withColumn("normal", F.transform("tokens", T.normal_token)).repartition(tasks, key)
    right = words.select(key, F.col("word_idx").cast("long"), F.col("start").cast("double"), F.col("end").cast("double"), T.normal_token(F.col("text")).alias("normal")).repartition(tasks, key)

    def run(supplied: pa.Table, observed: pa.Table) -> pa.Table:
        supplied, observed = supplied.sort_by("line_idx"), observed.sort_by("word_idx")
        rows = [
            {"tokens": t or [], "normal": m or [], "hint_seconds": None if h is None or math.isnan(h) else h}
            for t, m, h in zip(*(supplied[c].to_pylist() for c in ("tokens", "normal", "hint_seconds")), strict=True)
        ]
        times = (observed[c].to_numpy().tolist() for c in ("start", "end"))  # a time that is null is NaN
        seen = [{"normal": w, "start": s, "end": e} for w, s, e in zip(observed["normal"].to_pylist(), *times, strict=True)]
        placed = anchor_track(rows, seen, least)
        out = {key: supplied[key], "line_idx": supplied["line_idx"], "text": supplied["text"], "hint_seconds": pa.array([r["hint_seconds"] for r in rows], pa.float64())}
        out |= {c: pa.array([p[c] for p in placed], pa.float64(), from_pandas=True) for c in ("start", "end", "confidence")}
        out |= {"anchored": pa.array([p["anchored"] for p in placed], pa.bool_()), "flags": pa.array([p["flags"] for p in placed], pa.list_(pa.string()))}
        for j, (field, kind) in enumerate((("text", pa.string()), ("start", pa.float64()), ("end", pa.float64()), ("confidence", pa.float64()))):
            out[f"w_{field}"] = pa.array([[w[j] for w in p["words"]] for p in placed], pa.list_(kind))
        return pa.table(out)

    placed = left.groupBy(key).cogroup(right.groupBy(key)).applyInArrow(run, f"{key} {key_type}, {PLACED}")
    field = lambda c: F.col(f"w_{c}").alias(c)
    zipped = F.arrays_zip(field("text"), field("start"), field("end"), field("confidence"))
    placed = placed.select(key, "line_idx", "text", "hint_seconds", "start", "end", "anchored", "confidence", "flags", zipped.cast(WORDS).alias("words"))
    return interpolate_unanchored(placed, [key])


def repetition(lines: DataFrame, keys: Sequence[str], text: str = "text", least: int = 2) -> DataFrame:
    """(keys..., normal, n, first_idx): normal forms of lines that occur at least ``least`` times within their keys."""
    groups = lines.withColumn("normal", T.normal_line(F.col(text))).where("normal <> ''").groupBy(*keys, "normal").agg(F.count("*").alias("n"), F.min("line_idx").alias("first_idx"))
    return groups.where(F.col("n") >= least)


def _edits(size: Column, similar: float) -> Column:
    """The most edits d of a longer text of ``size`` for which 1 - d / size is at least ``similar``, in the arithmetic of that test."""
    about = F.floor((1 - similar) * size)
    return F.when(1 - (about + 1) / size >= similar, about + 1).when(1 - about / size >= similar, about).otherwise(about - 1).cast("int")


def _near_links(forms: DataFrame, keys: Sequence[str], similar: float, blocks: int = 16) -> DataFrame:
    """(keys..., a, b): links between forms (keys..., normal, first) by which the same forms are reached as by all near pairs.

    Where the longer form may differ by one edit, forms that are equal without the character at one place are all linked, so each
    meets the first of them, and a form one shorter meets them by its own text: rows in proportion to characters, no pairs. Where
    more edits are allowed, forms meet by length, in blocks of the longer side.
    """
    sized = forms.withColumn("size", F.length("normal")).withColumn("edits", _edits(F.col("size"), similar))
    lengths = sized.select(*keys, F.col("size").alias("long"), F.col("edits").alias("most")).where("most > 0").distinct()
    cut = sized.where("edits = 1").select(*keys, "first", "normal", F.explode(F.sequence(F.lit(1), "size")).alias("at"))
    cut = cut.select(*keys, "first", "at", F.expr("concat(substring(normal, 1, at - 1), substring(normal, at + 1))").alias("rest"))
    below = lengths.where("most = 1").select(*keys, (F.col("long") - 1).alias("size"))
    whole = sized.join(below, [*keys, "size"], "left_semi").select(*keys, "first", F.explode(F.sequence(F.lit(1), F.col("size") + 1)).alias("at"), F.col("normal").alias("rest"))
    least = F.min("first").over(Window.partitionBy(*keys, "at", "rest"))
    one = cut.unionByName(whole).withColumn("a", least).where("a <> first").select(*keys, "a", F.col("first").alias("b"))
    spread_out = int(forms.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shorter = sized.join(lengths.where("most > 1"), list(keys)).where("size <= long and long - size <= most")
    shorter = shorter.select(*keys, "long", "size", "first", "normal", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")).repartition(spread_out, *keys, "long", "block")
    longer = sized.where("edits > 1").select(*keys, F.col("size").alias("long"), "edits", F.col("first").alias("o_first"), F.col("normal").alias("o_normal"), F.pmod(F.hash("normal"), F.lit(blocks)).alias("block"))
    near = shorter.join(longer, [*keys, "long", "block"]).where("(size < long or first < o_first) and levenshtein(normal, o_normal, edits) >= 0")
    return one.unionByName(near.select(*keys, F.col("first").alias("a"), F.col("o_first").alias("b")))


def near_repetition(lines: DataFrame, keys: Sequence[str], text: str = "text", *, least: int = 2, similar: float = 0.8) -> DataFrame:
    """(keys..., line_idx, cluster, n) of the lines (keys..., line_idx) that recur, exactly or nearly, at least ``least`` times.

    Normal forms are linked when 1 - edits / longer length is at least ``similar``; cluster is the first line reachable over links,
    n the lines of the cluster. Equal forms are one from the start. The links of one key are joined in one task.
    """
    held = lines.select(*keys, "line_idx", T.normal_line(F.col(text)).alias("normal")).where("normal <> ''").dropna(subset=list(keys))
    forms = held.groupBy(*keys, "normal").agg(F.min("line_idx").cast("long").alias("first"), F.count("*").alias("c")).where("first is not null")
    kinds = ", ".join(f"{k} {dict(lines.dtypes)[k]}" for k in keys)

    def joined(key: tuple, links: pd.DataFrame) -> pd.DataFrame:
        label: dict[int, int] = {}

        def root(n: int) -> int:
            label.setdefault(n, n)
            while label[n] != n:
                label[n] = label[label[n]]
                n = label[n]
            return n

        for a, b in zip(links["a"].tolist(), links["b"].tolist(), strict=True):
            a, b = sorted((root(a), root(b)))
            label[b] = a
        found = pd.DataFrame({"first": list(label), "cluster": [root(n) for n in label]})
        return found.assign(**dict(zip(keys, key, strict=True)))[[*keys, "first", "cluster"]]

    labelled = _near_links(forms, keys, similar).groupBy(*keys).applyInPandas(joined, f"{kinds}, first long, cluster long")
    clusters = forms.join(labelled, [*keys, "first"], "left").select(*keys, "normal", F.coalesce("cluster", "first").alias("cluster"), "c")
    sizes = clusters.groupBy(*keys, "cluster").agg(F.sum("c").alias("n")).where(F.col("n") >= least)
    return held.join(clusters.drop("c"), [*keys, "normal"]).join(sizes, [*keys, "cluster"]).select(*keys, "line_idx", "cluster", "n")
