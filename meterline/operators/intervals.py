"""Interval algebra on one timeline: half-open intervals (keys..., start, end), sorted samples (keys..., i, v).

Everything is a window function or an equi-join on the keys; where two sides meet by range, both are put into time buckets, so
the join stays a hash or merge join and a long track is spread over many rows of the join key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _ordered(keys: Sequence[str], *order: str):
    return Window.partitionBy(*keys).orderBy(*order)


def number_islands(df: DataFrame, keys: Sequence[str], order: Sequence[str], opens: Column, name: str) -> DataFrame:
    """Column ``name``: running count of rows for which ``opens`` holds, per key."""
    flagged = df.withColumn("_opens", F.coalesce(opens, F.lit(True)).cast("int"))
    return flagged.withColumn(name, F.sum("_opens").over(_ordered(keys, *order).rowsBetween(Window.unboundedPreceding, 0))).drop("_opens")


def hysteresis(series: DataFrame, keys: Sequence[str], enter: float, exit: float, *, i: str = "i", v: str = "v") -> DataFrame:
    """(keys..., start, end): open at v >= enter, close at the first later v < exit, at the end of the series otherwise.

    Each sample is a signal to open, to close or none; the state is the last signal. That needs exit <= enter. Places ``i`` count
    from 0 without holes; a null value is no signal.
    """
    if exit > enter:
        raise ValueError(f"exit level {exit} lies above the enter level {enter}")
    signal = F.when(F.col(v) >= enter, 1).when(F.col(v) < exit, 0)
    w = _ordered(keys, i)
    state = series.withColumn("_on", F.coalesce(F.last(signal, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)))
    runs = state.where("_on = 1").withColumn("_run", F.col(i) - F.row_number().over(w))
    return runs.groupBy(*keys, "_run").agg(F.min(i).alias("start"), (F.max(i) + 1).alias("end")).drop("_run")


def merge_gaps(spans: DataFrame, keys: Sequence[str], max_gap) -> DataFrame:
    """Join a span to the one before it where the gap is smaller than ``max_gap``; spans are disjoint."""
    gap = F.col("start") - F.lag("end").over(_ordered(keys, "start"))
    grouped = number_islands(spans, keys, ["start"], ~(gap < max_gap), "_island")
    return grouped.groupBy(*keys, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_island")


def at_least(spans: DataFrame, length) -> DataFrame:
    return spans.where(F.col("end") - F.col("start") >= length)


def union(spans: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Merged spans; those that touch are one."""
    reach = F.max("end").over(_ordered(keys, "start", "end").rowsBetween(Window.unboundedPreceding, -1))
    grouped = number_islands(spans, keys, ["start", "end"], ~(F.col("start") <= reach), "_island")
    return grouped.groupBy(*keys, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_island")


def padded(spans: DataFrame, keys: Sequence[str], pad: float) -> DataFrame:
    """Spans widened by ``pad`` on both sides, cut at 0 and merged."""
    if pad < 0:
        raise ValueError("padding must not be negative")
    wide = spans.select(*keys, F.greatest(F.lit(0.0), F.col("start") - pad).alias("start"), (F.col("end") + pad).alias("end"))
    return union(wide, keys)


def budgeted_prefix(spans: DataFrame, keys: Sequence[str], budget: float) -> DataFrame:
    """The earliest spans with ``budget`` in all; the last one is cut short."""
    before = F.coalesce(F.sum(F.col("end") - F.col("start")).over(_ordered(keys, "start", "end").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    taken = spans.withColumn("_take", F.least(F.col("end") - F.col("start"), budget - before)).where("_take > 0")
    return taken.select(*keys, "start", (F.col("start") + F.col("_take")).alias("end"))


def _bucketed(df: DataFrame, start: Column, end: Column, width: float, name: str) -> DataFrame:
    low, high = F.floor(start / width), F.floor(end / width)
    return df.withColumn(name, F.explode(F.sequence(low, F.greatest(low, high))))


def samples_in_spans(samples: DataFrame, spans: DataFrame, keys: Sequence[str], at: str, *, width: float, how: str = "inner") -> DataFrame:
    """Rows of ``samples`` whose ``at`` lies in [start, end) of a row of ``spans`` with the same keys, beside that row. Columns other
    than the keys must differ. A left join keeps samples in no span."""
    left = samples.withColumn("_bucket", F.floor(F.col(at) / width))
    right = _bucketed(spans, F.col("start"), F.col("end"), width, "_b").withColumnsRenamed({k: f"_{k}" for k in keys})
    on = [F.col(k) == F.col(f"_{k}") for k in keys]
    joined = left.join(right, [*on, F.col("_bucket") == F.col("_b"), F.col(at) >= F.col("start"), F.col(at) < F.col("end")], how)
    return joined.drop("_bucket", "_b", *[f"_{k}" for k in keys])


def overlapping(left: DataFrame, right: DataFrame, keys: Sequence[str], *, width: float) -> DataFrame:
    """(keys..., start, end, r_start, r_end) for all strictly overlapping pairs, each once: in the bucket where the overlap starts."""
    a = _bucketed(left.select(*keys, "start", "end"), F.col("start"), F.col("end"), width, "_bucket")
    b = _bucketed(right.select(*keys, F.col("start").alias("r_start"), F.col("end").alias("r_end")), F.col("r_start"), F.col("r_end"), width, "_bucket")
    joined = a.join(b, [*keys, "_bucket"]).where("least(end, r_end) > greatest(start, r_start)")
    return joined.where(F.floor(F.greatest("start", "r_start") / width) == F.col("_bucket")).drop("_bucket")


def outside(spans: DataFrame, regions: DataFrame, keys: Sequence[str], *, width: float) -> DataFrame:
    """The rows of ``spans`` that strictly overlap no region; all of them where there are no regions."""
    inside = overlapping(spans, regions, keys, width=width).select(*keys, "start", "end").distinct()
    return spans.join(inside, [*keys, "start", "end"], "left_anti")


def subtract(regions: DataFrame, covers: DataFrame, keys: Sequence[str], min_length: float, *, width: float) -> DataFrame:
    """(keys..., start, end): what of each region no cover reaches. A region without any cover comes out whole, whatever its length;
    otherwise pieces shorter than ``min_length`` are left out. A cover of no length inside a region splits it. Regions have a
    positive length and, within a key, distinct starts."""
    merged = union(covers, keys)
    a = _bucketed(regions.select(*keys, "start", "end"), F.col("start"), F.col("end"), width, "_bucket")
    b = _bucketed(merged.select(*keys, F.col("start").alias("s"), F.col("end").alias("e")), F.col("s"), F.col("e"), width, "_bucket")
    pairs = a.join(b, [*keys, "_bucket"]).where("e > start and s < end").select(*keys, "start", "end", "s", "e").distinct()
    held = regions.select(*keys, "start", "end").join(pairs, [*keys, "start", "end"], "left")
    w = _ordered([*keys, "start"], "s")
    gaps = held.select(
        *keys,
        F.col("start").alias("r0"),
        F.col("end").alias("r1"),
        "s",
        "e",
        F.coalesce(F.lag("e").over(w), F.col("start")).alias("before"),
        F.lead("s").over(w).alias("next"),
    )
    piece = lambda start, end, whole: F.struct(start.cast("double").alias("start"), end.cast("double").alias("end"), F.lit(whole).alias("whole"))
    found = F.array_compact(
        F.array(
            F.when(F.col("s").isNull(), piece(F.col("r0"), F.col("r1"), True)),
            F.when(F.col("s") > F.col("before"), piece(F.col("before"), F.col("s"), False)),
            F.when(F.col("s").isNotNull() & F.col("next").isNull() & (F.col("e") < F.col("r1")), piece(F.col("e"), F.col("r1"), False)),
        )
    )
    return gaps.select(*keys, F.inline(found)).where(F.col("whole") | (F.col("end") - F.col("start") >= min_length)).drop("whole")


def coverage(regions: DataFrame, covers: DataFrame, keys: Sequence[str], *, width: float) -> DataFrame:
    """(keys..., covered_ratio) per key of ``regions``: length covered over length, at most 1."""
    met = overlapping(regions, union(covers, keys), keys, width=width)
    covered = met.groupBy(*keys).agg(F.sum(F.least("end", "r_end") - F.greatest("start", "r_start")).alias("_covered"))
    total = regions.groupBy(*keys).agg(F.sum(F.col("end") - F.col("start")).alias("_total"))
    ratio = F.when(F.col("_total") > 0, F.least(F.lit(1.0), F.coalesce("_covered", F.lit(0.0)) / F.col("_total"))).otherwise(1.0)
    return total.join(covered, list(keys), "left").select(*keys, ratio.alias("covered_ratio"))


def share_above(series: DataFrame, spans: DataFrame, keys: Sequence[str], *, hop: float, level: float, width: float) -> DataFrame:
    """``spans`` (keys..., start, end) with share: of the samples (keys..., i, v) from int(start / hop) to int(end / hop), both
    included, the part above ``level``; 0 where there are none. A range join by buckets of ``width`` samples."""
    place = lambda c: F.greatest(F.lit(0), (F.col(c) / hop).cast("long"))
    placed = spans.select(*keys, F.col("start").alias("_from"), F.col("end").alias("_to"), place("start").alias("start"), (place("end") + 1).alias("end")).distinct()
    met = samples_in_spans(series.select(*keys, F.col("i").alias("_i"), F.col("v").alias("_v")), placed, keys, "_i", width=width)
    counts = met.groupBy(*keys, F.col("_from").alias("start"), F.col("_to").alias("end")).agg((F.count_if(F.col("_v") > level) / F.count("*")).alias("share"))
    return spans.join(counts, [*keys, "start", "end"], "left").withColumn("share", F.coalesce("share", F.lit(0.0)))


def activity_regions(series: DataFrame, keys: Sequence[str], *, enter: float, exit: float, max_gap: int, min_length: int, i: str = "i", v: str = "v", width: float = 1024) -> DataFrame:
    """(keys..., start, end, mean): hysteresis spans, merged over short gaps, of a minimum length, with the mean of all their samples."""
    spans = at_least(merge_gaps(hysteresis(series, keys, enter, exit, i=i, v=v), keys, max_gap), min_length)
    inside = samples_in_spans(series.select(*keys, F.col(i).alias("_i"), F.col(v).alias("_v")), spans, keys, "_i", width=width)
    return inside.groupBy(*keys, "start", "end").agg(F.avg("_v").alias("mean"))
