"""Uniform series and sorted events: (keys..., i, v) samples and (keys..., t) events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.rounding import rounded
from ..functions.scalars import decibels, strength


def many_tasks(spark: SparkSession) -> int:
    """Tasks for work that is long for its bytes: the shuffle's partitions, or three for each core where that is more."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism)


def indexed(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "i") -> DataFrame:
    """Place of each row within its key, from 0."""
    return df.withColumn(name, (F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1).cast("long"))


def uniform(events: DataFrame, keys: Sequence[str], t: str, v: str, hop: float, kind: str | int = "ratio") -> DataFrame:
    """(keys..., i, v): the sum of v in each hop from the first to the last event of a key; 0 where there is none."""
    binned = events.select(*keys, F.floor(F.col(t) / hop).cast("long").alias("_bin"), F.col(v).alias("_v")).groupBy(*keys, "_bin").agg(F.sum("_v").alias("_v"))
    spine = binned.groupBy(*keys).agg(F.min("_bin").alias("_first"), F.max("_bin").alias("_last")).select(*keys, "_first", F.explode(F.sequence("_first", "_last")).alias("_bin"))
    joined = spine.join(binned, [*keys, "_bin"], "left")
    return joined.select(*keys, (F.col("_bin") - F.col("_first")).alias("i"), rounded(F.coalesce("_v", F.lit(0.0)), kind).alias("v"))


def packed(series: DataFrame, keys: Sequence[str], unit: str, start: float, hop: float, kind: str | int) -> DataFrame:
    """(keys..., series struct<unit,start_seconds,hop_seconds,values>): the document form of a series, values in order and rounded."""
    values = F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: rounded(x["v"], kind))
    return series.groupBy(*keys).agg(F.struct(F.lit(unit).alias("unit"), F.lit(start).alias("start_seconds"), F.lit(hop).alias("hop_seconds"), values.alias("values")).alias("series"))


def unpacked(df: DataFrame, keys: Sequence[str], column: str = "series") -> DataFrame:
    """(keys..., i, t, v) from the document form."""
    out = df.select(*keys, F.col(column)["start_seconds"].alias("_start"), F.col(column)["hop_seconds"].alias("_hop"), F.posexplode(F.col(column)["values"]).alias("i", "v"))
    return out.select(*keys, F.col("i").cast("long").alias("i"), (F.col("_start") + F.col("i") * F.col("_hop")).alias("t"), "v")


def sliding_rms(samples: DataFrame, keys: Sequence[str], frame: int, hop: int) -> DataFrame:
    """(keys..., frame, rms, db): root mean square of centred frames, one for each ``hop`` samples; frames are cut at the ends."""
    w = Window.partitionBy(*keys).orderBy("i").rowsBetween(-(frame // 2), frame - frame // 2 - 1)
    framed = samples.withColumn("rms", F.sqrt(F.avg(F.col("v") * F.col("v")).over(w))).where(F.col("i") % hop == 0)
    return framed.select(*keys, F.floor(F.col("i") / hop).alias("frame"), "rms", decibels(F.col("rms")).alias("db"))


def hold_last(series: DataFrame, keys: Sequence[str], *, i: str = "i", v: str = "v") -> DataFrame:
    """Nulls take the last value before them, those at the head the first value, and 0 where a key has none."""
    w = Window.partitionBy(*keys).orderBy(i)
    last = F.last(v, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    first = F.first(v, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return series.withColumn(v, F.coalesce(last, first, F.lit(0.0)))


def sample_linear(series: DataFrame, points: DataFrame, keys: Sequence[str], *, start: float = 0.0, hop: float = 1.0, at: str = "t") -> DataFrame:
    """``points`` with v: linear between neighbouring samples, the end values beyond them; null for keys without samples."""
    w = Window.partitionBy(*keys).orderBy("i")
    pairs = series.select(*keys, F.col("i").alias("_i"), F.col("v").alias("_v"), F.lead("v").over(w).alias("_next"))
    limits = series.groupBy(*keys).agg(F.min("i").alias("_low"), F.max("i").alias("_high"))
    place = (F.col(at) - start) / hop
    placed = points.join(limits, list(keys), "left").withColumn("_at", F.greatest(F.col("_low").cast("double"), F.least(F.col("_high").cast("double"), place))).withColumn("_i", F.floor("_at"))
    value = F.col("_v") + (F.col("_at") - F.col("_i")) * F.coalesce(F.col("_next") - F.col("_v"), F.lit(0.0))
    return placed.join(pairs, [*keys, "_i"], "left").withColumn("v", value).drop("_i", "_at", "_low", "_high", "_v", "_next")


def strength_reference(values: DataFrame, keys: Sequence[str], v: str = "v", share: float = 0.98) -> DataFrame:
    """(keys..., reference): exact percentile with linear interpolation, rounded as a ratio, at least 0.001; 1 without values."""
    top = F.percentile(v, share)
    return values.groupBy(*keys).agg(F.when(F.count(v) == 0, F.lit(1.0)).otherwise(F.greatest(rounded(top, "ratio"), F.lit(0.001))).alias("reference"))


def event_strengths(events: DataFrame, envelope: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Events (keys..., i) with the envelope's value at their place as a strength in 0..1 of the envelope's reference."""
    reference = strength_reference(envelope, keys)
    joined = events.join(envelope.select(*keys, "i", "v"), [*keys, "i"]).join(reference, list(keys))
    return joined.withColumn("strength", rounded(strength(F.col("v"), F.col("reference")), "ratio")).drop("v")


def regularity(events: DataFrame, keys: Sequence[str], t: str = "t") -> DataFrame:
    """(keys..., cv, confidence): population deviation over mean of the gaps between events; 1 - 4 cv within 0..1, 0 under 3 events."""
    gaps = events.select(*keys, (F.lead(t).over(Window.partitionBy(*keys).orderBy(t)) - F.col(t)).alias("_gap"))
    stats = gaps.groupBy(*keys).agg(F.count("*").alias("_n"), (F.stddev_pop("_gap") / F.greatest(F.avg("_gap"), F.lit(1e-9))).alias("cv"))
    confidence = F.when(F.col("_n") < 3, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - 4 * F.col("cv"))))
    return stats.select(*keys, F.when(F.col("_n") >= 3, rounded("cv", "ratio")).alias("cv"), rounded(confidence, "ratio").alias("confidence"))


def local_peak(envelope: DataFrame, keys: Sequence[str], reach: int) -> DataFrame:
    """``envelope`` with peak: the largest value within ``reach`` samples on either side."""
    return envelope.withColumn("peak", F.max("v").over(Window.partitionBy(*keys).orderBy("i").rowsBetween(-reach, reach)))


def phase_fit(beats: DataFrame, keys: Sequence[str], beats_per_bar: int = 4) -> DataFrame:
    """(keys..., downbeat_offset) from beats (keys..., beat, v): the phase whose beats are strongest on average, the lowest of equal
    ones; 0 where there are fewer beats than phases."""
    means = beats.groupBy(*keys, (F.col("beat") % beats_per_bar).alias("_phase")).agg(F.avg("v").alias("_mean"), F.count("*").alias("_n"))
    best = means.groupBy(*keys).agg(F.max_by("_phase", F.struct("_mean", -F.col("_phase"))).alias("_best"), F.sum("_n").alias("_n"))
    return best.select(*keys, F.when(F.col("_n") < beats_per_bar, F.lit(0)).otherwise(F.col("_best")).cast("long").alias("downbeat_offset"))


def nearest(points: DataFrame, events: DataFrame, keys: Sequence[str], *, at: str = "t", t: str = "t", index: str = "i") -> DataFrame:
    """``points`` with nearest_index and offset (point less event) of the closest event of the same keys; ties go to the earlier one.

    Both sides go through one window in time order: the last event before and the first after each point, no range join.
    """
    extra = [c for c in points.columns if c not in keys]
    both = points.select(*keys, F.col(at).cast("double").alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast("struct<t:double,i:long>").alias("_e"), F.struct(*extra).alias("_p")).unionByName(
        events.select(*keys, F.col(t).cast("double").alias("_t"), F.lit(0).alias("_side"), F.struct(F.col(t).cast("double").alias("t"), F.col(index).cast("long").alias("i")).alias("_e")), allowMissingColumns=True
    )
    w = Window.partitionBy(*keys).orderBy("_t", "_side", F.col("_e.i"))
    before = F.last("_e", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    # Backwards in time as well, so that both frames grow by one row at a time.
    back = Window.partitionBy(*keys).orderBy(F.col("_t").desc(), F.col("_side").desc(), F.col("_e.i").desc())
    after = F.last("_e", ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, 0))
    held = both.select(*keys, "_t", "_side", "_p", before.alias("_before"), after.alias("_after")).where("_side = 1")
    first = F.col("_before").isNotNull() & (F.col("_after").isNull() | (F.col("_t") - F.col("_before.t") <= F.col("_after.t") - F.col("_t")))
    chosen = F.when(first, F.col("_before")).otherwise(F.col("_after"))
    return held.select(*keys, "_p.*", chosen["i"].alias("nearest_index"), (F.col("_t") - chosen["t"]).alias("offset"))


def snapped(boundaries: DataFrame, beats: DataFrame, offsets: DataFrame, keys: Sequence[str], *, beats_per_bar: int = 4, at: str = "t") -> DataFrame:
    """``boundaries`` with downbeat_index, snapped and offset: the closest downbeat of the same keys, the earlier of two equally close
    ones; null where a key has none. ``beats``: (keys..., i, t); ``offsets``: (keys..., downbeat_offset), the phase of downbeats."""
    down = beats.join(offsets, list(keys)).where(F.pmod(F.col("i") - F.col("downbeat_offset"), F.lit(beats_per_bar)) == 0).select(*keys, "i", "t")
    met = nearest(boundaries, down, keys, at=at)
    return met.withColumnRenamed("nearest_index", "downbeat_index").withColumn("snapped", F.col(at) - F.col("offset"))


def occurrence(df: DataFrame, keys: Sequence[str], label: str, order: Sequence[str]) -> DataFrame:
    """Running number of each label within its keys, from 1."""
    return df.withColumn("occurrence", F.row_number().over(Window.partitionBy(*keys, label).orderBy(*order)).cast("long"))


def mixdown(samples: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys..., i, v): mean over channels."""
    return samples.groupBy(*keys, "i").agg(F.avg("v").alias("v"))


def loud_share(series: Column, start: Column, end: Column, hop: Column, level: float) -> Column:
    """Share of the samples from ``int(start / hop)`` to ``int(end / hop)``, both included, that lie above ``level``; 0 for none."""
    low, high = F.greatest(F.lit(0), (start / hop).cast("int")), F.greatest(F.lit(0), (end / hop).cast("int"))
    span = F.slice(series, low + 1, F.greatest(F.lit(0), high - low + 1))
    return F.when(F.size(span) > 0, F.size(F.filter(span, lambda v: v > level)) / F.size(span)).otherwise(0.0)
