"""Partitions of a frame timeline: detection, repair, checks, representative frames, motion and palettes."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rounding import half_even, rounded
from ..functions.scalars import rgb_hex
from . import intervals

LONG_SHOT = 4.0


def cuts_from_deltas(frames: DataFrame, keys: Sequence[str], threshold: float, min_frames: int) -> DataFrame:
    """(keys..., frame) where the content changes: frames (keys..., frame, h, s, v means) whose mean absolute difference from the frame
    before reaches ``threshold``; a cut closer than ``min_frames`` to the one before it is passed over, from the start on.

    Deltas come from a window; only the frames over the threshold, a few per track, go through the sequential rule.
    """
    w = Window.partitionBy(*keys).orderBy("frame")
    delta = sum((F.abs(F.col(c) - F.lag(c).over(w)) for c in ("h", "s", "v")), F.lit(0.0)) / 3
    over = frames.withColumn("_delta", delta).where(F.col("_delta") >= threshold)
    kept = F.aggregate(
        F.array_sort(F.collect_list(F.col("frame").cast("long"))),
        F.expr("cast(array() as array<bigint>)"),
        lambda done, f: F.when(f - F.when(F.size(done) > 0, F.try_element_at(done, F.lit(-1))).otherwise(F.lit(0)) >= min_frames, F.concat(done, F.array(f))).otherwise(done),
    )
    return over.groupBy(*keys).agg(kept.alias("_cuts")).select(*keys, F.explode("_cuts").alias("frame"))


def from_cuts(tracks: DataFrame, cuts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys..., start_frame, end_frame) from tracks (keys..., frame_count): a partition at the cuts, one shot where there are none."""
    starts = tracks.select(*keys, F.lit(0).cast("long").alias("start_frame")).unionByName(cuts.select(*keys, F.col("frame").cast("long").alias("start_frame")).where("start_frame > 0")).distinct()
    ends = F.lead("start_frame").over(Window.partitionBy(*keys).orderBy("start_frame"))
    return starts.join(tracks.select(*keys, "frame_count"), list(keys)).where("start_frame < frame_count").select(*keys, "start_frame", F.coalesce(ends, F.col("frame_count")).cast("long").alias("end_frame"))


def covering(tracks: DataFrame, scenes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Scenes (keys..., start_frame, end_frame) made to cover [0, frame_count): the first starts at 0, the last ends at the end if
    it fell short, and a track without scenes is one shot."""
    w = Window.partitionBy(*keys)
    numbered = tracks.join(scenes, list(keys), "left").withColumn("_first", F.min("start_frame").over(w)).withColumn("_last", F.max("start_frame").over(w))
    start = F.when(F.col("start_frame").isNull() | (F.col("start_frame") == F.col("_first")), F.lit(0)).otherwise(F.col("start_frame"))
    end = F.when(F.col("end_frame").isNull(), F.col("frame_count")).when((F.col("start_frame") == F.col("_last")) & (F.col("end_frame") < F.col("frame_count")), F.col("frame_count")).otherwise(F.col("end_frame"))
    return numbered.select(*keys, start.cast("long").alias("start_frame"), end.cast("long").alias("end_frame"))


def partition(shots: DataFrame, keys: Sequence[str], fps: Column) -> DataFrame:
    """(keys..., idx, start_frame, end_frame, start, end) in order, times rounded; an empty shot, a gap or an overlap is an error."""
    w = Window.partitionBy(*keys).orderBy("start_frame", "end_frame")
    previous = F.lag("end_frame").over(w)
    fault = F.when(previous != F.col("start_frame"), F.concat(F.lit("shots have a gap or overlap at frame "), F.col("start_frame"))).when(
        F.col("end_frame") <= F.col("start_frame"), F.concat(F.lit("empty shot at frame "), F.col("start_frame"))
    )
    checked = shots.withColumn("_fault", fault).withColumn("idx", (F.row_number().over(w) - 1).cast("long"))
    start = F.when(F.col("_fault").isNotNull(), F.raise_error(F.col("_fault")).cast("double")).otherwise(rounded(F.col("start_frame") / fps, "seconds"))
    return checked.select(*keys, "idx", "start_frame", "end_frame", start.alias("start"), rounded(F.col("end_frame") / fps, "seconds").alias("end"))


def representative_times(start: Column, end: Column) -> Column:
    """The middle of a short shot, the thirds of one of at least LONG_SHOT seconds."""
    length = end - start
    return F.when(length < LONG_SHOT, F.array(start + length / 2)).otherwise(F.array(start + length / 3, start + 2 * length / 3))


def frame_plan(shots: DataFrame, keys: Sequence[str], fps: Column) -> DataFrame:
    """(keys..., idx, place, time, frame, name): the frames that stand for each shot."""
    each = shots.select(*keys, "idx", "end_frame", fps.alias("_fps"), F.posexplode(representative_times(F.col("start"), F.col("end"))).alias("place", "time"))
    frame = F.least(half_even(F.col("time") * F.col("_fps")), F.col("end_frame") - 1)
    return each.select(*keys, "idx", "place", "time", frame.alias("frame"), F.format_string("shot_%04d_f%d.jpg", "idx", "place").alias("name"))


def planned_frames(frames: DataFrame, plan: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The decoded frames that the plan names, each once."""
    return frames.join(plan.select(*keys, "frame").distinct(), [*keys, "frame"], "left_semi")


def motion(shots: DataFrame, pairs: DataFrame, keys: Sequence[str], *, width: float = 16.0) -> DataFrame:
    """(keys..., idx, mean, p95) of pair values (keys..., t, value) with start <= t < end; 0 and 0 for a shot without any."""
    inside = intervals.samples_in_spans(pairs.select(*keys, "t", "value"), shots.select(*keys, "idx", "start", "end"), keys, "t", width=width)
    stats = inside.groupBy(*keys, "idx").agg(F.avg("value").alias("_m"), F.percentile("value", 0.95).alias("_p"))
    joined = shots.select(*keys, "idx").join(stats, [*keys, "idx"], "left")
    return joined.select(*keys, "idx", rounded(F.coalesce("_m", F.lit(0.0)), "ratio").alias("mean"), rounded(F.coalesce("_p", F.lit(0.0)), "ratio").alias("p95"))


def swatches(labelled: DataFrame, keys: Sequence[str], centre: str = "centre") -> DataFrame:
    """(keys..., palette): proportion of each centre's members, largest first, equal ones by name."""
    counts = labelled.groupBy(*keys, centre).agg(F.count("*").alias("_n"))
    total = F.sum("_n").over(Window.partitionBy(*keys))
    shares = counts.withColumn("proportion", rounded(F.col("_n") / total, "ratio"))
    order = F.array_sort(F.collect_list(F.struct((-F.col("proportion")).alias("k"), F.col(centre).alias("hex"))))
    return shares.groupBy(*keys).agg(F.transform(order, lambda s: F.struct(s["hex"].alias("hex"), (-s["k"]).alias("proportion"))).alias("palette"))


def nearest_centre(points: Column, centres: list[tuple[str, list[float]]]) -> Column:
    """Name of the closest of a few fixed centres by squared distance, the first of equal ones."""
    distances = [
        F.struct(F.aggregate(F.zip_with(points, F.array(*map(F.lit, c)), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, d: s + d).alias("d"), F.lit(i).alias("i"), F.lit(name).alias("name"))
        for i, (name, c) in enumerate(centres)
    ]
    return F.array_min(F.array(*distances))["name"]


# Palettes: a few hundred pixels per shot, so clustering is one grouped function per shot.


def _to_lab(rgb: np.ndarray) -> np.ndarray:
    x = rgb / 255.0
    x = np.where(x > 0.04045, ((x + 0.055) / 1.055) ** 2.4, x / 12.92) @ np.array([[0.4124564, 0.2126729, 0.0193339], [0.3575761, 0.7151522, 0.1191920], [0.1804375, 0.0721750, 0.9503041]])
    x = x / np.array([0.95047, 1.0, 1.08883])
    f = np.where(x > 216 / 24389, np.cbrt(x), (24389 / 27 * x + 16) / 116)
    return np.stack([116 * f[:, 1] - 16, 500 * (f[:, 0] - f[:, 1]), 200 * (f[:, 1] - f[:, 2])], axis=1)


def _to_rgb(lab: np.ndarray) -> np.ndarray:
    y = (lab[:, 0] + 16) / 116
    f = np.stack([y + lab[:, 1] / 500, y, y - lab[:, 2] / 200], axis=1)
    x = np.where(f**3 > 216 / 24389, f**3, (116 * f - 16) * 27 / 24389) * np.array([0.95047, 1.0, 1.08883])
    x = x @ np.linalg.inv(np.array([[0.4124564, 0.2126729, 0.0193339], [0.3575761, 0.7151522, 0.1191920], [0.1804375, 0.0721750, 0.9503041]]))
    x = np.where(x > 0.0031308, 1.055 * np.clip(x, 0, None) ** (1 / 2.4) - 0.055, 12.92 * x)
    return np.clip(np.round(x * 255), 0, 255).astype(int)


def cluster_colours(rgb: np.ndarray, k: int = 5, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """(centres as RGB, label of each pixel): Lloyd's iterations in Lab from farthest-first starts, at most as many as colours."""
    lab = _to_lab(rgb.astype(float))
    k = min(k, len(np.unique(rgb, axis=0)))
    centres = [lab[np.argmin(((lab - lab.mean(axis=0)) ** 2).sum(axis=1))]]
    while len(centres) < k:
        centres.append(lab[np.argmax(np.min([((lab - c) ** 2).sum(axis=1) for c in centres], axis=0))])
    at = np.array(centres)
    for _ in range(rounds):
        label = np.argmin(((lab[:, None] - at[None]) ** 2).sum(axis=2), axis=1)
        new = np.stack([lab[label == j].mean(axis=0) if (label == j).any() else at[j] for j in range(k)])
        if np.allclose(new, at):
            break
        at = new
    return _to_rgb(at), np.argmin(((lab[:, None] - at[None]) ** 2).sum(axis=2), axis=1)


def palettes(pixels: DataFrame, keys: Sequence[str], k: int = 5) -> DataFrame:
    """(keys..., palette) from pixels (keys..., r, g, b), whole frames pooled per shot."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        rgb = part[["r", "g", "b"]].to_numpy()
        order = np.lexsort(rgb.T[::-1])
        centres, label = cluster_colours(rgb[order], k)
        return part.iloc[order][list(keys)].assign(r=centres[label, 0], g=centres[label, 1], b=centres[label, 2])

    kinds = dict(pixels.dtypes)
    placed = pixels.groupBy(*keys).applyInPandas(run, ", ".join([*(f"{c} {kinds[c]}" for c in keys), "r int", "g int", "b int"]))
    return swatches(placed.withColumn("centre", rgb_hex(F.col("r"), F.col("g"), F.col("b"))), keys)


def cuts_per_section(cuts: DataFrame, sections: DataFrame, keys: Sequence[str], *, beats_per_bar: int = 4, on_beat: float = 0.07, width: float = 64.0) -> DataFrame:
    """(keys..., section, n_cuts, cuts_per_bar, on_beat_ratio): cuts (keys..., t, offset to the nearest beat) in sections
    (keys..., section, start, end, n_beats)."""
    inside = intervals.samples_in_spans(cuts.select(*keys, "t", "offset"), sections.select(*keys, "section", "start", "end"), keys, "t", width=width)
    stats = inside.groupBy(*keys, "section").agg(F.count("*").alias("_n"), F.avg((F.abs("offset") <= on_beat).cast("double")).alias("_share"))
    joined = sections.join(stats, [*keys, "section"], "left")
    bars = F.col("n_beats") / beats_per_bar
    n = F.coalesce("_n", F.lit(0)).cast("long")
    return joined.select(*keys, "section", n.alias("n_cuts"), rounded(F.coalesce(F.try_divide(n.cast("double"), bars), F.lit(0.0)), "ratio").alias("cuts_per_bar"), rounded(F.coalesce("_share", F.lit(0.0)), "ratio").alias("on_beat_ratio"))
