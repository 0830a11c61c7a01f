"""Every query by name, with the SQL it is compared with. Tables are read whole."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import text as T
from ..functions.rounding import rounded, rounded_sql
from ..operators import intervals, kernels, ledger, lines, series, shots
from ..sources import documents, media
from . import config, schemas

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Events of a user are a series by place in time; seconds are counted from 2024-01-01.

def _series(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type", F.col("value").alias("v"))
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 - 1704067200.0
    return series.indexed(e.withColumn("t", seconds), ["user_id"], ["ts", "event_id"])


_E = "e as (select user_id, event_id, ts, event_type, value v, epoch_us(ts) / 1e6::double - 1704067200.0::double t, row_number() over (partition by user_id order by ts, event_id) - 1 i from events)"

ENTER, EXIT, GAP, LEAST = 100.0, 30.0, 2, 2

_REGIONS = f"""{_E},
sig as (select *, case when v >= {ENTER} then 1 when v < {EXIT} then 0 end s from e),
st as (select *, coalesce(last_value(s ignore nulls) over (partition by user_id order by i rows unbounded preceding), 0) st from sig),
runs as (select user_id, i - row_number() over (partition by user_id order by i) g, i from st where st = 1),
spans as (select user_id, min(i) s, max(i) + 1 e from runs group by user_id, g),
isl as (select *, sum(case when s - pe < {GAP} then 0 else 1 end) over (partition by user_id order by s rows unbounded preceding) g from (select *, lag(e) over (partition by user_id order by s) pe from spans)),
merged as (select user_id, min(s) s, max(e) e from isl group by user_id, g having max(e) - min(s) >= {LEAST})"""


def _regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _series(spark, sf_dir).select("user_id", "i", "v")
    return intervals.activity_regions(s, ["user_id"], enter=ENTER, exit=EXIT, max_gap=GAP, min_length=LEAST)


@query(f"with {_REGIONS} select m.user_id, m.s::bigint start_i, m.e::bigint end_i, row_number() over (partition by m.user_id order by m.s) - 1 region_idx, {rounded_sql('avg(v)', 'db')} mean_value from merged m join e on e.user_id = m.user_id and e.i >= m.s and e.i < m.e group by m.user_id, m.s, m.e")
def activity_regions(spark, sf_dir):
    found = series.indexed(_regions(spark, sf_dir), ["user_id"], ["start"], "region_idx")
    return found.select("user_id", "region_idx", F.col("start").alias("start_i"), F.col("end").alias("end_i"), rounded("mean", "db").alias("mean_value"))


@query("select doc_id, sha256(text) sha256, substr(sha256(text), 1, 16) track_id from documents")
def content_identity(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", S.content_sha256("text").alias("sha256"), S.track_id("text").alias("track_id"))


@query("select sha256(text) sha256, count(*) n, min(doc_id) first_doc from documents group by 1 having count(*) > 1")
def duplicate_content(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(S.content_sha256("text").alias("sha256")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).where("n > 1")


@query(f"""with {_E}, b as (select event_type, floor(t / 3600)::bigint b, sum(v) v from e group by 1, 2), l as (select event_type, min(b) lo, max(b) hi from b group by 1),
s as (select event_type, lo, unnest(range(lo, hi + 1)) b from l) select s.event_type, (s.b - s.lo)::bigint i, {rounded_sql('coalesce(b.v, 0)', 'ratio')} v from s left join b on s.event_type = b.event_type and s.b = b.b""")
def uniform_series(spark, sf_dir):
    return series.uniform(_series(spark, sf_dir), ["event_type"], "t", "v", 3600.0)


@query(f"""with {_E}, b as (select event_type, floor(t / 3600)::bigint b, sum(v) v from e group by 1, 2) select event_type, 3600.0::double hop_seconds, (max(b) - min(b) + 1)::bigint n, {rounded_sql('sum(v)', 'db')} total from b group by 1""")
def series_document(spark, sf_dir):
    hourly = series.uniform(_series(spark, sf_dir), ["event_type"], "t", "v", 3600.0, 6)
    packed = series.packed(hourly, ["event_type"], "value", 0.0, 3600.0, 6)
    back = series.unpacked(packed, ["event_type"])
    return back.groupBy("event_type").agg((F.max(F.when(F.col("i") == 1, F.col("t"))) - F.max(F.when(F.col("i") == 0, F.col("t")))).alias("hop_seconds"), F.count("*").alias("n"), rounded(F.sum("v"), "db").alias("total"))


@query(f"""with {_E}, w as (select user_id, i, sqrt(avg(v * v) over (partition by user_id order by i rows between 8 preceding and 7 following)) r from e)
select user_id, (i // 4)::bigint frame, {rounded_sql('greatest(-80, 20 * log10(greatest(r / 500.0::double, 1e-12)))', 'db')} db from w where i % 4 = 0""")
def rms_envelope(spark, sf_dir):
    s = _series(spark, sf_dir).select("user_id", "i", "v")
    return series.sliding_rms(s, ["user_id"], 16, 4).select("user_id", "frame", rounded(S.decibels(F.col("rms") / 500.0), "db").alias("db"))


@query(f"""with {_E}, n as (select *, case when v >= 20 then v end x from e)
select event_id, coalesce(last_value(x ignore nulls) over (partition by user_id order by i rows unbounded preceding), first_value(x ignore nulls) over (partition by user_id order by i rows between unbounded preceding and unbounded following), 0) v from n""")
def hold_last_backfill(spark, sf_dir):
    s = _series(spark, sf_dir).withColumn("v", F.when(F.col("v") >= 20, F.col("v")))
    return series.hold_last(s, ["user_id"]).select("event_id", "v")


@query(f"""with {_E}, n as (select user_id, max(i) hi from e group by 1), p as (select user_id, hi, unnest(range(-2, 4 * hi + 6)) / 4.0::double t from n), q as (select *, greatest(0, least(hi, t)) a from p)
select q.user_id, q.t, {rounded_sql('x.v + (a - floor(a)) * (coalesce(y.v, x.v) - x.v)', 'ratio')} v from q join e x on x.user_id = q.user_id and x.i = floor(a) left join e y on y.user_id = q.user_id and y.i = floor(a) + 1""")
def series_sample_linear(spark, sf_dir):
    s = _series(spark, sf_dir).select("user_id", "i", "v")
    points = s.groupBy("user_id").agg(F.max("i").alias("hi")).select("user_id", F.explode(F.sequence(F.lit(-2).cast("long"), 4 * F.col("hi") + 5)).alias("j")).select("user_id", (F.col("j") / 4.0).alias("t"))
    return series.sample_linear(s, points, ["user_id"]).select("user_id", "t", rounded("v", "ratio").alias("v"))


@query(f"""with r as (select event_type, greatest({rounded_sql('quantile_cont(value, 0.98)', 'ratio')}, 0.001::double) reference from events group by 1)
select event_id, reference, {rounded_sql('least(1.0, greatest(0.0, value / reference))', 'ratio')} strength from events join r using (event_type)""")
def strength_p98(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "event_type", F.col("value").alias("v"))
    # One row per event type: small beside the events, and AQE sees it.
    joined = e.join(series.strength_reference(e, ["event_type"]), "event_type")
    return joined.select("event_id", "reference", rounded(S.strength(F.col("v"), F.col("reference")), "ratio").alias("strength"))


@query(f"""with {_E}, r as (select user_id, greatest({rounded_sql('quantile_cont(v, 0.98)', 'ratio')}, 0.001::double) reference from e group by 1)
select user_id, i, reference, {rounded_sql('least(1.0, greatest(0.0, v / reference))', 'ratio')} strength from e join r using (user_id) where event_type = 'click'""")
def onset_strengths(spark, sf_dir):
    s = _series(spark, sf_dir)
    onsets = s.where("event_type = 'click'").select("user_id", "i")
    return series.event_strengths(onsets, s.select("user_id", "i", "v"), ["user_id"])


@query(f"""with {_E}, g as (select user_id, lead(t) over (partition by user_id order by t) - t g from e), s as (select user_id, count(*) n, stddev_pop(g) / greatest(avg(g), 1e-9) cv from g group by 1)
select user_id, case when n >= 3 then {rounded_sql('cv', 'ratio')} end cv, {rounded_sql('case when n < 3 then 0 else greatest(0, least(1, 1 - 4 * cv)) end', 'ratio')} confidence from s""")
def interval_regularity(spark, sf_dir):
    return series.regularity(_series(spark, sf_dir), ["user_id"])


@query(f"""with {_E}, p as (select user_id, i, max(v) over (partition by user_id order by i rows between 1 preceding and 1 following) v from e), m as (select user_id, i % 4 ph, avg(v) a, count(*) c from p group by 1, 2), n as (select user_id, sum(c) n from m group by 1)
select user_id, (case when n < 4 then 0 else ph end)::bigint downbeat_offset from (select *, row_number() over (partition by user_id order by a desc, ph) r from m) join n using (user_id) where r = 1""")
def phase_fit(spark, sf_dir):
    peaks = series.local_peak(_series(spark, sf_dir).select("user_id", "i", "v"), ["user_id"], 1)
    return series.phase_fit(peaks.select("user_id", F.col("i").alias("beat"), F.col("peak").alias("v")), ["user_id"])


@query(f"with {_E} select event_id, greatest(0, floor((i - user_id % 4) / 4.0))::bigint bar from e")
def bar_index(spark, sf_dir):
    return _series(spark, sf_dir).select("event_id", S.bar_index(F.col("i"), F.col("user_id") % 4).alias("bar"))


@query(f"""with {_REGIONS}, b as (select user_id, s::double s, e::double e, coalesce(sum(e - s) over (partition by user_id order by s rows between unbounded preceding and 1 preceding), 0) before from merged)
select user_id, s start_t, s + least(e - s, 10.0 - before) end_t from b where least(e - s, 10.0 - before) > 0""")
def detection_prefix(spark, sf_dir):
    spans = _regions(spark, sf_dir).select("user_id", F.col("start").cast("double"), F.col("end").cast("double"))
    return intervals.budgeted_prefix(spans, ["user_id"], 10.0).select("user_id", F.col("start").alias("start_t"), F.col("end").alias("end_t"))


@query(f"""with {_REGIONS}, p as (select user_id, greatest(0.0, s - 1.5)::double s, (e + 1.5)::double e from merged), w as (select *, max(e) over (partition by user_id order by s, e rows between unbounded preceding and 1 preceding) m from p),
g as (select *, sum(case when s <= m then 0 else 1 end) over (partition by user_id order by s, e rows unbounded preceding) g from w) select user_id, min(s) start_t, max(e) end_t from g group by user_id, g""")
def padded_clips(spark, sf_dir):
    spans = _regions(spark, sf_dir).select("user_id", F.col("start").cast("double"), F.col("end").cast("double"))
    return intervals.padded(spans, ["user_id"], 1.5).select("user_id", F.col("start").alias("start_t"), F.col("end").alias("end_t"))


_DAYS = "epoch_us(l_shipdate) / 86400e6::double"


@query(f"""with p as (select l_suppkey k, {_DAYS} s, {_DAYS} + l_quantity / 10 e from lineitem), w as (select *, max(e) over (partition by k order by s, e rows between unbounded preceding and 1 preceding) m from p),
g as (select *, sum(case when s <= m then 0 else 1 end) over (partition by k order by s, e rows unbounded preceding) g from w) select k l_suppkey, {rounded_sql('min(s)', 'seconds')} start_day, {rounded_sql('max(e)', 'seconds')} end_day from g group by k, g""")
def interval_union(spark, sf_dir):
    start = F.unix_micros(F.col("l_shipdate").cast("timestamp")) / 86400e6
    spans = table(spark, sf_dir, "lineitem").select("l_suppkey", start.alias("start"), (start + F.col("l_quantity") / 10).alias("end"))
    return intervals.union(spans, ["l_suppkey"]).select("l_suppkey", rounded("start", "seconds").alias("start_day"), rounded("end", "seconds").alias("end_day"))


# Days of a user are regions, one-hour spans after purchases and clicks are covers.

def _days_and_covers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    s = _series(spark, sf_dir)
    days = s.select("user_id", (F.floor(F.col("t") / 86400) * 86400.0).alias("start")).distinct().withColumn("end", F.col("start") + 86400.0)
    covers = s.where("event_type in ('click', 'purchase', 'view')").select("user_id", F.col("t").alias("start"), (F.col("t") + 3600 + 100 * F.col("v")).alias("end"))
    return days, covers


_COVERS = f"""{_E}, r as (select distinct user_id k, floor(t / 86400) * 86400.0::double r0, floor(t / 86400) * 86400.0::double + 86400.0::double r1 from e),
w as (select user_id k, t s, t + 3600 + 100 * v e from e where event_type in ('click', 'purchase', 'view')),
a as (select k, s, e, max(e) over (partition by k order by s, e rows between unbounded preceding and 1 preceding) pm from w),
b as (select *, sum(case when pm is null or s > pm then 1 else 0 end) over (partition by k order by s, e rows unbounded preceding) g from a), i as (select k, g, min(s) s, max(e) e from b group by k, g)"""


@query(f"""with {_COVERS}, j as (select r.k, r.r0, r.r1, i.s, i.e from r left join i on r.k = i.k and i.e > r.r0 and i.s < r.r1),
l as (select *, coalesce(lag(e) over (partition by k, r0 order by s), r0) pe, lead(s) over (partition by k, r0 order by s) ns from j),
u as (select k, pe a, s b, false whole from l where s is not null and s > pe union all select k, e, r1, false from l where s is not null and ns is null and e < r1 union all select k, r0, r1, true from l where s is null)
select k user_id, {rounded_sql('a', 'seconds')} start_t, {rounded_sql('b', 'seconds')} end_t from u where whole or b - a >= 7200""")
def uncovered_spans(spark, sf_dir):
    days, covers = _days_and_covers(spark, sf_dir)
    return intervals.subtract(days, covers, ["user_id"], 7200.0, width=86400.0).select("user_id", rounded("start", "seconds").alias("start_t"), rounded("end", "seconds").alias("end_t"))


@query(f"""with {_COVERS}, c as (select r.k, sum(greatest(0, least(i.e, r.r1) - greatest(i.s, r.r0))) c from r join i on r.k = i.k and i.e > r.r0 and i.s < r.r1 group by 1), t as (select k, sum(r1 - r0) t from r group by 1)
select t.k user_id, {rounded_sql('least(1.0, coalesce(c, 0) / t)', 'ratio')} covered_ratio from t left join c on t.k = c.k""")
def coverage_ratio(spark, sf_dir):
    days, covers = _days_and_covers(spark, sf_dir)
    return intervals.coverage(days, covers, ["user_id"], width=86400.0).select("user_id", rounded("covered_ratio", "ratio").alias("covered_ratio"))


@query(f"with {_COVERS} select k user_id, r0 start_t from r where not exists (select 1 from w where w.k = r.k and least(w.e, r.r1) > greatest(w.s, r.r0))")
def outside_activity(spark, sf_dir):
    days, covers = _days_and_covers(spark, sf_dir)
    return intervals.outside(days, covers, ["user_id"], width=86400.0).select("user_id", F.col("start").alias("start_t"))


# Turns of a conversation are lines: a second per character, words spread over it.

@query(f"""with l as (select conv_id, turn, text, case when role = 'user' then ['low_confidence'] else []::varchar[] end base, (length(text) % 7) / 7.0::double conf, (length(text) % 11) / 3.0::double dur, (length(text) % 5) / 8.0::double ns, (length(text) % 13) / 4.0::double cr, (length(text) % 10) / 10.0::double loud from conversations),
f as (select *, list_concat(base, list_filter([case when conf < 0.5 and not list_contains(base, 'low_confidence') then 'low_confidence' end, case when dur > 2.5 then 'long_word_duration' end, case when ns > 0.5 or cr > 2.4 then 'possibly_non_lexical' end, case when loud >= 0.8 then 'overlapping_vocals' end, case when turn % 3 = 0 then 'outside_vocal_activity' end], lambda x: x is not null)) flags from l)
select conv_id, turn, array_to_string(flags, ',') flags from f""")
def line_flags(spark, sf_dir):
    n = F.length("text")
    word = F.struct(((n % 7) / 7.0).alias("confidence"), F.lit(0.0).alias("start_seconds"), ((n % 11) / 3.0).alias("end_seconds"))
    base = F.when(F.col("role") == "user", F.array(F.lit("low_confidence"))).otherwise(F.expr("cast(array() as array<string>)"))
    flags = lines.line_flags(base, F.array(word), (n % 5) / 8.0, (n % 13) / 4.0, (n % 10) / 10.0, F.col("turn") % 3 == 0)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(flags, ",").alias("flags"))


@query(f"""with l as (select conv_id, avg(case when length(text) % 3 = 0 then 1.0 else 0.0 end) r from conversations group by 1) select conv_id, {rounded_sql('r', 'ratio')} lines_flagged_ratio from l""")
def flagged_ratio(spark, sf_dir):
    flags = F.when(F.length("text") % 3 == 0, F.array(F.lit("x"))).otherwise(F.expr("cast(array() as array<string>)"))
    return lines.flagged_ratio(table(spark, sf_dir, "conversations").withColumn("flags", flags), ["conv_id"])


@query(f"""with {_E}, s as (select user_id, list(v order by i) a, max(i) n from e group by 1), q as (select user_id, a, unnest(range(0, n // 4 + 2)) * 4.0::double s from s), z as (select user_id, s, list_slice(a, floor(s)::int + 1, floor(s + 6.5)::int + 1) x from q)
select user_id, s start_t, {rounded_sql('case when len(x) = 0 then 0 else len(list_filter(x, lambda v: v > 50))::double / len(x) end', 'ratio')} share from z""")
def overlap_share(spark, sf_dir):
    s = _series(spark, sf_dir).select("user_id", "i", "v")
    spans = s.groupBy("user_id").agg(F.max("i").alias("n")).select("user_id", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("n") / 4) + 1)).alias("j"))
    spans = spans.select("user_id", (F.col("j") * 4.0).alias("start"), (F.col("j") * 4.0 + 6.5).alias("end"))
    return intervals.share_above(s, spans, ["user_id"], hop=1.0, level=50.0, width=64).select("user_id", F.col("start").alias("start_t"), rounded("share", "ratio").alias("share"))


FPS = 24.0


def _shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _series(spark, sf_dir)
    cuts = s.select("user_id", F.floor(F.col("t") / 60).cast("long").alias("frame"))
    tracks = cuts.groupBy("user_id").agg((F.max("frame") + 100).alias("frame_count"))
    return shots.partition(shots.from_cuts(tracks, cuts, ["user_id"]), ["user_id"], F.lit(FPS))


_SHOTS = f"""{_E}, c as (select distinct user_id, floor(t / 60)::bigint f from e union select distinct user_id, 0::bigint from e), n as (select user_id, max(f) + 100 n from c group by 1),
sh as (select user_id, row_number() over (partition by user_id order by f) - 1 idx, f start_frame, coalesce(lead(f) over (partition by user_id order by f), n) end_frame from c join n using (user_id)),
p as (select *, {rounded_sql(f'start_frame / {FPS}::double', 'seconds')} s, {rounded_sql(f'end_frame / {FPS}::double', 'seconds')} e from sh)"""


@query(f"with {_SHOTS} select user_id, idx::bigint idx, start_frame, end_frame, s start_t, e end_t from p")
def shot_partition(spark, sf_dir):
    return _shots(spark, sf_dir).withColumnsRenamed({"start": "start_t", "end": "end_t"})


@query(f"""with {_SHOTS}, t as (select *, unnest(case when e - s < 4 then [s + (e - s) / 2] else [s + (e - s) / 3, s + 2 * (e - s) / 3] end) tm, unnest(case when e - s < 4 then [0] else [0, 1] end) k from p)
select user_id, idx::bigint idx, k::int place, least(round_even(tm * {FPS}, 0)::bigint, end_frame - 1) frame, printf('shot_%04d_f%d.jpg', idx, k) as "name" from t""")
def representative_points(spark, sf_dir):
    return shots.frame_plan(_shots(spark, sf_dir), ["user_id"], F.lit(FPS)).select("user_id", "idx", "place", "frame", "name")


@query(f"""with {_SHOTS}, m as (select p.user_id, idx, avg(v) a, quantile_cont(v, 0.95) q from p join e on e.user_id = p.user_id and e.t / 1440 >= p.s and e.t / 1440 < p.e group by 1, 2)
select p.user_id, p.idx::bigint idx, {rounded_sql('coalesce(a, 0)', 'ratio')} mean, {rounded_sql('coalesce(q, 0)', 'ratio')} p95 from p left join m using (user_id, idx)""")
def shot_motion(spark, sf_dir):
    pairs = _series(spark, sf_dir).select("user_id", (F.col("t") / 1440).alias("t"), F.col("v").alias("value"))
    return shots.motion(_shots(spark, sf_dir), pairs, ["user_id"], width=64.0)


@query(f"""with {_SHOTS}, t as (select *, unnest(case when e - s < 4 then [s + (e - s) / 2] else [s + (e - s) / 3, s + 2 * (e - s) / 3] end) tm from p), pl as (select distinct user_id, least(round_even(tm * {FPS}, 0)::bigint, end_frame - 1) f from t)
select count(*) n, sum(f)::bigint total from (select distinct user_id, floor(t / 60)::bigint f from e) join pl using (user_id, f)""")
def planned_frames(spark, sf_dir):
    frames = _series(spark, sf_dir).select("user_id", F.floor(F.col("t") / 60).cast("long").alias("frame")).distinct()
    plan = shots.frame_plan(_shots(spark, sf_dir), ["user_id"], F.lit(FPS))
    return shots.planned_frames(frames, plan, ["user_id"]).agg(F.count("*").alias("n"), F.sum("frame").alias("total"))


_BEATS = f"""{_E}, pt as (select user_id, event_id, t from e where event_type = 'click'), be as (select user_id, row_number() over (partition by user_id order by t, i) - 1 bi, t from e where event_type <> 'click'),
near as (select pt.user_id, event_id, pt.t, b0.bi i0, b0.t t0, b1.bi i1, b1.t t1 from pt asof left join be b0 on pt.user_id = b0.user_id and pt.t >= b0.t asof left join be b1 on pt.user_id = b1.user_id and pt.t <= b1.t),
nb as (select user_id, event_id, t, case when t0 is not null and (t1 is null or t - t0 <= t1 - t) then i0 else i1 end nearest_index, t - case when t0 is not null and (t1 is null or t - t0 <= t1 - t) then t0 else t1 end off from near)"""


def _cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _series(spark, sf_dir)
    beats = series.indexed(s.where("event_type <> 'click'").select("user_id", "t", F.col("i").alias("_i")), ["user_id"], ["t", "_i"]).drop("_i")
    return series.nearest(s.where("event_type = 'click'").select("user_id", "event_id", "t"), beats, ["user_id"])


@query(f"with {_BEATS} select event_id, nearest_index::bigint nearest_index, {rounded_sql('off', 'seconds')} as offset_seconds from nb")
def nearest_beat(spark, sf_dir):
    return _cuts(spark, sf_dir).select("event_id", "nearest_index", rounded("offset", "seconds").alias("offset_seconds"))


#: The same, but for beats whose number is of the user's phase.
_DOWNBEATS = _BEATS.replace("near as (", "db as (select * from be where (bi - user_id % 4) % 4 = 0),\nnear as (").replace("join be b0", "join db b0").replace("join be b1", "join db b1")


@query(f"with {_DOWNBEATS} select event_id, nearest_index::bigint downbeat_index, {rounded_sql('t - off', 'seconds')} snapped_t, {rounded_sql('off', 'seconds')} as offset_seconds from nb where nearest_index is not null")
def boundary_snap(spark, sf_dir):
    s = _series(spark, sf_dir)
    beats = series.indexed(s.where("event_type <> 'click'").select("user_id", "t", F.col("i").alias("_i")), ["user_id"], ["t", "_i"]).drop("_i")
    offsets = s.select("user_id").distinct().withColumn("downbeat_offset", F.col("user_id") % 4)
    found = series.snapped(s.where("event_type = 'click'").select("user_id", "event_id", "t"), beats, offsets, ["user_id"]).where("downbeat_index is not null")
    return found.select("event_id", "downbeat_index", rounded("snapped", "seconds").alias("snapped_t"), rounded("offset", "seconds").alias("offset_seconds"))


@query(f"""with {_BEATS}, d as (select user_id, floor(t / 86400)::bigint d, count(*) filter (event_type <> 'click') nb from e group by 1, 2), c as (select user_id, floor(t / 86400)::bigint d, count(*) n, avg(case when abs(off) <= 3600 then 1.0 else 0.0 end) sh from nb group by 1, 2)
select user_id, d section, coalesce(n, 0)::bigint n_cuts, {rounded_sql('case when nb = 0 then 0 else coalesce(n, 0) / (nb / 4.0::double) end', 'ratio')} cuts_per_bar, {rounded_sql('coalesce(sh, 0)', 'ratio')} on_beat_ratio from d left join c using (user_id, d)""")
def cuts_per_section(spark, sf_dir):
    s = _series(spark, sf_dir).withColumn("section", F.floor(F.col("t") / 86400).cast("long"))
    sections = s.groupBy("user_id", "section").agg(F.count_if(F.col("event_type") != "click").alias("n_beats")).withColumn("start", F.col("section") * 86400.0).withColumn("end", (F.col("section") + 1) * 86400.0)
    return shots.cuts_per_section(_cuts(spark, sf_dir), sections, ["user_id"], on_beat=3600.0, width=86400.0)


@query("select o_orderkey, row_number() over (partition by o_custkey, o_orderpriority order by o_orderdate, o_orderkey) occurrence from orders")
def section_occurrence(spark, sf_dir):
    return series.occurrence(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderpriority", ["o_orderdate", "o_orderkey"]).select("o_orderkey", "occurrence")


_LYRICS = "[Verse 1]\n[00:12.50]City lights are low\n\n[00:20.5] [Chorus]\n[00:45.00][01:45.00]Neon in the rain\n[Weird Header]\n  plain line  \n[01:02]\n[12:34.567]Été à Paris\n[Outro x2]"


@query("""with t as (select 1 k, replace('{}', '|', chr(10)) x), l as (select k, string_split(x, chr(10)) a from t), r as (select k, i - 1 i, trim(a[i]) s from (select k, a, unnest(range(1, len(a) + 1)) i from l)),
p as (select k, i, s, trim(regexp_replace(s, '\\[\\d{{1,3}}:\\d{{2}}(?:\\.\\d{{1,3}})?\\]', '', 'g')) text, regexp_extract(s, '^\\[(\\d{{1,3}}):(\\d{{2}})(?:\\.(\\d{{1,3}}))?\\]', ['m', 's', 'f']) h from r)
select i::int source_line_index, text, try_cast(h.m as int) * 60 + try_cast(h.s as int) + try_cast(rpad(case when h.f = '' then '0' else h.f end, 3, '0') as int) / 1000.0::double hint_seconds,
 case when regexp_matches(text, '^\\[[^\\]]+\\]$') then case when lower(text) like '[intro%' then 'intro' when lower(text) like '[verse%' then 'verse' when lower(text) like '[chorus%' then 'chorus' when lower(text) like '[bridge%' then 'bridge' when lower(text) like '[outro%' then 'outro' else 'other' end end as label from p where text <> ''""".format(_LYRICS.replace("\n", "|")))
def markup_parse(spark, sf_dir):
    return lines.parse_supplied(spark.createDataFrame([(1, _LYRICS)], "track_id int, text string"), "track_id").drop("track_id")


@query(r"""with l as (select doc_id, unnest(string_split(text, chr(10))) s, unnest(range(0, len(string_split(text, chr(10))))) i from documents),
n as (select doc_id, i, array_to_string(list_filter(list_transform(regexp_split_to_array(trim(s), '\s+'), lambda x: regexp_replace(lower(x), '[^\p{L}\p{N}\p{M}_'']+', '', 'g')), lambda x: x <> ''), ' ') n from l)
select doc_id, n normal, count(*) n, min(i)::bigint first_idx from n where n.n <> '' group by 1, 2 having count(*) >= 2""")
def line_repetition(spark, sf_dir):
    each = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_idx", "text")).withColumn("line_idx", F.col("line_idx").cast("long"))
    return lines.repetition(each, ["doc_id"])


@query(r"""with recursive l as (select c_nationkey k, c_custkey i, trim(regexp_replace(regexp_replace(lower(c_name), '[^\p{L}\p{N}\p{M}_''\x20\x09-\x0D]+', '', 'g'), '[\x20\x09-\x0D]+', ' ', 'g')) n from customer),
f as (select k, n, min(i) first, count(*) c from l where n <> '' group by 1, 2),
p as (select a.k, a.first a, b.first b from f a join f b on a.k = b.k and a.first < b.first where 1 - levenshtein(a.n, b.n) / greatest(length(a.n), length(b.n))::double >= 0.9),
e as (select k, a, b from p union select k, b, a from p), w(k, a, b) as (select k, first, first from f union select w.k, w.a, e.b from w join e on w.k = e.k and w.b = e.a),
m as (select k, a, min(b) cluster from w group by 1, 2), g as (select m.k, cluster, sum(c)::bigint n from m join f on f.k = m.k and f.first = m.a group by 1, 2 having sum(c) >= 2)
select l.k c_nationkey, l.i line_idx, g.cluster, g.n from l join f using (k, n) join m on m.k = l.k and m.a = f.first join g on g.k = l.k and g.cluster = m.cluster""")
def near_repetition(spark, sf_dir):
    """Customers of a nation whose names are nearly the same."""
    names = table(spark, sf_dir, "customer").select("c_nationkey", F.col("c_custkey").alias("line_idx"), F.col("c_name").alias("text"))
    return lines.near_repetition(names, ["c_nationkey"], similar=0.9)


def _anchoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentences of a conversation are lines to be found among the words of all its turns, four words a second."""
    c = table(spark, sf_dir, "conversations")
    words = c.select("conv_id", "turn", F.posexplode(T.tokens(F.col("text"))).alias("p", "text"))
    observed = series.indexed(words, ["conv_id"], ["turn", "p"], "word_idx").select("conv_id", "word_idx", "text", (F.col("word_idx") / 4.0).alias("start"), (F.col("word_idx") / 4.0 + 0.2).alias("end"))
    sentences = c.select("conv_id", "turn", F.posexplode(F.split("text", r"[.\n]")).alias("p", "text")).where(F.trim("text") != "")
    supplied = series.indexed(sentences, ["conv_id"], ["turn", "p"], "line_idx").select("conv_id", "line_idx", "text", F.lit(None).cast("double").alias("hint_seconds"))
    return lines.anchor_lines(supplied, observed, "conv_id")


@query()
def fuzzy_anchor(spark, sf_dir):
    return _anchoring(spark, sf_dir).select("conv_id", "line_idx", "anchored", rounded("start", "seconds").alias("start_t"), rounded("end", "seconds").alias("end_t"), "confidence")


@query("""with t as (select conv_id, turn, list_filter(regexp_split_to_array(trim(text), '\\s+'), lambda x: x <> '') w from conversations), p as (select a.conv_id, a.turn, a.w s, b.w o from t a join t b on a.conv_id = b.conv_id and b.turn = a.turn + 1),
q as (select *, len(s) n, len(o) m, unnest(range(0, len(s))) i from p where len(s) > 0 and len(o) > 0)
select conv_id, turn, i::int word_idx, s[i + 1] supplied, o[(case when n = 1 then 0 else round_even(i * (m - 1) / (n - 1)::double, 0) end)::int + 1] observed from q""")
def word_pairing(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.filter(F.split(F.trim("text"), r"\s+"), lambda t: t != "").alias("w"))
    other = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.transform("w", lambda t: F.struct(t.alias("text"), F.lit(0.0).alias("start"), F.lit(0.0).alias("end"))).alias("observed"))
    held = c.select("conv_id", "turn", F.col("w").alias("supplied")).join(other, ["conv_id", "turn"])
    n, m = F.size("supplied"), F.size("observed")
    each = held.where((n > 0) & (m > 0)).select("conv_id", "turn", "observed", n.alias("n"), m.alias("m"), F.posexplode("supplied").alias("word_idx", "supplied"))
    j = F.when(F.col("n") == 1, F.lit(0)).otherwise(F.bround(F.col("word_idx") * (F.col("m") - 1) / (F.col("n") - 1), 0))
    return each.select("conv_id", "turn", "word_idx", "supplied", F.element_at("observed", (j + 1).cast("int"))["text"].alias("observed"))


#: The longest common subsequence letter by letter: a row of the table is the running maximum of its candidates.
@query(f"""with recursive t as (select conv_id, turn, list_filter(regexp_split_to_array(trim(text), '\\s+'), lambda x: regexp_replace(lower(x), '[^\\p{{L}}\\p{{N}}\\p{{M}}_'']+', '', 'g') <> '') w from conversations),
p as (select a.conv_id, a.turn, a.w s, b.w o, len(a.w) n, len(b.w) m, unnest(range(0, len(a.w))) i from t a join t b on a.conv_id = b.conv_id and b.turn = a.turn + 1 where len(a.w) > 0 and len(b.w) > 0),
q as (select conv_id, turn, i, s[i + 1] x, o[(case when n = 1 then 0 else round_even(i * (m - 1) / (n - 1)::double, 0) end)::int + 1] y from p),
z as (select *, regexp_replace(lower(x), '[^\\p{{L}}\\p{{N}}\\p{{M}}_'']+', '', 'g') a, regexp_replace(lower(y), '[^\\p{{L}}\\p{{N}}\\p{{M}}_'']+', '', 'g') b from q),
r(a, b, k, row) as (select distinct a, b, 0, list_transform(range(0, length(b)), lambda j: 0::bigint) from z union all select a, b, k + 1, list_transform(range(1, length(b) + 1), lambda j: list_max(list_transform(range(1, j + 1),
  lambda i: case when substr(b, i::int, 1) = substr(a, k + 1, 1) then case when i > 1 then row[i - 1] else 0 end + 1 else row[i] end))) from r where k < length(a)),
l as (select a, b, row[length(b)] n from r where k = length(a))
select conv_id, turn, i::int word_idx, x as "text", 0.0::double as "start", 0.25::double as "end", {rounded_sql('2.0::double * n / (length(a) + length(b))', 'ratio')} confidence from z join l using (a, b)""")
def paired_words(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", T.tokens(F.col("text")).alias("w"))
    other = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.transform("w", lambda t: F.struct(t.alias("text"), F.lit(0.0).alias("start"), F.lit(0.25).alias("end"))).alias("observed"))
    return lines.pair_words(c.withColumnRenamed("w", "supplied").join(other, ["conv_id", "turn"]), ["conv_id", "turn"])


@query(f"""with l as (select conv_id, turn, turn * 3.0::double s, turn % 2 = 0 a, case when turn % 5 = 3 then turn * 3.0::double + 0.5 end h from conversations), x as (select *, case when a then s end st, case when a then s + 2.5 end en from l),
y as (select *, coalesce(last_value(en ignore nulls) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding), 0) pe, first_value(st ignore nulls) over (partition by conv_id order by turn rows between 1 following and unbounded following) ns from x), z as (select *, case when a then st else coalesce(h, pe) end s2 from y)
select conv_id, turn, s2 start_t, case when a then en when ns > s2 then least(ns, s2 + 10) else s2 + 4 end end_t, row_number() over (partition by conv_id order by s2, turn) - 1 place from z""")
def interpolated_lines(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.col("turn") % 2 == 0).alias("anchored"), F.when(F.col("turn") % 5 == 3, F.col("turn") * 3.0 + 0.5).alias("hint_seconds"))
    held = c.withColumn("start", F.when(F.col("anchored"), F.col("turn") * 3.0)).withColumn("end", F.col("start") + 2.5)
    timed = lines.ordered(lines.interpolate_unanchored(held, ["conv_id"], "turn"), ["conv_id"], "turn")
    return timed.select("conv_id", "turn", F.col("start").alias("start_t"), F.col("end").alias("end_t"), "place")


_CENTRES = [(f"c{j}", [((j * 7 + i * 3) % 11 - 5) / 10.0 for i in range(64)]) for j in range(5)]


@query(f"""with c(i, n, v) as (values {", ".join(f"({j}, '{n}', {v}::double[])" for j, (n, v) in enumerate(_CENTRES))}),
d as (select vec_id, label, c.i, c.n, list_sum(list_transform(range(1, 65), lambda k: (embedding[k]::double - c.v[k]) ** 2)) d from embeddings, c), b as (select label, n, count(*) k from (select *, row_number() over (partition by vec_id order by d, i) r from d) where r = 1 group by 1, 2)
select label, array_to_string(list(n || ':' || p::varchar order by p desc, n), ',') palette from (select label, n, (1000 * {rounded_sql('k / sum(k) over (partition by label)', 'ratio')})::int p from b) group by 1""")
def swatch_proportions(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("label", shots.nearest_centre(F.transform("embedding", lambda x: x.cast("double")), _CENTRES).alias("centre"))
    told = F.transform("palette", lambda s: F.concat(s["hex"], F.lit(":"), F.bround(s["proportion"] * 1000, 0).cast("int").cast("string")))
    return shots.swatches(e, ["label"]).select("label", F.array_join(told, ",").alias("palette"))


@query()
def palettes(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    channel = lambda k: F.floor(F.pmod(F.abs(F.element_at("embedding", k)) * 1000, F.lit(8.0))).cast("int") * 32
    return shots.palettes(e.select("label", channel(1).alias("r"), channel(2).alias("g"), channel(3).alias("b")), ["label"]).select("label", F.to_json("palette").alias("palette"))


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    frame = F.struct((F.length("html") % 1280 + 1).alias("width"), (F.length("url") * 8).alias("height"))
    models = F.array(*(F.lit(m) for m, _, _ in ledger.PRICES))
    return p.select("page_id", F.element_at(models, (F.col("page_id") % 5 + 1).cast("int")).alias("model"), F.when(F.col("page_id") % 2 == 0, F.array(frame)).otherwise(F.array(frame, frame)).alias("frames"))


_PRICES = "pr(m, ip, op) as (values " + ", ".join(f"('{m}', {i}::double, {o}::double)" for m, i, o in ledger.PRICES) + ")"
_CALLS = f"""{_PRICES}, mm as (select row_number() over () - 1 k, m from pr), c as (select page_id, (page_id % 5) k, greatest(1, round_even((length(html) % 1280 + 1) * (length(url) * 8) / 750.0::double, 0)::bigint) * (case when page_id % 2 = 0 then 1 else 2 end) + 160 tin from pages),
es as (select m model, count(*) calls, sum(tin)::bigint input_tokens, (300 * count(*))::bigint output_tokens from c join mm using (k) group by 1), ec as (select es.*, {rounded_sql('(input_tokens * ip + output_tokens * op) / 1000000', 'usd')} usd from es join pr on pr.m = es.model)"""


BUDGET = 0.03
_CALLS_BY_RUN = _CALLS.replace("from pages)", "from pages where page_id % 3 <> 0)").replace("select page_id, (page_id % 5) k", "select page_id, page_id % 13 run, (page_id % 5) k").split("es as (select")[0] + f"""
hs as (select run, m model, count(*) c, sum(tin)::bigint i, (300 * count(*))::bigint o from c join mm using (k) group by 1, 2), h as (select hs.*, {rounded_sql('(i * ip + o * op) / 1000000', 'usd')} usd from hs join pr on pr.m = hs.model)"""


@query(f"with {_CALLS} select *, usd <= 1.0 within_budget from ec")
def cost_estimate(spark, sf_dir):
    return ledger.gate(ledger.cost_estimate(_calls(spark, sf_dir), ledger.prices(spark), []), 1.0)


@query(f"""with {_CALLS_BY_RUN}, g as (select run, sum(c)::bigint calls, {rounded_sql('sum(usd)', 'usd')} usd from h group by 1) select run, calls, usd, usd <= {BUDGET} within_budget, case when usd <= {BUDGET} then calls else 0 end::bigint allowed from g""")
def budget_gate(spark, sf_dir):
    """Calls that no earlier reply answers, by run; a run beyond the budget makes none of them."""
    calls = _calls(spark, sf_dir).withColumn("run", F.col("page_id") % 13).withColumn("cache_key", F.col("page_id"))
    gates, allowed = ledger.spendable(calls, calls.where("page_id % 3 = 0").select("cache_key"), ledger.prices(spark), ["run"], BUDGET)
    made = allowed.groupBy("run").agg(F.count("*").alias("allowed"))
    return gates.join(made, "run", "left").select("run", "calls", "usd", "within_budget", F.coalesce("allowed", F.lit(0)).cast("long").alias("allowed"))


@query(f"""with {_PRICES}, mm as (select row_number() over () - 1 k, m, ip, op from pr), u as (select conv_id, conv_id % 5 k, sum(case when role = 'user' then length(text) else 0 end) i, sum(case when role = 'assistant' then length(text) else 0 end) o, count(*) filter (role = 'assistant') c from conversations group by 1, 2)
select conv_id, c::bigint calls, i::bigint input_tokens, o::bigint output_tokens, {rounded_sql('(i * ip + o * op) / 1000000', 'usd')} usd from u join mm using (k) where c > 0""")
def accrued_spend(spark, sf_dir):
    models = F.array(*(F.lit(m) for m, _, _ in ledger.PRICES))
    size = lambda role: F.sum(F.when(F.col("role") == role, F.length("text")).otherwise(0)).alias
    use = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(size("user")("input_tokens"), size("assistant")("output_tokens"), F.count_if(F.col("role") == "assistant").alias("calls"))
    return ledger.accrued(use.withColumn("model", F.element_at(models, (F.col("conv_id") % 5 + 1).cast("int"))), ledger.prices(spark), ["conv_id"])


def _manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One manifest per conversation, assembled from a run log of one row per turn."""
    c = table(spark, sf_dir, "conversations").withColumn("track_id", S.track_id(F.col("conv_id").cast("string")))
    stage = F.element_at(F.array(*map(F.lit, ledger.STAGES[:5])), (F.col("turn") % 5 + 1).cast("int"))
    usage = F.when(F.col("role") == "assistant", F.expr("named_struct('calls', 1, 'input_tokens', cast(length(text) as bigint), 'output_tokens', cast(turn as bigint), 'usd', length(text) / 10000D, 'estimated_usd', 0.5D)"))
    run = F.struct(F.format_string("2024-01-01T00:%02d:00Z", "turn").alias("started_at"), F.lit(1.0).alias("duration_seconds"), F.lit("1").alias("tool_version"), F.lit("cpu").alias("device"), usage.alias("api_usage"))
    log = c.select("track_id", stage.alias("stage"), run["started_at"].alias("started_at"), F.lit("ok").alias("status"), F.lit("x.json").alias("path"), F.lit("1.0.0").alias("schema_version"), S.content_sha256("text").alias("content_sha256"), F.substring(S.content_sha256("role"), 1, 16).alias("config_hash"), run.alias("run"), F.lit(None).cast("string").alias("error"))
    facts = c.groupBy("track_id").agg(F.concat(F.lit("Conversation "), F.min("conv_id").cast("string")).alias("title"), F.lit(None).cast("string").alias("artist"), (F.min("conv_id") % 2 == 0).alias("has_video"), F.lit("2024-01-01T00:00:00Z").alias("created_at"))
    return documents.manifests_of(ledger.latest(log, ["track_id", "stage"]), facts)


_LOG = """lg as (select substr(sha256(conv_id::varchar), 1, 16) track_id, conv_id, turn, role, text, ['source', 'stems', 'audio_features', 'lyrics', 'video'][(turn % 5 + 1)::int] stage from conversations),
nw as (select * from lg qualify row_number() over (partition by track_id, stage order by turn desc) = 1)"""


@query(f"with {_LOG} select count(*) runs, count(*)::bigint calls, coalesce(sum(length(text)), 0)::bigint input_tokens, coalesce(sum(turn), 0)::bigint output_tokens, {rounded_sql('coalesce(sum(length(text) / 10000.0::double), 0)', 'usd')} usd, {rounded_sql('coalesce(sum(0.5::double), 0)', 'usd')} estimated_usd from nw where role = 'assistant'")
def cost_ledger(spark, sf_dir):
    return ledger.ledger(_manifests(spark, sf_dir))


@query(f"""with {_LOG}, t as (select distinct track_id, conv_id from lg), s(stage) as (values ('source'), ('audio_features'), ('lyrics'), ('video'), ('structure')),
a as (select t.track_id, s.stage, case when n.stage is not null then 'ok' when s.stage = 'video' and t.conv_id % 2 <> 0 then 'not_applicable' else 'pending' end status, sha256(n.text) content_sha256 from t cross join s left join nw n on n.track_id = t.track_id and n.stage = s.stage union all select track_id, stage, 'ok', null from nw where stage = 'stems')
select * from a""")
def manifest_entries(spark, sf_dir):
    return documents.manifest_entries(_manifests(spark, sf_dir)).select("track_id", "stage", "status", "content_sha256")


@query("""with h(stage, ch) as (values ('source', 'user'), ('audio_features', 'assistant')), lg as (select substr(sha256(conv_id::varchar), 1, 16) track_id, turn, role, ['source', 'stems', 'audio_features', 'lyrics', 'video'][(turn % 5 + 1)::int] stage from conversations),
nw as (select * from lg qualify row_number() over (partition by track_id, stage order by turn desc) = 1) select track_id, stage, case when ch is not null and ch <> role then 'stale' else 'ok' end shown from nw left join h using (stage)""")
def stage_status(spark, sf_dir):
    entries = documents.manifest_entries(_manifests(spark, sf_dir)).where("status = 'ok'")
    short = lambda role: F.substring(S.content_sha256(F.lit(role)), 1, 16)
    current = spark.createDataFrame([("source",), ("audio_features",)], "stage string").withColumn("current_hash", F.when(F.col("stage") == "source", short("user")).otherwise(short("assistant")))
    return ledger.shown_status(entries, current).select("track_id", "stage", "shown")


@query(f"""with {_LOG}, t as (select distinct track_id from lg), n(p, stage) as (values (1, 'source'), (2, 'audio_features'), (3, 'lyrics')),
m as (select t.track_id, string_agg(stage, ',' order by p) missing from t cross join n where (t.track_id, stage) not in (select track_id, stage from nw) group by 1)
select track_id, coalesce(missing, '') missing, missing is null ready from t left join m using (track_id)""")
def prerequisites(spark, sf_dir):
    manifests = _manifests(spark, sf_dir)
    found = ledger.ready(manifests.select("track_id"), documents.manifest_entries(manifests), ("source", "audio_features", "lyrics"))
    return found.select("track_id", F.array_join("missing", ",").alias("missing"), "ready")


@query("""with lg as (select substr(sha256(conv_id::varchar), 1, 16) track_id, turn, role, ['source', 'stems', 'audio_features', 'lyrics', 'video'][(turn % 5 + 1)::int] stage from conversations),
nw as (select * from lg qualify row_number() over (partition by track_id, stage order by turn desc) = 1) select distinct track_id from lg where track_id not in (select track_id from nw where stage = 'lyrics' and role = 'user')""")
def work_list(spark, sf_dir):
    manifests = _manifests(spark, sf_dir)
    entries = documents.manifest_entries(manifests).withColumn("artifact_exists", F.col("path").isNotNull())
    current = spark.createDataFrame([("lyrics",)], "stage string").withColumn("current_hash", F.substring(S.content_sha256(F.lit("user")), 1, 16))
    return ledger.work_list(manifests.select("track_id"), entries, current, "lyrics")


@query("select doc_id, sha256(sha256(text)) || '.v1.small' cache_key from documents where sha256(text) not in (select sha256(text) from benchmark) and doc_id not in (select doc_id from labels)")
def cache_miss(spark, sf_dir):
    key = lambda x: S.cache_key(F.array(S.content_sha256(x)), F.lit("v1"), F.lit("small"))
    d = table(spark, sf_dir, "documents")
    calls = d.select("doc_id", key("text").alias("cache_key")).join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")
    return ledger.uncached(calls, table(spark, sf_dir, "benchmark").select(key("text").alias("cache_key")))


@query("select page_id, case when page_id % 3 = 0 then 'a caption' end as \"text\", case when page_id % 3 = 0 then page_id % 2 end::bigint n_tags from pages")
def caption_replies(spark, sf_dir):
    reply = F.when(F.col("page_id") % 3 == 0, F.when(F.col("page_id") % 2 == 0, F.lit('{"text": "a caption"}')).otherwise(F.lit('{"text": "a caption", "tags": ["night"]}'))).otherwise(F.lit("no json"))
    parsed = ledger.parse_reply(reply)
    return table(spark, sf_dir, "pages").select("page_id", parsed["text"].alias("text"), F.when(parsed.isNotNull(), F.size(parsed["tags"])).cast("long").alias("n_tags"))


@query(f"""with p as (select page_id, length(html) n, url from pages) select page_id, 'mp4' container, {rounded_sql('n / 7.0::double', 'seconds')} duration_seconds, case when page_id % 3 <> 0 then url end title, 'aac' audio_codec, case when page_id % 2 = 0 then {rounded_sql('30000 / 1001.0::double', 'seconds')} end fps,
 case when page_id % 2 = 0 then case when page_id % 4 = 0 then n::int else round_even(n / 7.0::double * (30000 / 1001.0::double), 0)::int end end frame_count from p""")
def media_probe(spark, sf_dir):
    n, even = F.length("html"), F.col("page_id") % 2 == 0
    stream = lambda **c: F.to_json(F.struct(*(v.alias(k) for k, v in c.items())))
    cover = stream(index=F.lit(0), codec_type=F.lit("video"), codec_name=F.lit("mjpeg"), disposition=F.struct(F.lit(1).alias("attached_pic")))
    audio = stream(index=F.lit(1), codec_type=F.lit("audio"), codec_name=F.lit("aac"), sample_rate=F.lit("44100"), channels=F.lit(2))
    video = stream(index=F.lit(2), codec_type=F.lit("video"), codec_name=F.lit("h264"), width=F.lit(320), height=F.lit(240), avg_frame_rate=F.lit("30000/1001"), nb_frames=F.when(F.col("page_id") % 4 == 0, n.cast("string")))
    tags = F.to_json(F.struct(F.when(F.col("page_id") % 3 != 0, F.col("url")).otherwise(F.lit("")).alias("title")))
    text = F.concat(F.lit('{"format":{"format_name":"mp4","duration":"'), (n / 7.0).cast("string"), F.lit('","tags":'), tags, F.lit('},"streams":['), cover, F.lit(","), audio, F.when(even, F.concat(F.lit(","), video)).otherwise(F.lit("")), F.lit("]}"))
    found = media.probed(table(spark, sf_dir, "pages").select("page_id", text.alias("probe")), "page_id")
    return found.select("page_id", F.col("media.container").alias("container"), F.col("media.duration_seconds").alias("duration_seconds"), F.col("media.tags.title").alias("title"), F.col("media.audio.codec").alias("audio_codec"), F.col("media.video.fps").alias("fps"), F.col("media.video.frame_count").alias("frame_count"))


@query(f"""select doc_id, sha256(text) audio_stream_sha256, {rounded_sql('strlen(text) / (8000.0::double * 2)', 'seconds')} duration_seconds from documents""")
def pcm_duration(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("pcm"))
    return media.pcm(d, "doc_id", rate=8000, channels=1)


@query("""select doc_id, 'txt' as "format", sha256(text) sha256, len(list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '\\S')))::int line_count, false has_timestamps from documents where doc_id % 2 = 0
union all select doc_id, 'lrc', sha256('[00:01.5]' || text), len(list_filter(string_split('[00:01.5]' || text, chr(10)), lambda l: regexp_matches(l, '\\S')))::int, true from documents where doc_id % 2 = 1""")
def lyric_sources(spark, sf_dir):
    odd = F.col("doc_id") % 2 == 1
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("/x/"), F.col("doc_id"), F.when(odd, ".lrc").otherwise(".txt")).alias("path"), F.concat(F.when(odd, "[00:01.5]").otherwise(""), F.col("text")).alias("text"))
    return media.lyric_texts(d).withColumn("doc_id", F.regexp_extract("path", r"(\d+)", 1).cast("long")).drop("path")


@query("""select page_id, coalesce(case when page_id % 2 = 0 then 'Given ' || page_id end, case when page_id % 3 = 0 then 'Tag' end, 'track.' || page_id) title from pages""")
def title_choice(spark, sf_dir):
    given = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("Given "), F.col("page_id"))).otherwise(F.lit(""))
    return table(spark, sf_dir, "pages").select("page_id", media.title(given, F.when(F.col("page_id") % 3 == 0, F.lit("Tag")), F.concat(F.lit("track."), F.col("page_id"), F.lit(".flac"))).alias("title"))


@query(f"""with {_E}, c as (select event_id, t - 86400 s, t - 86400 + v * 100 e, 2000000.0::double d from e), f as (select event_id, least(greatest(s, 0), d) s, e, d from c) select event_id, {rounded_sql('s', 'seconds')} start_t, {rounded_sql('least(greatest(e, s), d)', 'seconds')} end_t from f""")
def clamped_spans(spark, sf_dir):
    s = _series(spark, sf_dir)
    start, end = lines.clamped(F.col("t") - 86400, F.col("t") - 86400 + F.col("v") * 100, F.lit(2000000.0))
    return s.select("event_id", rounded(start, "seconds").alias("start_t"), rounded(end, "seconds").alias("end_t"))


@query("""select conv_id, case when conv_id % 5 = 0 then 'de' when n = 0 then 'en' else 'fr' end as "language", case when conv_id % 5 = 0 then 'pinned' when n = 0 then 'default_no_vocal_activity' else 'detected_vocal_window' end how from (select conv_id, count(*) filter (role = 'system') n from conversations group by 1)""")
def language_source(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count_if(F.col("role") == "system").alias("n"))
    language, how = lines.language_source(F.when(F.col("conv_id") % 5 == 0, F.lit("de")), F.col("n"), F.lit("fr"))
    return c.select("conv_id", language.alias("language"), how.alias("how"))


@query("""with u(user_id, n) as (select user_id, max(epoch_us(ts) // 60000000 - 28401120)::bigint + 50 from events group by 1), sc as (select distinct user_id, (epoch_us(ts) // 60000000 - 28401120)::bigint f from events where event_type = 'purchase'),
x as (select user_id, f + 10 s, coalesce(lead(f) over (partition by user_id order by f), f + 1) + 10 e from sc), y as (select u.user_id, n, s, e, min(s) over (partition by u.user_id) lo, max(s) over (partition by u.user_id) hi from u left join x using (user_id))
select user_id, case when s is null or s = lo then 0 else s end start_frame, case when e is null then n when s = hi and e < n then n else e end end_frame from y""")
def shot_coverage_repair(spark, sf_dir):
    e = _series(spark, sf_dir).withColumn("f", F.floor(F.col("t") / 60).cast("long"))
    tracks = e.groupBy("user_id").agg((F.max("f") + 50).alias("frame_count"))
    scenes = e.where("event_type = 'purchase'").select("user_id", "f").distinct().selectExpr("user_id", "f + 10 as start_frame", "coalesce(lead(f) over (partition by user_id order by f), f + 1) + 10 as end_frame")
    return shots.covering(tracks, scenes, ["user_id"])


@query(f"""with recursive {_E}, d as (select user_id, i, abs(v - lag(v) over (partition by user_id order by i)) / 3 d from e), o as (select user_id, i from d where d >= 27),
nx as (select user_id, i, min(i) over (partition by user_id order by i range between 3 following and unbounded following) n from o), c(user_id, i) as (select user_id, min(i) from o where i >= 3 group by 1 union all select c.user_id, nx.n from c join nx on c.user_id = nx.user_id and c.i = nx.i where nx.n is not null)
select user_id, i frame from c""")
def shot_detection(spark, sf_dir):
    s = _series(spark, sf_dir).select("user_id", F.col("i").alias("frame"), F.col("v").alias("h"), F.lit(0.0).alias("s"), F.lit(0.0).alias("v"))
    return shots.cuts_from_deltas(s, ["user_id"], 27.0, 3)


@query("select l_orderkey, l_linenumber, round_even(greatest(-1.0, least(1.0, (l_quantity - 25) / 24.0::double)) * 32767, 0)::int sample from lineitem")
def quantised_samples(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", S.quantised((F.col("l_quantity") - 25) / 24.0).alias("sample"))


@query(f"select l_orderkey, {rounded_sql('avg(l_quantity)', 'ratio')} v from lineitem group by 1")
def channel_mixdown(spark, sf_dir):
    s = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("i"), F.col("l_quantity").alias("v"), F.lit(0).alias("track"))
    return series.mixdown(s, ["track"]).select(F.col("i").alias("l_orderkey"), rounded("v", "ratio").alias("v"))


@query("""select page_id, 320 width, (round_even(240.0::double * (page_id % 7 + 1) * 320 / (length(url) * 10) / 2, 0) * 2)::int height, printf('#%02x%02x%02x', page_id % 256, length(url) % 256, length(html) % 256) hex from pages""")
def frame_sizes(spark, sf_dir):
    width, height = media.motion_size(F.length("url") * 10, 240.0 * (F.col("page_id") % 7 + 1))
    return table(spark, sf_dir, "pages").select("page_id", width.alias("width"), height.alias("height"), S.rgb_hex(F.col("page_id") % 256, F.length("url") % 256, F.length("html") % 256).alias("hex"))


@query("""with l as (select conv_id, turn, list_filter(string_split(text, ' '), lambda x: trim(x) <> '') w from conversations) select conv_id, turn, len(w)::int n_words, case when len(w) > 0 then floor((len(w) + 1) / 2.0 / len(w) * 1000 + 0.5) / 1000 end::double confidence from l""")
def word_confidence(spark, sf_dir):
    """Confidence of word k of n is k / n."""
    # Columns of their own: an expression within a lambda function is evaluated for every word.
    split = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.filter(F.split("text", " "), lambda t: F.trim(t) != "").alias("w"))
    sized = split.select("*", F.size("w").alias("n"))
    each = F.transform("w", lambda t, k: F.struct(t.alias("text"), k.cast("double").alias("start"), (k + 1.0).alias("end"), ((k + 1) / F.col("n")).alias("probability")))
    held = sized.select("conv_id", "turn", each.alias("each"))
    mean = lines.mean_confidence(F.transform("each", lambda x: F.struct(x["probability"].alias("confidence"))))
    return held.select("conv_id", "turn", F.size(lines.words_of(F.col("each"))).alias("n_words"), rounded(mean, "ratio").alias("confidence"))


@query("""select page_id, sha256('{"schema_version":"1.0.0","track_id":"' || substr(sha256(html), 1, 16) || '","file":{"original_path":"/x/' || page_id || '.html","filename":"' || page_id || '.html","size_bytes":' || strlen(html)
 || ',"sha256":"' || sha256(html) || '"},"media":{"container":"mp4","duration_seconds":' || (page_id % 7) || '.5,"tags":{"title":"' || page_id || '"}}}') content_sha256 from pages""")
def document_round_trip(spark, sf_dir):
    """Source documents written as canonical text, read back and written again; SQL writes the text of its own."""
    name = F.concat(F.col("page_id").cast("string"), F.lit(".html"))
    file = F.struct(F.concat(F.lit("/x/"), name).alias("original_path"), name.alias("filename"), F.octet_length("html").cast("long").alias("size_bytes"), S.content_sha256("html").alias("sha256"))
    empty = "cast(null as struct<{}>)"
    tags = F.struct(F.col("page_id").cast("string").alias("title"), F.lit(None).cast("string").alias("artist"))
    kind = dict(f.split(" ", 1) for f in schemas.DDL["source"].split(", "))
    made = F.struct(F.lit("mp4").alias("container"), (F.col("page_id") % 7 + 0.5).alias("duration_seconds"), tags.alias("tags"), F.expr(empty.format("codec:string,sample_rate:int,channels:int,bit_rate:int")).alias("audio"), F.expr(empty.format("codec:string,width:int,height:int,fps:double,frame_count:int")).alias("video"))
    none = lambda c: F.lit(None).cast(kind[c]).alias(c)
    rows = table(spark, sf_dir, "pages").select(F.lit("1.0.0").alias("schema_version"), S.track_id("html").alias("track_id"), file.alias("file"), none("normalized_audio"), made.alias("media"), none("lyrics_input"))
    held = documents.with_hash(rows, "source")
    again = documents.with_hash(held.select(documents.parsed(F.col("document"), "source").alias("d")).select("d.*"), "source")
    return again.select(F.get_json_object("document", "$.media.tags.title").cast("long").alias("page_id"), "content_sha256")


@query("""with c as (select distinct conv_id from conversations) select 'track_id' as "field", count(*) n from c where conv_id % 7 = 0 having count(*) > 0
union all select 'documents.source.status', count(*) from c where conv_id % 5 = 0 having count(*) > 0""")
def document_faults(spark, sf_dir):
    """Every seventh manifest has an id that is none, every fifth a status that is none."""
    c = F.regexp_extract("title", r"(\d+)", 1).cast("long")
    odd = F.col("documents").withField("source.status", F.when(c % 5 == 0, "lost").otherwise(F.col("documents.source.status")))
    planted = _manifests(spark, sf_dir).withColumn("track_id", F.when(c % 7 == 0, F.upper(F.concat(F.lit("x"), "track_id"))).otherwise(F.col("track_id"))).withColumn("documents", odd)
    return documents.faults(planted, "manifest").groupBy(F.regexp_extract("constraint", r"^[a-z_.]+", 0).alias("field")).agg(F.count("*").alias("n"))


@query("select distinct substr(sha256(conv_id::varchar), 1, 16) track_id from conversations")
def library_listing(spark, sf_dir):
    return documents.track_ids(_manifests(spark, sf_dir))


@query("select 'track.' || page_id || '.html' as \"name\", substr(sha256(html), 1, 16) track_id from pages union all select substr(sha256(html), 1, 16), substr(sha256(html), 1, 16) from pages union all select 'missing', null")
def id_resolution(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select(F.concat(F.lit("track."), F.col("page_id"), F.lit(".html")).alias("path"), S.track_id("html").alias("track_id"))
    names = p.select(F.col("path").alias("name")).union(p.select("track_id")).union(spark.createDataFrame([("missing",)], "name string"))
    return documents.resolve(names, p)


#: The canonical JSON of every section with its defaults, "|" for a line feed.
_SECTIONS = """('source', '{|  "sample_rate": 44100,|  "channels": 2,|  "copy_video": false|}|'),
('stems', '{|  "retain": true,|  "model": "htdemucs",|  "device": "auto",|  "cpu_threads": 1|}|'),
('audio_features', '{|  "vocal_enter_db": -35.0,|  "vocal_exit_db": -45.0,|  "vocal_min_region_seconds": 0.3,|  "vocal_min_gap_seconds": 0.2,|  "phase_fit_window_seconds": 0.03|}|'),
('lyrics', '{|  "model": "small",|  "language": null,|  "confidence_threshold": 0.5,|  "long_word_seconds": 2.5,|  "flag_no_speech_threshold": 0.5,|  "compression_ratio_threshold": 2.4,|  "overlap_rms_db": -15.0,|  "min_anchor_score": 0.6,|  "uncovered_min_seconds": 1.0,|  "fallback_language": "en",|  "clip_to_vocal_activity": true,|  "clip_padding_seconds": 0.5,|  "decode_no_speech_threshold": 0.6|}|'),
('video', '{|  "detector_threshold": 27.0,|  "min_shot_seconds": 0.4,|  "caption_backend": "null",|  "caption_model": "claude-haiku-4-5",|  "caption_prompt_version": "v1",|  "caption_max_output_tokens": 300,|  "caption_budget_usd_per_run": 0.5|}|')"""


@query(f"select stage, substr(sha256(replace(j, '|', chr(10))), 1, 16) current_hash from (values {_SECTIONS}) as t(stage, j)")
def config_hashes(spark, sf_dir):
    return spark.createDataFrame(config.current_hashes(config.Config()), "stage string, current_hash string")


#: The fields of every document in order, with what they hold.
_FIELDS = {
    "source": "schema_version:string track_id:string file:struct normalized_audio:struct media:struct lyrics_input:struct",
    "audio_features": "schema_version:string track_id:string duration_seconds:double tempo:struct beats:struct loudness:struct mix:struct stems:struct vocal_activity:struct",
    "lyrics": "schema_version:string track_id:string mode:string language:string engine:struct lines:array supplied_markup:array untranscribed_regions:array coverage:struct",
    "video": "schema_version:string track_id:string video_span:struct detector:struct caption_backend:struct shots:array",
    "structure": "schema_version:string track_id:string sections:array editing:struct",
    "manifest": "schema_version:string track_id:string title:string artist:string has_video:boolean created_at:string documents:struct stems:struct",
}


@query("select * from (values " + ", ".join(f"('{d}', {i}, '{f.split(':')[0]}', '{f.split(':')[1]}')" for d, fs in _FIELDS.items() for i, f in enumerate(fs.split())) + ") as t(document, place, field, kind)")
def schema_export(spark, sf_dir):
    """Top-level fields of the exported schemas, read back from their JSON."""
    import json

    rows = spark.createDataFrame([(k, json.dumps(v)) for k, v in schemas.exported().items()], "document string, schema string")
    each = rows.select("document", F.posexplode(F.from_json(F.get_json_object("schema", "$.fields"), "array<struct<name:string,type:string>>")).alias("place", "f"))
    kind = F.coalesce(F.get_json_object("f.type", "$.type"), F.col("f.type"))
    return each.select("document", "place", F.col("f.name").alias("field"), kind.alias("kind"))


@query(f"""with e as (select event_id, value v from events) select event_id, 20 * log10(greatest(v / 500, 1e-12)) <= -80 + 1e-9 silent, event_id * 441.0::double / 44100.0::double at_seconds, {rounded_sql('sqrt((v + 3) * (v + 3) + 16.0)', 'seconds')} diagonal,
 'first: ' || left(repeat(event_id::varchar, 100), 200) || '; retry: ' || left(repeat('x', event_id::int % 400), 250) "error", printf('%d calls, about %d input and up to %d output tokens, $%.4f', event_id, event_id * 7, event_id * 3, floor(v * 16) / 16.0) estimate,
 least(event_id % 4000 + 1, 1280)::int width, case when event_id % 4000 + 1 > 1280 then greatest(1, round_even(720 * 1280 / (event_id % 4000 + 1)::double, 0)::int) else 720 end::int height from e""")
def scalar_forms(spark, sf_dir):
    """Small forms of documents and messages, over events."""
    n, v = F.col("event_id"), F.col("value")
    width, height = media.still_size((n % 4000 + 1).cast("int"), F.lit(720))
    error = S.combined_error(F.repeat(n.cast("string"), 100), F.repeat(F.lit("x"), (n % 400).cast("int")))
    shown = S.estimate_text(n, n * 7, n * 3, F.floor(v * 16) / 16.0)
    return table(spark, sf_dir, "events").select("event_id", S.silent(20 * F.log10(F.greatest(v / 500, F.lit(1e-12)))).alias("silent"), S.frame_seconds(n).alias("at_seconds"), rounded(S.diagonal(v + 3, F.lit(4)), "seconds").alias("diagonal"), error.alias("error"), shown.alias("estimate"), width.alias("width"), height.alias("height"))


@query("""with lg as (select conv_id, turn, role, ['source', 'stems', 'audio_features', 'lyrics', 'video'][(turn % 5 + 1)::int] stage, text from conversations), c as (select conv_id k, max(text) reply from conversations where turn = 1 group by 1)
select lg.conv_id, turn, row_number() over (partition by lg.conv_id, stage order by turn) as version, c.reply, case when role = 'user' then 'failed' end status, case when role = 'user' then left(text, 500) end "error" from lg left join c on c.k = lg.conv_id""")
def run_versions(spark, sf_dir):
    """Every run of a stage with its number, the reply that its cache holds, and the entry that a failed run leaves."""
    c = table(spark, sf_dir, "conversations")
    stage = F.element_at(F.array(*map(F.lit, ledger.STAGES[:5])), (F.col("turn") % 5 + 1).cast("int"))
    runs = ledger.versions(c.withColumn("stage", stage), ["conv_id", "stage"], "turn")
    replies = c.where("turn = 1").groupBy("conv_id").agg(F.max("text").alias("reply"))
    entry = F.when(F.col("role") == "user", ledger.failed_entry(F.col("text")))
    return ledger.cached(runs, replies, "conv_id").select("conv_id", "turn", "version", "reply", entry["status"].alias("status"), entry["error"].alias("error"))


# Numeric kernels on synthetic audio made from the events: one click per event, a day is two seconds.

@query()
def audio_features(spark, sf_dir):
    s = _series(spark, sf_dir).select(F.col("user_id").cast("string").alias("track_id"), (F.floor(F.pmod(F.col("t"), F.lit(86400.0)) / 43200 * 44100)).cast("long").alias("i"), (F.col("v") / 500).alias("v"))
    return kernels.features_of_samples(s).select("track_id", rounded("bpm_global", "bpm").alias("bpm_global"), F.size("beats").alias("n_beats"), F.size("rms_db").alias("n_frames"), "integrated_lufs")
