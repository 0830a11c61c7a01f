r"""Quality rules with risk-controlled thresholds.

Each rule rejects a document whose signal reaches a cutoff. Cutoffs are chosen per stratum (language) on all labelled good
documents: from the loosest to the strictest, a cutoff passes while an exact binomial test rejects "more than alpha of the
good documents of this stratum would be lost to it". Fixed-sequence testing needs no correction along the cutoffs of one rule;
over rules and strata the level is divided (Bonferroni). So with confidence 1 - delta no stratum loses more than alpha of its
good documents to a rule, or ``len(RULES) * alpha`` to all of them. Where too few labels exist, nothing is rejected.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .workspace import Workspace, table

#: Rule -> (signal, cutoffs from the loosest on).
RULES: dict[str, tuple[str, tuple[float, ...]]] = {
    "symbols_per_word": ("n_symbols / n_words", (4.0, 3.0, 2.0, 1.5, 1.0, 0.7, 0.5, 0.3, 0.2, 0.1)),
    "repeated_words": ("n_repeat_words / n_words", (0.5, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1, 0.05)),
    "repeated_lines": ("n_dup_lines / n_lines", (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1, 0.05)),
    "word_length": ("word_chars / n_words", (30.0, 25.0, 20.0, 16.0, 14.0, 12.0, 11.0, 10.0, 9.0, 8.0)),
}
ALPHA, DELTA = 0.0125, 0.05

_MASK = -(1 << 30)


def signals(docs: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    r"""(doc_id, extra..., n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words), all long, for each row of ``docs``.

    Words are ``[^\x20\x09-\x0D]+``; lines are split at \n and count when they hold a word. A null text has no words and no lines.
    Repeated windows are found by sorting packed (hash, place) longs; the few candidates are confirmed on their text, so a long
    text costs n log n and one row's memory.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *extra, text.alias("_text"))
    words = base.withColumn("_w", F.expr(r"filter(split(_text, '[ \\t-\\r]+'), w -> w != '')")).withColumn("_lines", F.expr(r"filter(split(_text, '\n'), l -> btrim(l, ' \t\n\u000b\f\r') != '')"))
    counted = words.select(
        "doc_id",
        *extra,
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("_text", "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        "_w",
        F.expr(f"if(size(_w) < 3, array(), sort_array(transform(sequence(0, size(_w) - 3), i -> (xxhash64(_w[i], _w[i + 1], _w[i + 2]) & {_MASK}L) | i)))").cast("array<long>").alias("_packed"),
    )
    m = f"{_MASK}L"
    candidates = counted.withColumn(
        "_at",
        F.expr(f"transform(filter(_packed, (x, i) -> (i > 0 and (x & {m}) = (_packed[i - 1] & {m})) or (i + 1 < size(_packed) and (x & {m}) = (_packed[i + 1] & {m}))), x -> cast(x & {(1 << 30) - 1}L as int))"),
    ).drop("_packed")
    sorted_ = candidates.withColumn("_g", F.expr("if(size(_at) = 0, array(), array_sort(transform(_at, p -> struct(concat_ws(' ', _w[p], _w[p + 1], _w[p + 2]) as g, p as p))))").cast("array<struct<g:string,p:int>>")).drop("_w", "_at")
    places = sorted_.withColumn("_p", F.expr("if(size(_g) = 0, array(), sort_array(transform(filter(_g, (x, i) -> (i > 0 and x.g = _g[i - 1].g) or (i + 1 < size(_g) and x.g = _g[i + 1].g)), x -> x.p)))").cast("array<int>")).drop("_g")
    covered = F.expr("aggregate(transform(_p, (x, i) -> if(i + 1 < size(_p), least(3, _p[i + 1] - x), 3)), 0L, (s, x) -> s + x)")
    return places.withColumn("n_repeat_words", covered.cast("long")).drop("_p")


def _log_gamma(x: Column) -> Column:
    """Stirling's series eight steps up; 1e-12 exact for x >= 1."""
    y = x + 8
    down = F.lit(0.0)
    for j in range(8):
        down = down + F.log(x + j)
    return (y - 0.5) * F.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y) - down


def binomial_tail(k: Column, n: Column, p: float, terms: int = 5000) -> Column:
    """P(X <= k) for X ~ Binomial(n, p), summed from k down; 1 where k is not under the mean, which no level accepts. What lies
    beyond ``terms`` terms is bounded by a geometric series and added, so the result never is too small."""
    kd, nd = k.cast("double"), n.cast("double")
    top = _log_gamma(nd + 1) - _log_gamma(kd + 1) - _log_gamma(nd - kd + 1) + kd * F.log(F.lit(p)) + (nd - kd) * F.log(F.lit(1 - p))
    ratio = lambda i: i * (1 - p) / ((nd - i + 1) * p)
    steps = F.sequence(F.lit(0), F.least(k, F.lit(terms)).cast("int"))
    start = F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("sum"))
    done = F.aggregate(
        steps,
        start,
        lambda s, j: F.struct((s["term"] * ratio(kd - j)).alias("term"), (s["sum"] + s["term"]).alias("sum")),
        lambda s: s["sum"] + F.when(k > terms, s["term"] / (1 - ratio(kd - terms))).otherwise(0.0),
    )
    return F.when(kd >= nd * p, F.lit(1.0)).otherwise(F.exp(top) * done)


def thresholds(good: DataFrame, *, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """(stratum, <rule>...) with the strictest cutoff that passed, or null. ``good``: (stratum, <rule>...) of labelled good documents."""
    counts = good.groupBy("stratum").agg(
        F.count("*").alias("n"), *(F.count_if(F.col(rule) >= c).alias(f"{rule}_{i}") for rule, (_, cutoffs) in RULES.items() for i, c in enumerate(cutoffs))
    )
    n_strata = max(1, counts.count())
    level = delta / (len(RULES) * n_strata)
    told = [
        F.struct(F.lit(rule).alias("rule"), F.lit(i).alias("i"), F.lit(c).alias("cutoff"), F.col(f"{rule}_{i}").alias("k")) for rule, (_, cutoffs) in RULES.items() for i, c in enumerate(cutoffs)
    ]
    tests = counts.select("stratum", "n", F.inline(F.array(*told))).withColumn("passed", binomial_tail(F.col("k"), F.col("n"), alpha) <= level)
    ends = tests.groupBy("stratum", "rule").agg(F.min(F.when(~F.col("passed"), F.col("i"))).alias("failed"), F.map_from_entries(F.collect_list(F.struct("i", "cutoff"))).alias("cutoffs"))
    chosen = ends.select("stratum", "rule", F.try_element_at("cutoffs", F.coalesce(F.col("failed"), F.size("cutoffs")) - 1).alias("cutoff"))
    return chosen.groupBy("stratum").agg(*(F.max(F.when(F.col("rule") == rule, F.col("cutoff"))).alias(f"t_{rule}") for rule in RULES))


def quality(docs: DataFrame, labels: DataFrame, *, stratum: str = "lang", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, rejected_by) for each row of ``docs``
    (doc_id, text, and the stratum column). ``labels``: (doc_id, quality), quality 1 is good. More columns are ignored.

    base_failed: fewer than 50 words, or more than half of the words in repeated 3-word windows. Signals use all words of the
    whole text; thresholds use all labelled documents that pass the base. A null stratum is a stratum of its own; a null text has
    no words and fails the base; a label with a null id or quality is not used; repeated labels of one document count once;
    repeated documents give repeated rows. An empty table gives no rows; without labels only the base rejects.
    """
    ws = Workspace(docs.sparkSession, "quality")
    failed = F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words")
    measured = signals(docs.withColumn("_stratum", F.coalesce(F.col(stratum).cast("string"), F.lit(""))), ("_stratum",))
    rules = [F.when(F.col("n_words") > 0, F.expr(signal)).otherwise(0.0).cast("double").alias(rule) for rule, (signal, _) in RULES.items()]
    rows = ws.write(measured.withColumnRenamed("_stratum", "stratum").withColumn("base_failed", failed).select("*", *rules), "signals")
    marked = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    good = rows.where("not base_failed").join(marked, "doc_id", "left_semi").select("stratum", *RULES)
    chosen = ws.write(thresholds(good, alpha=alpha, delta=delta), "thresholds")
    judged = rows.join(chosen, "stratum", "left")
    broken = F.array_compact(F.array(*(F.when(F.col(rule) >= F.col(f"t_{rule}"), F.lit(rule)) for rule in RULES)))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.size(broken) == 0)).alias("kept"), broken.alias("rejected_by")
    )


def op4_risk_controlled_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("rejected_by")


def _tests_sql() -> str:
    return " union all ".join(f"select stratum, n, '{rule}' r, {i} i, {c!r} cutoff, (select count(*) from good g where g.stratum = s.stratum and g.{rule} >= {c!r}) k from s" for rule, (_, cutoffs) in RULES.items() for i, c in enumerate(cutoffs))


OP4_SQL = rf"""
with t as (select doc_id, coalesce(lang, '') stratum, coalesce(text, '') x from documents),
w as (select *, list_filter(regexp_split_to_array(x, '[\x20\x09-\x0D]+'), lambda v: v <> '') w, list_filter(string_split(x, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) lines from t),
g as (select doc_id, p, w[p] || ' ' || w[p + 1] || ' ' || w[p + 2] g from (select doc_id, w, unnest(range(1, len(w) - 1)) p from w)),
dup as (select doc_id, p from (select *, count(*) over (partition by doc_id, g) n from g) where n > 1),
rep as (select doc_id, count(distinct q) n from (select doc_id, unnest([p, p + 1, p + 2]) q from dup) group by 1),
m as (select w.doc_id, stratum, len(w)::bigint n_words, length(array_to_string(w, ''))::bigint word_chars, length(regexp_replace(x, '[^#*$%&|<>]+', '', 'g'))::bigint n_symbols,
  len(lines)::bigint n_lines, (len(lines) - len(list_distinct(lines)))::bigint n_dup_lines, coalesce(rep.n, 0)::bigint n_repeat_words from w left join rep using (doc_id)),
f as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words base_failed, {", ".join(f"case when n_words > 0 then ({signal.replace(' / ', '::double / ')}) else 0 end {rule}" for rule, (signal, _) in RULES.items())} from m),
good as (select * from f where not base_failed and doc_id in (select doc_id from labels where quality = 1)),
s as (select stratum, count(*) n from good group by 1),
tests as ({_tests_sql()}),
judged as (select *, case when k >= {ALPHA} * n then 1.0 else list_sum(list_transform(range(0, k + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({ALPHA}) + (n - j) * ln(1 - {ALPHA})))) end p from tests),
ends as (select stratum, r, coalesce(min(i) filter (p > {DELTA} / ({len(RULES)} * (select greatest(count(*), 1) from s))), 99) failed from judged group by 1, 2),
chosen as (select stratum, r, min(cutoff) cutoff from tests join ends using (stratum, r) where i < failed group by 1, 2),
bad as (select distinct f.doc_id from f join chosen c on c.stratum = f.stratum and case c.r {" ".join(f"when '{rule}' then f.{rule}" for rule in RULES)} end >= c.cutoff)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and doc_id not in (select doc_id from bad) kept from f
"""
