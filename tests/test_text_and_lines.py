import random

from pyspark.sql import functions as F

from meterline.functions import scalars as S
from meterline.functions import text as T
from meterline.operators import lines

LRC = "[Verse 1]\n[00:12.50]City lights\n\n[Chorus]\n[00:45.00]Neon\n[Weird Header]\nplain"


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for c in a:
        old = row[:]
        for j, d in enumerate(b, 1):
            row[j] = old[j - 1] + 1 if c == d else max(old[j], row[j - 1])
    return row[-1]


def test_indel(spark):
    rng = random.Random(1)
    pairs = [("".join(rng.choice("abc") for _ in range(rng.randrange(8))), "".join(rng.choice("abc") for _ in range(rng.randrange(8)))) for _ in range(120)]
    df = spark.createDataFrame(pairs, "a string, b string")
    for r in df.select("a", "b", T.common_subsequence(F.col("a"), F.col("b")).alias("n"), T.indel_ratio(F.col("a"), F.col("b")).alias("r")).collect():
        assert r.n == plain_lcs(r.a, r.b)
        want = 1.0 if not r.a and not r.b else 2 * r.n / (len(r.a) + len(r.b))
        assert abs(r.r - want) < 1e-12 and abs(lines.indel(r.a, r.b) - want) < 1e-12


def test_tokens(spark):
    got = spark.createDataFrame([("  Été, don't -- STOP! ",)], "x string").select(F.transform(T.tokens(F.col("x")), T.normal_token).alias("t"), T.token_sort_ratio(F.lit("b a"), F.lit("a b")).alias("r")).first()
    assert got.t == ["été", "don't", "stop"] and got.r == 1.0


def test_markup(spark):
    rows = lines.parse_supplied(spark.createDataFrame([("t", LRC)], "k string, text string"), "k").orderBy("source_line_index").collect()
    assert [(r.source_line_index, r.text, r.hint_seconds, r.label) for r in rows] == [
        (0, "[Verse 1]", None, "verse"),
        (1, "City lights", 12.5, None),
        (3, "[Chorus]", None, "chorus"),
        (4, "Neon", 45.0, None),
        (5, "[Weird Header]", None, "other"),
        (6, "plain", None, None),
    ]


def anchored(spark, supplied, words, **more):
    line = spark.createDataFrame([("t", i, text, hint) for i, (text, hint) in enumerate(supplied)], "track_id string, line_idx int, text string, hint_seconds double")
    word = spark.createDataFrame([("t", i, *w) for i, w in enumerate(words)], "track_id string, word_idx int, text string, start double, end double")
    return lines.anchor_lines(line, word, **more).orderBy("line_idx").collect()


WORDS = [(w, i * 0.5, i * 0.5 + 0.4) for i, w in enumerate("one two three four five six seven eight nine ten".split())]


def test_lines_in_order_are_anchored(spark):
    got = anchored(spark, [("One two, three!", None), ("nothing like it here", None), ("seven eight nine", None)], WORDS)
    assert [(r.anchored, r.start, r.end) for r in got] == [(True, 0.0, 1.4), (False, 1.4, 3.0), (True, 3.0, 4.4)]
    assert got[0].confidence == 1.0 and [w.text for w in got[0].words] == ["One", "two,", "three!"]
    assert got[1].flags == ["low_confidence", "unaligned", "timing_interpolated"] and got[1].words == []


def test_hints_bound_the_search(spark):
    twice = WORDS + [(w, s + 60, e + 60) for w, s, e in WORDS]
    got = anchored(spark, [("one two three", 60.0), ("one two three", None)], twice)
    assert got[0].start == 60.0
    assert not got[1].anchored  # the cursor has passed all of them


def test_unanchored_tail(spark):
    got = anchored(spark, [("zzz", 7.0), ("qqq", None)], WORDS)
    assert [(r.start, r.end) for r in got] == [(7.0, 11.0), (0.0, 4.0)]


def test_no_words(spark):
    got = anchored(spark, [("a line", None)], [])
    assert not got[0].anchored and (got[0].start, got[0].end) == (0.0, 4.0)


def test_scalars(spark):
    one = spark.range(1)
    row = one.select(
        S.image_tokens(F.lit(1000), F.lit(750)).alias("a"),
        S.image_tokens(F.lit(1), F.lit(1)).alias("b"),
        S.fraction(F.lit("30000/1001")).alias("c"),
        S.fraction(F.lit("1/0")).alias("d"),
        S.fraction(F.lit("25")).alias("e"),
        S.rgb_hex(F.lit(255), F.lit(0), F.lit(16)).alias("f"),
        S.decibels(F.lit(0.0)).alias("g"),
        S.quantised(F.lit(2.0)).alias("h"),
        S.bar_index(F.lit(0), F.lit(2)).alias("i"),
        S.shortened_error(F.lit("x" * 900)).alias("j"),
    ).first()
    assert tuple(row)[:9] == (1000, 1, 30000 / 1001, None, 25.0, "#ff0010", -80.0, 32767, 0) and len(row.j) == 500


def test_flags_in_fixed_order(spark):
    word = F.struct(F.lit(0.1).alias("confidence"), F.lit(0.0).alias("start_seconds"), F.lit(3.0).alias("end_seconds"))
    base = F.array(F.lit("low_confidence"), F.lit("unaligned"))
    row = spark.range(1).select(
        lines.line_flags(base, F.array(word), F.lit(0.9), F.lit(1.0), F.lit(0.8), F.lit(True)).alias("all"),
        lines.line_flags(F.expr("cast(array() as array<string>)"), F.filter(F.array(word), lambda _: F.lit(False)), F.lit(None).cast("double"), F.lit(None).cast("double"), F.lit(0.0), F.lit(False)).alias("none"),
    ).first()
    assert row["all"] == ["low_confidence", "unaligned", "long_word_duration", "possibly_non_lexical", "overlapping_vocals", "outside_vocal_activity"]
    assert row["none"] == []


def plain_edits(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        old, row = row, [i]
        for j, d in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (c != d)))
    return row[-1]


def plain_clusters(rows, least, similar):
    """By all pairs of the lines of a key."""
    out = []
    for k in {k for k, _, _ in rows}:
        held = {i: n for key, i, n in rows if key == k and n}
        near = lambda a, b: a == b or 1 - plain_edits(a, b) / max(len(a), len(b)) >= similar
        met = {i: [j for j in held if near(held[i], held[j])] for i in held}
        for i in held:
            seen, todo = {i}, [i]
            while todo:
                todo += [j for j in met[todo.pop()] if j not in seen and not seen.add(j)]
            if len(seen) >= least:
                out.append((k, i, min(seen), len(seen)))
    return sorted(out)


def test_near_repetition_is_that_of_all_pairs(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab") for _ in range(rng.choice([4, 5, 6, 9, 10, 11, 12, 20, 21]))) for _ in range(140)]
    for t in texts[:60]:  # the same with one to four edits
        for _ in range(rng.randrange(1, 5)):
            at = rng.randrange(len(t))
            t = t[:at] + rng.choice(["", "c", t[at] + "c"]) + t[at + 1 :]
        texts.append(t)
    rows = [(rng.randrange(2), i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "k int, line_idx long, text string")
    for similar in (0.7, 0.8, 0.9):
        assert sorted(map(tuple, lines.near_repetition(df, ["k"], similar=similar).collect())) == plain_clusters(rows, 2, similar)


def test_near_repetition_one_letter_more_in_ten(spark):
    df = spark.createDataFrame([(1, 0, "abcdefghij"), (1, 1, "abcdefghi"), (1, 2, "zzz"), (None, 3, "abcdefghij")], "k int, line_idx long, text string")
    assert sorted(map(tuple, lines.near_repetition(df, ["k"], similar=0.9).collect())) == [(1, 0, 0, 2), (1, 1, 0, 2)]


def test_near_repetition_makes_no_pairs_of_names(spark):
    names = spark.range(3000).select(F.lit(1).alias("k"), F.col("id").alias("line_idx"), F.format_string("Name#%09d", F.col("id")).alias("text"))
    forms = names.select("k", F.col("text").alias("normal"), F.col("line_idx").alias("first"))
    assert lines._near_links(forms, ["k"], 0.9).count() <= 3000 * 14
    assert lines.near_repetition(names, ["k"], similar=0.9).count() == 3000


def test_tracks_are_anchored_in_tasks_of_their_own(spark):
    ids = spark.range(48).select(F.col("id").alias("track_id"))
    line = ids.select("track_id", F.lit(0).alias("line_idx"), F.lit("One two!").alias("text"), F.lit(float("nan")).alias("hint_seconds"))
    word = ids.select("track_id", F.posexplode(F.array(F.lit("one"), F.lit("Two"))).alias("word_idx", "text")).withColumn("start", F.col("word_idx") * 1.0).withColumn("end", F.col("word_idx") + 0.5)
    found = lines.anchor_lines(line, word).withColumn("task", F.spark_partition_id())
    assert not [x for x in ("ArrowEvalPython", "InPandas") if x in found._jdf.queryExecution().executedPlan().toString()]
    assert "REPARTITION_BY_NUM" in found._jdf.queryExecution().executedPlan().toString()
    rows = found.collect()
    assert len(rows) == 48 and all((r.anchored, r.start, r.end, r.confidence, r.flags, r.hint_seconds) == (True, 0.0, 1.5, 1.0, [], None) for r in rows)
    assert all([tuple(w) for w in r.words] == [("One", 0.0, 0.5, 1.0), ("two!", 1.0, 1.5, 1.0)] for r in rows)
