import hashlib
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from meterline.llm import blocks, decontaminate, licenses, quality, registry, toxicity

from ..compare import connect, rows_of
from ..conftest import DATA

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query_and_its_sql(spark, name):
    found = registry.QUERIES[name](spark, str(DATA)).toPandas()
    assert rows_of(found) == rows_of(connect(DATA).execute(registry.ORACLE[name]).df())


# Benchmark decontamination


def alnum(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))


def plain_hits(doc, items, window=8):
    w, hit, names = alnum(doc), set(), []
    for i, t in items:
        b = alnum(t)
        k = min(window, len(b))
        found = False
        for q in range(len(b) - k + 1 if b else 0):
            for p in range(len(w) - k + 1):
                if w[p : p + k] == b[q : q + k]:
                    hit |= set(range(p, p + k))
                    found = True
        if found:
            names.append(i)
    return len(w), len(hit), sorted(set(names))


def contaminated_fixture():
    rng = random.Random(9)
    word = lambda: rng.choice("aa bb cc dd ee ff gg hh ii jj".split())
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([20, 8, 7, 3, 0, 12, 20])] + [(7, None), (8, "aa"), (9, "aa BB-cc")]
    docs = []
    for _ in range(40):
        text = [word() for _ in range(30)]
        i, t = rng.choice(items[:7])
        cut = (t or "").split()
        a = rng.randrange(len(cut) + 1)
        docs.append(" ".join(text[:15] + cut[a : a + rng.randrange(15)] + text[15:]).replace(" ", rng.choice([" ", ", ", "\n"])))
    return items, docs


@pytest.mark.parametrize("block_bytes", [1 << 20, 150])
def test_winnowing_finds_every_window(spark, make_docs, block_bytes):
    items, docs = contaminated_fixture()
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("extra", F.lit(1))
    got = decontaminate.contamination(make_docs(docs), bench, block_bytes=block_bytes).collect()
    assert {r.doc_id: (r.n_words, sum(s.end - s.start for s in r.spans), r["items"]) for r in got} == {i: plain_hits(d, items) for i, d in enumerate(docs)}
    for r in got:
        assert all(a.end < b.start for a, b in zip(r.spans, r.spans[1:], strict=False))


@pytest.mark.parametrize("block_bytes", [1 << 20, 150])
def test_item_ids_keep_their_type(spark, make_docs, block_bytes):
    items, docs = contaminated_fixture()
    bench = spark.createDataFrame([(f"item-{i}", t) for i, t in items], "item_id string, text string")
    got = decontaminate.contamination(make_docs(docs), bench, block_bytes=block_bytes).collect()
    assert {r.doc_id: r["items"] for r in got} == {i: [f"item-{k}" for k in plain_hits(d, items)[2]] for i, d in enumerate(docs)}
    named = decontaminate.report(decontaminate.contamination(make_docs(docs), bench)).collect()
    assert {r.doc_id: r.items_sha256 for r in named} == {i: hashlib.sha256(",".join(sorted(f"item-{k}" for k in plain_hits(d, items)[2])).encode()).hexdigest() for i, d in enumerate(docs)}


def test_hits_are_compared_on_words(monkeypatch):
    """With hashes that nearly all collide the hits stay the same."""
    whole = blocks.Words.hash_of
    monkeypatch.setattr(blocks.Words, "hash_of", lambda self, *a: whole(self, *a) & np.uint64(1))
    items, docs = contaminated_fixture()
    items = [x for x in items if x[1]]
    bench = decontaminate.Benchmark([i for i, _ in items], [t for _, t in items])
    words = blocks.Words(pa.array(docs), blocks.NOT_ALNUM)
    hit, text, item = bench.search(words)
    for i, d in enumerate(docs):
        got = len(alnum(d)), int(hit[words.first[i] : words.first[i + 1]].sum()), sorted(bench.ids[k] for k in item[text == i])
        assert got == plain_hits(d, items)


def test_fingerprints_guarantee():
    rng = np.random.default_rng(2)
    values = rng.integers(0, 50, 300).astype(np.uint64)
    first = np.array([0, 100, 103, 300])
    inside = np.ones(300, bool)
    chosen = set(decontaminate.fingerprints(values, inside, first, 4).tolist())
    for a, b in zip(first, first[1:], strict=False):
        for p in range(a, b - 3):
            assert chosen & set(range(p, p + 4))
    assert chosen & {100, 101, 102}


def test_decontamination_edges(spark, edge_docs, no_docs):
    bench = spark.createDataFrame([(1, "a b c d e f g h"), (1, "a b c d e f g h"), (2, None), (None, "word")], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.report(decontaminate.contamination(edge_docs, bench)).collect()}
    assert (got[6].n_hit, got[6].n_items, got[6].contaminated) == (8, 1, False)
    assert (got[3].n_hit, got[0].n_words, got[0].items_sha256) == (0, 0, hashlib.sha256(b"").hexdigest())
    left = decontaminate.clean_documents(edge_docs, bench)
    assert left.columns == edge_docs.columns and left.count() == edge_docs.count() - 3
    none = bench.limit(0)
    assert decontaminate.contamination(no_docs, bench).count() == 0
    assert {r.n_items for r in decontaminate.report(decontaminate.contamination(edge_docs, none)).collect()} == {0}


# Quality


def plain_signals(text):
    text = text or ""
    w = [x for x in re.split("[\x20\x09-\x0d]+", text) if x]
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    repeated = {g for g in grams if grams.count(g) > 1} if len(grams) < 3000 else {g for g, n in __import__("collections").Counter(grams).items() if n > 1}
    held = {p for i, g in enumerate(grams) if g in repeated for p in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(held)


def test_signals(spark, edge_docs):
    got = quality.signals(edge_docs.withColumn("t", F.col("text")), ("t",)).collect()
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain_signals(r.t)


def test_signals_on_random_texts(spark, make_docs):
    rng = random.Random(4)
    texts = ["".join(rng.choice(["a ", "b ", "c ", "# ", "\n", "\t", "a\n", "<é> "]) for _ in range(rng.randrange(60))) for _ in range(200)]
    got = {r.doc_id: tuple(r)[1:4] + (r.n_dup_lines, r.n_repeat_words) for r in quality.signals(make_docs(texts)).collect()}
    assert got == {i: plain_signals(t) for i, t in enumerate(texts)}


def test_binomial_tail_is_exact(spark):
    cases = [(0, 10), (1, 10), (0, 500), (3, 700), (20, 3000), (40, 4000), (900, 100000)]
    df = spark.createDataFrame(cases, "k long, n long").select("k", "n", quality.binomial_tail(F.col("k"), F.col("n"), 0.0125).alias("p"), quality.binomial_tail(F.col("k"), F.col("n"), 0.0125, terms=150).alias("q"))
    for r in df.collect():
        want = 1.0 if r.k >= r.n * 0.0125 else sum(math.exp(math.lgamma(r.n + 1) - math.lgamma(j + 1) - math.lgamma(r.n - j + 1) + j * math.log(0.0125) + (r.n - j) * math.log1p(-0.0125)) for j in range(r.k + 1))
        assert r.p == pytest.approx(want, rel=1e-6) and want * (1 - 1e-6) <= r.q <= want * 1.01 + 1e-300


def test_false_rejection_is_limited(spark):
    """Over many draws, cutoffs whose true false-rejection rate is above alpha are almost never chosen."""
    rng = np.random.default_rng(5)
    rows = [(f"s{s}", float(x), 0.0, 0.0, 0.0) for s in range(60) for x in rng.exponential(0.2, 800)]
    good = spark.createDataFrame(rows, "stratum string, symbols_per_word double, repeated_words double, repeated_lines double, word_length double")
    chosen = [r.t_symbols_per_word for r in quality.thresholds(good).collect()]
    assert all(c is not None for c in chosen)
    assert sum(math.exp(-c / 0.2) > quality.ALPHA for c in chosen) == 0


def test_quality_edges(spark, edge_docs, no_docs):
    labels = spark.createDataFrame([(6, 1), (6, 1), (None, 1), (3, None)], "doc_id long, quality int")
    got = quality.quality(edge_docs, labels).collect()
    assert len(got) == edge_docs.count()
    by_id = {r.doc_id: r for r in got}
    assert by_id[0].base_failed and not by_id[0].kept and by_id[10].n_words == 60000 and by_id[11].base_failed
    assert quality.quality(no_docs, labels).count() == 0
    assert quality.quality(edge_docs, labels.limit(0)).where("kept").count() == quality.quality(edge_docs, labels.limit(0)).where("not base_failed").count()


# Licences


def plain_license(text):
    best = None
    units = {u for u in [*(text or "").lower().split("\n"), *re.split("\n[ \t\r]*\n", (text or "").lower()), (text or "").lower()]}
    for u in units:
        grams = set(licenses.bigrams_of(u))
        for i, (name, t) in enumerate(licenses.TEMPLATES):
            other = set(licenses.bigrams_of(t))
            if grams:
                best = max(best or (0, 0, ""), (2 * len(grams & other) / (len(grams) + len(other)), -i, name))
    return (best[2], best[0]) if best and best[0] >= licenses.MATCH else (None, None)


def test_licenses(spark, make_docs):
    texts = [t for _, t in licenses.TEMPLATES]
    texts += [f"intro words\n{t.upper()}\nmore" for t in texts] + [f"some\n\n{t[: len(t) // 2]}\n{t[len(t) // 2 :]}\n\nother" for t in texts]
    texts += ["released under the mit licence", "all rights", "Licensed under the Apache License, Version 1.0.", "no license here at all, only the word", "", None, "software " * 3000]
    got = {r.doc_id: (r.license, r.dice) for r in licenses.license_scan(make_docs(texts)).collect()}
    want = {i: plain_license(t) for i, t in enumerate(texts)}
    assert got == want
    assert [got[i][0] for i in range(len(licenses.TEMPLATES))] == [n for n, _ in licenses.TEMPLATES]


def test_licenses_in_paragraphs_and_lines(make_docs):
    around = [" ".join(f"{side}{i}" for i in range(300)) for side in ("before", "after")]
    texts = [f"{around[0]}\n\n{re.sub('[.:;] ', lambda m: m[0] + chr(10) * 2, t)}\n\n{around[1]}" for _, t in licenses.TEMPLATES]
    texts += [f"{around[0]} {t} {around[1]}" for _, t in licenses.TEMPLATES]
    names = [n for n, _ in licenses.TEMPLATES] * 2
    mit, apache = licenses.TEMPLATES[2][1].split(), licenses.TEMPLATES[3][1]
    # Words put in all over, and a license that lacks a quarter, whose lines are a run; then what must stay unmatched.
    texts += [f"{around[0]} {' '.join(w if i % 14 else w + ' extra' for i, w in enumerate(mit))} {around[1]}", "\n\n".join([around[0], *(" ".join(mit[i : i + 20]) for i in range(0, 120, 20)), around[1]])]
    texts += [f"{around[0]} {apache.replace('2.0', '1.0')} {around[1]}", f"{around[0]} {' '.join(mit[:60])} {around[1]}", f"all {around[0]} rights reserved"]
    got = {r.doc_id: (r.license, r.dice, r.n_units) for r in licenses.license_scan(make_docs(texts)).collect()}
    assert [got[i][0] for i in range(len(texts))] == names + ["MIT", "MIT", None, None, None]
    # Some notices of two sentences match by the longer one, which is a unit.
    assert all(got[i][1] == 1.0 or got[i][1] == plain_license(texts[i])[1] for i in range(len(names)))
    assert {plain_license(t)[0] for t in texts[len(licenses.TEMPLATES) :]} == {None}


def test_markers_lose_nothing():
    marks = set(licenses.markers(licenses.MATCH, licenses.TEMPLATES))
    for _, t in licenses.TEMPLATES:
        grams = licenses.bigrams_of(t)
        assert sum(not set(g.split()) & marks for g in grams) < len(grams) * licenses.MATCH / (2 - licenses.MATCH)


def test_license_edges(edge_docs, no_docs):
    got = licenses.license_scan(edge_docs).collect()
    assert len(got) == edge_docs.count() and {r.license for r in got} == {None}
    assert licenses.license_scan(no_docs).count() == 0


# Toxicity


def toxic_fixture(n=600, seed=1):
    rng = random.Random(seed)
    texts, labels = [], []
    for i in range(n):
        words = [f"w{int(rng.expovariate(0.02))}" for _ in range(40)]
        toxic, junk = rng.random() < 0.25, rng.random() < 0.3
        if toxic:
            words[rng.randrange(40)] = rng.choice(["scoundrel", "wretch", "cretin"])
            words[rng.randrange(40)] = rng.choice(["scoundrel", "wretch", "cretin"])
        if junk:
            words[rng.randrange(40)] = "clickhere"
        texts.append(" ".join(words))
        labels.append((i, int(not junk), int(toxic)))
    return texts, labels


def test_chain_on_held_out_documents(spark, make_docs):
    texts, labels = toxic_fixture()
    told = spark.createDataFrame(labels[:400], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(make_docs(texts), told).collect()}
    held = [(got[i].toxic, bool(t), got[i].low_quality, not q) for i, q, t in labels[400:]]
    assert np.mean([a == b for a, b, _, _ in held]) > 0.97 and np.mean([a == b for _, _, a, b in held]) > 0.97


def plain_features(text):
    """Distinct words and beginnings of longer ones, as strings."""
    words = {w.encode() for w in alnum(text)}
    return words | {(w[: toxicity.BEGINNING], "beginning") for w in words if len(w) > toxicity.BEGINNING}


def plain_hash(feature):
    word, salt = (feature[0], toxicity._BEGINNING_SALT) if isinstance(feature, tuple) else (feature, np.uint64(0))
    return int(blocks.Words(pa.array([word], pa.binary()), blocks.NOT_ALNUM, hashes=False).hash_of(np.array([0]), np.array([len(word)]))[0] ^ salt)


def newton(x, y, ridge):
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-x @ w))
        w -= np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + np.diag(ridge), x.T @ (p - y) + ridge * w)
    return w


def plain_chain(rows, names):
    """Train as the operator does, by counting and Newton's method: probabilities of the training rows for each category."""
    n, folds = len(rows), np.array([r[0] % toxicity.FOLDS for r in rows])
    y = np.array([r[2] for r in rows], float)
    chosen = set()
    for k in range(len(names)):
        chi = {}
        for f in {f for r in rows for f in r[1]}:
            seen, both, total = sum(f in r[1] for r in rows), sum(f in r[1] and r[2][k] for r in rows), y[:, k].sum()
            if 3 <= seen < n and 0 < total < n:
                expected = seen * total / n
                chi[f] = (both - expected) ** 2 * n / (expected * (1 - total / n) * (n - seen))
        chosen |= set(sorted((f for f in chi if chi[f] >= 10.83), key=lambda f: (-chi[f], plain_hash(f)))[: toxicity.FEATURES])
    chosen = sorted(chosen, key=plain_hash)
    x = np.array([[float(f in r[1]) for f in chosen] for r in rows])
    earlier, out, apart = np.zeros((n, 0)), np.zeros((n, len(names))), np.zeros((n, 0))
    for k in range(len(names)):
        full = np.concatenate([x, earlier / 4, np.ones((n, 1))], axis=1)
        ridge = np.append(np.ones(full.shape[1] - 1), 0.0)
        held_out = np.zeros(n)
        for f in range(toxicity.FOLDS):
            held_out[folds == f] = full[folds == f] @ newton(full[folds != f], y[folds != f, k], ridge)
        w = newton(full, y[:, k], ridge)
        odds = np.concatenate([x, apart / 4, np.ones((n, 1))], axis=1) @ w
        out[:, k] = 1 / (1 + np.exp(-odds))
        earlier = np.concatenate([earlier, np.clip(held_out, -8, 8)[:, None]], axis=1)
        apart = np.concatenate([apart, np.clip(odds, -8, 8)[:, None]], axis=1)
    return chosen, out


def test_training_against_a_plain_version():
    """Three categories, the last of which follows from the first two."""
    rng, texts, labels = random.Random(8), [], []
    for _ in range(240):
        words = [f"w{int(rng.expovariate(0.05))}" for _ in range(20)]
        a, b = rng.random() < 0.4, rng.random() < 0.4
        words += ["insulting"] * a + ["threaten"] * b
        texts.append(" ".join(words))
        labels.append([float(a), float(b != (rng.random() < 0.05)), float((a or b) != (rng.random() < 0.05))])
    names = ["insult", "threat", "severe"]
    values, offsets = toxicity.features(pa.array(texts))
    chain = toxicity.train([(i, values[offsets[i] : offsets[i + 1]], labels[i]) for i in range(240)], names)
    chosen, want = plain_chain([(i, plain_features(texts[i]), labels[i]) for i in range(240)], names)
    assert chain.keys.tolist() == [plain_hash(f) for f in chosen] and len(chosen) >= 2
    assert chain.links[2, :2].min() > 0 and not chain.links[:, 2].any()
    assert np.abs(chain.probabilities(pa.array(texts)) - want).max() < 0.03


def test_query_against_plain_scores(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    chain = toxicity.fit_chain(docs, labels, toxicity.CATEGORIES)
    place = {int(h): k for k, h in enumerate(chain.keys)}
    got = {r.doc_id: r for r in toxicity.op7_classifier_chain_toxicity(spark, str(DATA)).collect()}
    for r in docs.collect():
        held = [place[h] for f in plain_features(r.text) if (h := plain_hash(f)) in place]
        odds = []
        for k in range(2):
            odds.append(chain.bias[k] + sum(chain.weights[k][j] for j in held) + sum(chain.links[k, j] * max(-8, min(8, odds[j])) for j in range(k)))
        p = [1 / (1 + math.exp(-o)) for o in odds]
        assert got[r.doc_id].p_low_quality == pytest.approx(p[0], abs=1e-9) and got[r.doc_id].p_toxic == pytest.approx(p[1], abs=1e-9)
        assert got[r.doc_id].toxic == (p[1] >= chain.thresholds[1]) and got[r.doc_id].kept != got[r.doc_id].toxic
    assert len(got) == docs.count()


def test_later_models_use_earlier_ones():
    """The second category is the first one's exclusive-or with a word: only the chain's link carries its part."""
    rng = random.Random(2)
    names = np.array([11, 22, 33], np.uint64)
    rows = []
    for k in range(900):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        rows.append((k, np.sort(np.append(names[[a, b]] if False else [n for n, on in zip(names, (a, b, True), strict=True) if on], np.uint64(1000 + k))).astype(np.uint64), [float(a), float(a or (b and rng.random() < 0.2))]))
    chain = toxicity.train(rows, ["first", "second"])
    assert chain.links[1, 0] > 0.1 and chain.links[0].sum() == 0
    again = toxicity.train(rows, ["first", "second"])
    assert np.array_equal(chain.weights, again.weights)


def test_toxicity_edges(spark, edge_docs, no_docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(edge_docs, none).collect()
    assert len(got) == edge_docs.count() and not any(r.toxic for r in got)
    odd = spark.createDataFrame([(None, 1, 1), (3, None, 1), (4, 1, None), (6, 1, 0), (6, 1, 0), (0, 0, 1)], "doc_id long, quality int, toxic int").withColumn("text", F.lit("x"))
    assert toxicity.toxicity(edge_docs, odd).count() == edge_docs.count()
    assert toxicity.toxicity(no_docs, none).count() == 0
    assert toxicity.drop_toxic(edge_docs, none).columns == edge_docs.columns
