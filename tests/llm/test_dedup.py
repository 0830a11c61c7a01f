import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from meterline.llm import components, near_dedup, substring_dedup
from meterline.llm.components import connected_components
from meterline.llm.workspace import Workspace, without

from ..conftest import DATA

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sets_of(texts, k=5):
    out = {}
    for i, t in texts.items():
        w = re.findall("[^\x20\x09-\x0d]+", (t or "").translate(LOWER))
        out[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    return out


def plain_components(texts, percent):
    sets, parent, held = sets_of(texts), {i: i for i in texts}, defaultdict(list)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sorted(sets):
        met = Counter()
        for s in sets[i]:
            met.update(held[s])
            held[s].append(i)
        for j, n in met.items():
            if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i)) for i in texts}


def copies(n_groups, size, seed, words=60):
    """Groups of near copies, each with a few words changed, over a small and a large group."""
    rng, out = random.Random(seed), []
    for g in range(n_groups):
        base = [f"g{g}w{rng.randrange(200)}" for _ in range(words)]
        for _ in range(size if g == 0 else 3):
            mine = base[:]
            for _ in range(rng.randrange(4)):
                mine[rng.randrange(words)] = f"x{rng.randrange(10**6)}"
            out.append(" ".join(mine))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("block", [near_dedup.BLOCK_DOCS, 7, 2])
def test_components_are_those_of_all_pairs(make_docs, block):
    texts = [*copies(12, 60, 5), "one two", "ONE two", "three", "", None, " "]
    texts += texts[:9]
    got = near_dedup.near_duplicates(make_docs(texts), percent=85, block_docs=block).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == plain_components(dict(enumerate(texts)), 85)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_a_large_group_moves_few_texts(make_docs, monkeypatch):
    """Near copies that all differ: what the rounds move grows with the table, not with its square."""
    moved = {}
    tested = near_dedup._tested

    def counted(ws, name, texts, classes, rows, k, percent):
        moved[name] = rows.count()
        return tested(ws, name, texts, classes, rows, k, percent)

    monkeypatch.setattr(near_dedup, "_tested", counted)
    rng, base, per_doc = random.Random(2), [f"w{i * 7919 % 1000}" for i in range(120)], []
    for n in (1200, 5000):
        texts = []
        for i in range(n):
            mine = base[:]
            mine[rng.randrange(120)] = f"x{i}"
            texts.append(" ".join(mine))
        texts[7] = "unlike the others"
        moved.clear()
        got = near_dedup.near_duplicates(make_docs(texts), percent=80, block_docs=100).collect()
        assert {r.component_id for r in got} == {0, 7}
        per_doc.append(sum(moved.values()) / n)
    assert per_doc[1] <= 1.2 * per_doc[0] and per_doc[1] < 8


def rows_labelled(spark, after):
    """Rows that joins of documents with their components have made in queries after the one numbered ``after``, and the last number."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    store, made = spark._jsparkSession.sharedState().statusStore(), 0
    runs = store.executionsList()
    runs = [runs.apply(i).executionId() for i in range(runs.size())]
    for run in (x for x in runs if x > after):
        nodes, values = store.planGraph(run).allNodes(), store.executionMetrics(run)
        for node in map(nodes.apply, range(nodes.size())):
            if re.search(r"Join \[doc_id#\w+\], \[doc_id#\w+\], LeftOuter", node.desc()):
                for metric in map(node.metrics().apply, range(node.metrics().size())):
                    if metric.name() == "number of output rows" and (value := values.get(metric.accumulatorId())).isDefined():
                        made += int(value.get().replace(",", ""))
    return made, max(runs, default=after)


def test_rounds_label_each_member_once(spark, make_docs):
    """A document has 32 bands, of which each of the two later rounds labels every one at most once, however large its group is."""
    rng, base, per_doc = random.Random(3), [f"w{i * 7919 % 1000}" for i in range(200)], []
    _, last = rows_labelled(spark, -1)
    for n in (400, 1600):
        texts = []
        for i in range(n):
            mine = base[:]
            mine[rng.randrange(200)] = f"x{i}"
            texts.append(" ".join(mine))
        got = near_dedup.near_duplicates(make_docs(texts), percent=85, block_docs=100).collect()
        assert {r.component_id for r in got} == {0}
        made, last = rows_labelled(spark, last)
        per_doc.append(made / n)
    assert 0 < per_doc[0] <= 2 * near_dedup.BANDS and per_doc[1] <= 1.2 * per_doc[0]


def test_a_large_bucket_without_links_is_tested_whole(make_docs):
    """Texts that share much but not enough, in blocks of seven, and one pair among them that is linked."""
    common = [f"c{i * 31 % 97}" for i in range(60)]
    texts = [" ".join([*common, *(f"d{i}n{j}" for j in range(30))]) for i in range(60)]
    texts += [" ".join([*texts[17].split()[:-1], "last"]), " ".join(common)]
    got = near_dedup.near_duplicates(make_docs(texts), percent=85, block_docs=7).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == plain_components(dict(enumerate(texts)), 85)


def test_query_on_the_smallest_tables(spark):
    got = near_dedup.op3_minhash_near_dedup(spark, str(DATA)).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == plain_components(texts, 85)


def test_near_dedup_edges(edge_docs, no_docs):
    got = near_dedup.near_duplicates(edge_docs).collect()
    assert len(got) == edge_docs.count()
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)]
    by_id = {r.doc_id: r for r in got}
    assert (by_id[4].component_id, by_id[4].kept, by_id[7].component_id) == (3, False, 6)
    assert by_id[0].n_shingles == by_id[1].n_shingles == 0 and by_id[0].kept and by_id[1].kept
    assert near_dedup.near_duplicates(no_docs).count() == near_dedup.keep_one(no_docs).count() == 0
    kept = near_dedup.keep_one(edge_docs)
    assert kept.columns == edge_docs.columns and sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == sorted([*{r.doc_id for r in got if r.kept and r.doc_id is not None}, 6])


def test_a_repeated_id_is_one_node(make_docs):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(40)) for x in "abcd")
    near = " ".join([*c.split()[:-1], "other"])
    texts = [(1, a), (2, b), (7, a), (7, b), (3, c), (9, near), (9, None), (9, d), (12, d), (4, a + " x"), (20, "alone"), (20, None), (None, a)]
    for rows in (texts, texts[:4], [(1, a), (7, a), (7, None)], [(5, a), (5, b)]):
        got = near_dedup.near_duplicates(make_docs([t for _, t in rows], [i for i, _ in rows])).collect()
        want = {1: 1, 2: 1, 7: 1, 4: 1, 3: 3, 9: 3, 12: 3, 20: 20, 5: 5, None: None}
        assert len(got) == len(rows) and all(r.component_id == want[r.doc_id] for r in got)
        assert all(r.kept == (r.doc_id == r.component_id) for r in got if r.doc_id is not None)
    kept = near_dedup.keep_one(make_docs([t for _, t in texts], [i for i, _ in texts])).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == [1, 3, 20, 20]


def test_estimates_are_close():
    rng = np.random.default_rng(1)
    values = np.sort(rng.integers(0, 2**63, 4000, dtype=np.uint64))
    a, b = values[:3000], values[300:3300]
    low = near_dedup.minima(np.concatenate([a, b]), np.array([0, 3000, 6000]))
    packed = near_dedup.pack(low)
    assert abs(near_dedup.estimate(packed, packed)[0, 1] - 2700 / 3300) < 0.12
    assert near_dedup.estimate(packed, packed)[0, 0] == 1


@pytest.mark.parametrize("edges_of_a_task", [components.TASK_EDGES, 0])
def test_components_of_chains_and_rings(spark, monkeypatch, edges_of_a_task):
    monkeypatch.setattr(components, "TASK_EDGES", edges_of_a_task)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100 + i, 100 + (i + 1) % 7) for i in range(7)] + [(500, 500), (600, 500)]
    found = connected_components(spark.createDataFrame(edges, "a long, b long"), Workspace(spark, "test")).collect()
    # The smallest node of a component has a row in one way and none in the other.
    assert {r.node: r.component for r in found if r.node != r.component} == {**{i: 0 for i in range(1, 41)}, **{100 + i: 100 for i in range(1, 7)}, 600: 500}
    nothing = connected_components(spark.createDataFrame([(3, 3)], "a long, b long"), Workspace(spark, "test"))
    assert nothing.count() == 0


def test_without_shuffles_when_there_are_many(make_docs, monkeypatch):
    docs = make_docs(["a", "b", "c", "d"], [1, 2, None, 1])
    gone = docs.sparkSession.createDataFrame([(1,), (None,)], "x long")
    for limit in (10, 0):
        monkeypatch.setattr("meterline.llm.workspace.BROADCAST_ROWS", limit)
        assert sorted(r.text for r in without(docs, gone, "test").collect()) == ["b", "c"]


def plain_units(text):
    """Units of a text word by word: (start, end, words, opens its line, closes its line, bytes up to the next word)."""
    data, out = text.encode(), []
    words = [(m.start(), m.end(), m.group().translate(LOWER_BYTES)) for m in re.finditer(rb"[^\x20\x09-\x0d]+", data)]
    line = [data[:s].count(b"\n") for s, _, _ in words]
    reach = substring_dedup.REACH

    def key(i):
        behind = i and line[i - 1] == line[i] and words[i - 1][2][-1:] in (b".", b"!", b"?")
        head, tail = int.from_bytes(words[i][2][:8].ljust(8, b"\0"), "big"), int.from_bytes(words[i][2][-8:], "big")
        prime = substring_dedup.PRIME
        return (head % prime * substring_dedup.HEAD + tail % prime * substring_dedup.TAIL) % prime + (0 if behind else substring_dedup.INSIDE)

    keys, cuts = [key(i) for i in range(len(words))], []
    for i in range(len(words)):
        near = [j for j in range(i - reach, i + reach + 1) if 0 <= j < len(words) and line[j] == line[i]]
        least = len(near) == 2 * reach + 1 and all(keys[j] > keys[i] for j in near if j < i) and all(keys[j] >= keys[i] for j in near)
        if not i or line[i - 1] != line[i] or least:
            cuts.append(i)
    for a, b in zip(cuts, [*cuts, len(words)][1:], strict=True) if cuts else []:
        after = words[b][0] if b < len(words) else len(data)
        out.append((words[a][0], words[b - 1][1], tuple(w for _, _, w in words[a:b]), not a or line[a - 1] != line[a], b == len(words) or line[b] != line[a], after - words[b - 1][1]))
    return out


def plain_passages(texts, min_words=substring_dedup.MIN_WORDS):
    """For each document its passages to remove, as lists of (unit, earliest document, earliest unit)."""
    first, out = {}, {}
    for i in sorted(texts):
        runs, units = [[]], plain_units(texts[i] or "")
        for k, u in enumerate(units):
            if u[2] in first:
                runs[-1].append((k, *first[u[2]]))
            else:
                first[u[2]] = (i, k)
                runs.append([])
        out[i] = [r for r in runs if sum(len(units[k][2]) for k, _, _ in r) >= min_words]
    return out


def plain_cut(texts, min_words=substring_dedup.MIN_WORDS):
    out = {}
    for i, passages in plain_passages(texts, min_words).items():
        if not passages:
            out[i] = texts[i]
            continue
        data, left, at, units = texts[i].encode(), b"", 0, plain_units(texts[i])
        for run in passages:
            a, b = units[run[0][0]], units[run[-1][0]]
            left, at = left + data[at : a[0]], b[1] + (b[5] if a[3] or not b[4] else 0)
        out[i] = (left + data[at:]).decode()
    return out


LOWER_BYTES = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
LONG = " ".join(f"passage{i * 7919 % 1000}" for i in range(60))


def invented(n, seed):
    """Texts of lines and sentences; every third text takes a passage of 51 to 90 words over from an earlier one, at any word."""
    rng, out = random.Random(seed), []
    name = lambda: "".join(rng.choice("abcdefghiklmnoprstuvéß") for _ in range(rng.randrange(2, 10)))
    common = [name() for _ in range(400)]
    planted = {}
    for i in range(n):
        words = []
        for _ in range(rng.randrange(80, 300)):
            w = rng.choice(common) if rng.random() < 0.6 else name()
            words.append(rng.choice([w, w, w, w, w, w.title(), w + ",", w + ".", w + ".\n", w + "\n"]) if rng.random() < 0.4 else w)
        if i % 3 == 2:
            source = rng.choice([t for k, t in enumerate(out) if k % 3 != 2])
            size = rng.randrange(51, 91)
            if len(source) > size:
                a, b = rng.randrange(len(source) - size), rng.randrange(len(words))
                words[b:b] = source[a : a + size]
                planted[i] = size
        out.append(words)
    return [" ".join(w).replace("\n ", "\n") for w in out], planted


def check_passages(make_docs, texts, **more):
    docs = make_docs(texts)
    want = {(i, u, d, k) for i, runs in plain_passages(dict(enumerate(texts)), **more).items() for r in runs for u, d, k in r}
    got = substring_dedup.repeated_passages(docs, **more).collect()
    assert {(r.doc_id, r.unit, r.first_doc_id, r.first_unit) for r in got} == want and len(got) == len(want)
    for r in got:
        assert (r.start, r.end) == plain_units(texts[r.doc_id])[r.unit][:2]
    cut = substring_dedup.without_repeats(docs, **more).collect()
    assert {r.doc_id: r.text for r in cut} == plain_cut(dict(enumerate(texts)), **more)
    assert all(r.n_chars == len(r.text) for r in cut if r.text is not None)
    return got


@pytest.mark.parametrize("rows", [substring_dedup.BROADCAST_ROWS, 0])
def test_passages_inside_lines(make_docs, monkeypatch, rows):
    monkeypatch.setattr(substring_dedup, "BROADCAST_ROWS", rows)
    texts, planted = invented(90, 11)
    found = defaultdict(int)
    for r in check_passages(make_docs, texts):
        found[r.doc_id] = max(found[r.doc_id], r.passage_words)
    assert len(planted) > 20
    assert sum(i in found for i in planted) >= 0.95 * len(planted)
    assert not set(found) - set(planted)


def test_passages(make_docs):
    half = " ".join(f"half{i * 31 % 97}" for i in range(18))
    turned = LONG.replace(" ", "\n", 30).replace("\n", " ", 29)
    texts = [f"own start\n{LONG}\nend", f"{LONG.upper()}  \nother", f"x\n{half}\n{half}b\ny", f"z\n{half}\n{half}b", f"short\n{half}", f"{LONG}\n{LONG}", None, ""]
    texts += [f"before it {LONG} and behind", f"a {LONG} b {LONG} c", f"{turned} z", f"q {turned}\nz", f"one two three {LONG}\nfinish"]
    check_passages(make_docs, texts)
    check_passages(make_docs, texts, min_words=1)
    left = {r.doc_id: r.text for r in substring_dedup.without_repeats(make_docs(texts)).collect()}
    assert (left[0], left[1], left[3], left[4], left[5]) == (texts[0], "other", "z\n", texts[4], "")
    assert left[8].startswith("before it") and left[8].endswith("and behind") and len(left[8]) < 200
    assert left[12].endswith("\nfinish")


def test_offsets_are_bytes(make_docs):
    line = "é " * 40
    docs = make_docs([f"ß\n{line}", f"日本\n{line}\nq"])
    (r,) = substring_dedup.repeated_passages(docs).collect()
    text = f"日本\n{line}\nq".encode()
    assert text[r.start : r.end].decode() == line.rstrip()
    assert {x.doc_id: x.text for x in substring_dedup.without_repeats(docs).collect()}[1] == "日本\nq"


def test_passage_edges(edge_docs, no_docs):
    got = substring_dedup.repeated_passages(edge_docs).collect()
    assert {r.doc_id for r in got} == {10, 11}  # one counts its words round and round, the other holds a line twice
    assert substring_dedup.repeated_passages(no_docs).count() == substring_dedup.without_repeats(no_docs).count() == 0
    for name in ("_id", "_cuts", "_bytes", "version", "cuts", "bytes", "of", "Cuts_", "a.b", "unit", "digest_a", "run"):
        edge_docs = edge_docs.withColumn(name, F.lit(7)) if name.lower() not in {c.lower() for c in edge_docs.columns} else edge_docs
    left = substring_dedup.without_repeats(edge_docs)
    assert left.columns == edge_docs.columns and left.count() == edge_docs.count()
    assert all(r["bytes"] == r["version"] == r["_bytes"] == r["a.b"] == 7 for r in left.collect())
    changed = left.join(edge_docs.select("doc_id", F.col("text").alias("was")).distinct(), "doc_id").where("text <> was")
    assert {r.doc_id for r in changed.select("doc_id").collect()} == {10, 11}


def test_rows_with_one_doc_id(make_docs):
    """Equal rows are one document; different texts under one id are different documents."""
    texts = [(1, LONG), (1, LONG), (2, f"other start {LONG}"), (2, f"日本 {LONG}"), (None, LONG), (3, "alone")]
    docs = make_docs([t for _, t in texts], [i for i, _ in texts])
    assert {r.doc_id for r in substring_dedup.repeated_passages(docs).collect()} == {2}
    left = sorted((r.doc_id or 0, r.text) for r in substring_dedup.without_repeats(docs).collect())
    assert left[:3] == [(0, LONG), (1, LONG), (1, LONG)] and len(left) == 6
    assert all(len(t) < 100 for i, t in left if i == 2)


def test_hashes_keep_words_apart(make_docs):
    """Sequences that linear hashes modulo 2^64 take for equal."""
    turns = ["".join("ab"[(bin(i).count("1") + k) % 2] for i in range(n)) for n in (1024, 4096) for k in (0, 1)]
    texts = [f"{t} {' '.join(f'{t}{i}' for i in range(40))}" for t in turns]
    texts += [" ".join(("left", "right")[(bin(i).count("1") + k) % 2] for i in range(4096)) for k in (0, 1)]
    got = near_dedup.near_duplicates(make_docs(texts)).collect()
    assert {r.component_id for r in got if r.doc_id < 4} == set(range(4))
    rows = [r for r in substring_dedup.repeated_passages(make_docs(texts)).collect() if r.doc_id != r.first_doc_id]
    assert rows == []
