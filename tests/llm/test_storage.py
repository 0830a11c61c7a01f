import zlib
from collections import Counter

import pyarrow.fs
import pytest
from pyspark.sql import functions as F

from meterline.llm import sharding, warc
from meterline.llm.workspace import Workspace

from ..conftest import DATA


def test_shards(spark, make_docs):
    texts = ["x" * (i * 37 % 500) for i in range(900)]
    rows = sharding.shard(make_docs(texts), 8).collect()
    sizes = [0] * 8
    for r in rows:
        sizes[r.shard] += r.size
        assert r.size == len(texts[r.doc_id]) + 1 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode())
    assert max(sizes) - min(sizes) <= max(r.size for r in rows)
    for k in range(8):
        assert sorted(r.slot for r in rows if r.shard == k) == list(range(sum(r.shard == k for r in rows)))
    assert len({(r.virtual_slot, r.shard) for r in rows}) == len({r.virtual_slot for r in rows})


def test_shard_edges(spark, edge_docs, no_docs):
    rows = sharding.shard(edge_docs).collect()
    assert len(rows) == edge_docs.count() and {r.size for r in rows if r.doc_id in (0, 1)} == {1} and {r.text_crc32 for r in rows if r.doc_id == 0} == {0}
    assert sharding.shard(no_docs).count() == 0


def plain_places(rows, n_shards):
    """(shard, slot) of each record by its virtual slot: heaviest slot to the lightest shard, places in order of slots."""
    size = Counter()
    for r in rows:
        size[r.virtual_slot] += r.size
    held, count, shard = [0] * n_shards, [0] * n_shards, {}
    for s in sorted(range(sharding.SLOTS), key=lambda s: (-size[s], s)):
        k = min(range(n_shards), key=lambda k: (held[k], count[k], k))
        shard[s], held[k], count[k] = k, held[k] + size[s], count[k] + 1
    out, at = {}, [0] * n_shards
    for r in sorted(rows, key=lambda r: (r.virtual_slot, r.doc_id is not None, r.doc_id or 0, r.text_crc32, r.size, r.copy)):
        k = shard[r.virtual_slot]
        out[r.doc_id, r.text_crc32, r.copy], at[k] = (k, at[k]), at[k] + 1
    return out


def test_query_against_a_plain_version(spark):
    got = {r.doc_id: r for r in sharding.op6_virtual_slot_sharding(spark, str(DATA)).collect()}
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    assert {i: (r.size, r.text_crc32) for i, r in got.items()} == {i: (len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in docs.items()}
    rows = sharding.shard(spark.read.parquet(f"{DATA}/documents.parquet"), 8).collect()
    places = plain_places(rows, 8)
    assert {i: (r.shard, r.slot) for i, r in got.items()} == {i: places[i, r.text_crc32, 0] for i, r in got.items()}
    assert {(r.law, r.grown_shard) for r in got.values()} == {("bytes", None)}


@pytest.mark.parametrize("run", [sharding.RUN, 1000])
def test_equal_records_are_spread(spark, monkeypatch, run):
    """A hundred thousand equal rows beside others: no slot holds them all, and shards stay even."""
    monkeypatch.setattr(sharding, "RUN", run)
    docs = spark.range(100_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"))
    docs = docs.union(spark.range(20_000).select(F.lit(5).cast("long"), F.lit("the same"))).union(spark.range(30_000).select("id", F.col("id").cast("string")))
    rows = sharding.shard(docs, 8)
    assert rows.groupBy("virtual_slot").count().agg(F.max("count")).first()[0] < 200
    sizes = rows.groupBy("shard").agg(F.sum("size").alias("b"), F.count("*").alias("n"), F.max("slot").alias("top"), F.countDistinct("slot").alias("places")).collect()
    assert sum(r.n for r in sizes) == 150_000 and all(r.n == r.places == r.top + 1 for r in sizes)
    assert max(r.b for r in sizes) - min(r.b for r in sizes) <= 0.01 * sum(r.b for r in sizes)


def test_rebalancing_edits_the_map():
    sizes = {s: 10 + s * 7919 % 90 for s in range(512)}
    first = sharding.plan_map(sizes, 8, n_slots=512)
    load = lambda m, n: [sum(sizes[s] for s in m if m[s] == k) for k in range(n)]
    assert max(load(first, 8)) - min(load(first, 8)) <= 100
    grown = sharding.plan_map(sizes, 9, first, n_slots=512)
    assert sum(first[s] != grown[s] for s in first) < 512 / 9 * 1.5 and max(load(grown, 9)) - min(load(grown, 9)) <= 100
    changed = sizes | {s: 400 for s in first if first[s] == 0}
    moved = sharding.plan_map(changed, 8, first, n_slots=512)
    assert all(moved[s] == first[s] for s in first if first[s] != 0 and moved[s] == first[s])
    assert sharding.plan_map(sizes, 8, first, n_slots=512) == sharding.plan_map(sizes, 8, first, n_slots=512)
    assert sharding.plan_map({}, 3, n_slots=5) and sharding.plan_map({}, 1, {s: 0 for s in range(5)}, n_slots=5) == {s: 0 for s in range(5)}


def test_map_versions_stay(spark):
    stored = sharding.SlotMap(spark, Workspace(spark, "test").path("map"))
    stored.append({0: 0, 1: 1}, 2, 1)
    stored.append({0: 0, 1: 2}, 3, 2)
    assert stored.planned(1) == {0: 0, 1: 1} and stored.planned(2) == {0: 0, 1: 2}


PAGES = [(1, "http://a/ü b", "<p>é</p>"), (2, "http://b", "<p>é</p>"), (3, None, None), (4, "http://d\r\nX: y", ""), (5, "http://e", "line\r\n\r\nWARC/1.1\r\n"), (None, "http://n", "<p>é</p>"), (6, "http://f", "x" * 200000), (2, "http://b", "<p>é</p>")]


def test_archives(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("offset", F.lit(1)).withColumn("sha", F.lit(1))
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.archive_round_trip(pages).collect()), key=str)
    size = {i: len((h or "").encode()) for i, _, h in PAGES}
    digest = {i: warc.digest_of((h or "").encode()) for i, _, h in PAGES}
    kinds = {1: 2, 3: 4, None: 2}
    assert got == sorted(((i, size[i], digest[i], "revisit" if i in kinds else "response", kinds.get(i)) for i, _, _ in PAGES), key=str)


@pytest.mark.parametrize("least", [0, 9])
def test_shuffled_classes_and_small_payloads(spark, monkeypatch, least):
    monkeypatch.setattr(warc, "BROADCAST_CLASSES", 0)
    pages = spark.createDataFrame([(i, "u", "same" if i % 2 else "a longer one") for i in range(20)], "page_id long, url string, html string")
    got = {r.page_id: r.refers_to for r in warc.archive_round_trip(pages, min_bytes=least).collect()}
    assert got == {i: None if i >= 18 or (i % 2 and least) else (19 if i % 2 else 18) for i in range(20)}


def test_index_and_ranges(spark, monkeypatch):
    ws = Workspace(spark, "test")
    pages = spark.createDataFrame([(i, f"http://x/{i}", f"page {i} " * (i % 50)) for i in range(300)], "page_id long, url string, html string").coalesce(2)
    index = ws.write(warc.write_archives(pages, ws.path("a")), "index")
    store, top = warc.folder(ws.path("a"))
    for r in index.where("page_id % 50 = 7").collect():
        with store.open_input_file(f"{top}/{r.archive}") as f:
            found = warc.parse(f.read_at(r.length, r.offset))
        assert found["page_id"] == r.page_id and found["payload_digest"] == r.digest and found["url"] == r.url
    files = store.get_file_info(pyarrow.fs.FileSelector(top))
    assert sum(f.size for f in files) == index.agg(F.sum("length")).first()[0]
    assert warc.read_records(index, ws.path("a")).rdd.getNumPartitions() >= index.select("archive").distinct().count()
    some = warc.read_records(index.where("page_id in (3, 4, 299)"), ws.path("a")).collect()
    assert {(r.page_id, bytes(r.payload).decode()) for r in some} == {(i, f"page {i} " * (i % 50)) for i in (3, 4, 299)}


def test_records_have_ids_of_their_own():
    names = [warc.zlib.decompress(warc._compressed(warc.record(i, "u", p, to, warc.digest_of(p))), 31).split(b"\r\n")[2] for i, p, to in [(1, b"a", 2), (1, b"a", 2), (1, b"b", None), (1, b"c", None), (None, b"a", None), (None, b"a", None)]]
    assert len(set(names)) == len(names)
    told = warc.zlib.decompress(warc._compressed(warc.record(2, "u", b"a", None, warc.digest_of(b"a"))), 31).split(b"\r\n")[2].partition(b": ")[2]
    assert told in warc.record(1, "u", b"a", 2, warc.digest_of(b"a"))


def test_damage_is_found(spark):
    whole = warc._compressed(warc.record(1, "u", b"payload", None, warc.digest_of(b"other")))
    with pytest.raises(ValueError, match="digest"):
        warc.parse(whole)


def test_no_pages(spark):
    assert warc.archive_round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
