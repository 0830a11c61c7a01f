import numpy as np
import pytest
from pyspark.sql import functions as F

from meterline.operators import kernels, ledger, series, shots
from meterline.plans import config, schemas
from meterline.sources import documents, media

K = ["k"]


def test_hold_last(spark):
    rows = [(0, 0, None), (0, 1, 5.0), (0, 2, None), (1, 0, None)]
    got = series.hold_last(spark.createDataFrame(rows, "k int, i int, v double"), K).orderBy("k", "i").collect()
    assert [r.v for r in got] == [5.0, 5.0, 5.0, 0.0]


def test_nearest_ties_go_to_the_earlier(spark):
    points = spark.createDataFrame([(0, 1.0), (0, -3.0), (0, 9.0), (1, 0.0)], "k int, t double")
    events = spark.createDataFrame([(0, 0, 0.0), (0, 1, 2.0)], "k int, i int, t double")
    got = {(r.k, r.t): (r.nearest_index, r.offset) for r in series.nearest(points, events, K).collect()}
    assert got == {(0, 1.0): (0, 1.0), (0, -3.0): (0, -3.0), (0, 9.0): (1, 7.0), (1, 0.0): (None, None)}


def test_series_document_round_trip(spark):
    s = spark.createDataFrame([(0, i, i / 8) for i in range(9)], "k int, i long, v double")
    packed = series.packed(s, K, "dbfs", 0.0, 0.01, "ratio")
    assert packed.first().series.values == [round(i / 8, 3) for i in range(9)]
    assert [round(r.t, 6) for r in series.unpacked(packed, K).orderBy("i").collect()] == [round(i * 0.01, 6) for i in range(9)]


def test_representative_times(spark):
    row = spark.range(1).select(shots.representative_times(F.lit(0.0), F.lit(3.0)).alias("a"), shots.representative_times(F.lit(0.0), F.lit(6.0)).alias("b")).first()
    assert row.a == [1.5] and row.b == [2.0, 4.0]


def test_partition(spark):
    good = spark.createDataFrame([(0, 48, 96), (0, 0, 48), (0, 96, 120)], "k int, start_frame int, end_frame int")
    got = shots.partition(good, K, F.lit(24.0)).orderBy("idx").collect()
    assert [(r.start_frame, r.start, r.end) for r in got] == [(0, 0.0, 2.0), (48, 2.0, 4.0), (96, 4.0, 5.0)]
    for bad in ([(0, 0, 48), (0, 50, 96)], [(0, 48, 48)]):
        with pytest.raises(Exception, match="gap or overlap|empty shot"):
            shots.partition(spark.createDataFrame(bad, "k int, start_frame int, end_frame int"), K, F.lit(24.0)).collect()


def test_cuts_keep_their_distance(spark):
    values = [0, 0, 90, 0, 0, 0, 0, 90, 90, 90]
    frames = spark.createDataFrame([(0, i, float(v), 0.0, 0.0) for i, v in enumerate(values)], "k int, frame int, h double, s double, v double")
    assert [r.frame for r in shots.cuts_from_deltas(frames, K, 27.0, 3).orderBy("frame").collect()] == [3, 7]


def test_motion_of_an_empty_shot(spark):
    shot = spark.createDataFrame([(0, 0, 0.0, 1.0), (0, 1, 1.0, 1.1)], "k int, idx int, start double, end double")
    pairs = spark.createDataFrame([(0, 0.2, 1.0), (0, 0.4, 3.0)], "k int, t double, value double")
    assert [(r.idx, r["mean"], r.p95) for r in shots.motion(shot, pairs, K).orderBy("idx").collect()] == [(0, 2.0, 2.9), (1, 0.0, 0.0)]


def test_palette_of_two_colours(spark):
    pixels = spark.createDataFrame([(0, 255, 0, 0)] * 70 + [(0, 0, 0, 255)] * 30, "k int, r int, g int, b int")
    palette = shots.palettes(pixels, K).first().palette
    assert [(p.hex, p.proportion) for p in palette] == [("#ff0000", 0.7), ("#0000ff", 0.3)]


def click_track(seconds=30.0):
    y = np.zeros(int(seconds * kernels.RATE), np.float32)
    burst = np.sin(2 * np.pi * 1500 * np.arange(441) / kernels.RATE)
    times = np.arange(0.25, seconds - 0.1, 0.5)
    for n, t in enumerate(times):
        at = int(t * kernels.RATE)
        y[at : at + 441] += (0.9 if n % 4 == 0 else 0.45) * burst
    return y, times


def test_click_track():
    y, times = click_track()
    got = kernels.track_features(y)
    assert 119 <= got["bpm_global"] <= 121
    beats = np.array(got["beats"])
    assert np.mean([np.abs(beats - t).min() <= 0.03 for t in times]) >= 0.9
    first = beats[got["downbeat_offset"]]
    assert min(abs(first - t) for t in times[::4]) <= 0.03
    assert kernels.track_features(y) == got


def test_silence():
    got = kernels.track_features(np.zeros(44100, np.float32))
    assert set(got["centroid_hz"]) == {0.0} and set(got["rms_db"]) == {-80.0}
    assert (got["onset_times"], got["strength_reference"], got["integrated_lufs"]) == ([], 1.0, -70.0)


def test_loudness_of_a_tone():
    t = np.arange(5 * 48000) / 48000
    assert abs(kernels.integrated_lufs(np.sin(2 * np.pi * 997 * t)[:, None], 48000) + 3.01) < 0.1


def test_pcm_features(spark):
    y, _ = click_track(4.0)
    pcm = (np.stack([y, y], axis=1) * 32767).astype("<i2").tobytes()
    df = spark.createDataFrame([("a", bytearray(pcm))], "track_id string, pcm binary")
    assert len(kernels.features_of_pcm(df).first().rms_db) == 401
    assert media.pcm(df).first().duration_seconds == 4.0


def test_cost_estimate(spark):
    calls = spark.createDataFrame([("claude-haiku-4-5", [(1000, 750)]), ("claude-haiku-4-5", [(750, 750), (750, 750)])], "model string, frames array<struct<width:int,height:int>>")
    row = ledger.cost_estimate(calls, ledger.prices(spark), [], prompt_tokens=200, max_output_tokens=300).first()
    assert (row.calls, row.input_tokens, row.output_tokens) == (2, 2900, 600)
    with pytest.raises(Exception, match="no price"):
        ledger.cost_estimate(calls.withColumn("model", F.lit("other")), ledger.prices(spark), []).collect()


def test_latest_and_retention(spark):
    log = spark.createDataFrame([("a", "1", "x", True), ("a", "2", "y", False), ("b", "1", "z", True)], "track_id string, started_at string, path string, retained boolean")
    assert {r.track_id: r.path for r in ledger.latest(log, ["track_id"]).collect()} == {"a": "y", "b": "z"}
    assert [r.path for r in ledger.retained(log, ["track_id"]).collect()] == ["x"]


def test_config(tmp_path):
    base = config.Config()
    assert config.load(default=str(tmp_path / "none.toml")) == base
    with pytest.raises(FileNotFoundError):
        config.load(str(tmp_path / "none.toml"))
    (tmp_path / "m.toml").write_text("[lyrics]\nlanguage = 'de'\n[features]\nvocal_enter_db = -30.0\n")
    other = config.load(str(tmp_path / "m.toml"))
    assert config.section_hash(other.lyrics) != config.section_hash(base.lyrics)
    assert config.section_hash(other.video) == config.section_hash(base.video)
    for bad in ({"video": {"caption_backend": "x"}}, {"stems": {"cpu_threads": 0}}, {"nothing": {}}, {"lyrics": {"odd": 1}}):
        with pytest.raises(config.ConfigError):
            config.parse(bad)


def test_documents(spark, tmp_path):
    for kind in schemas.DDL:
        assert schemas.schema(kind).fieldNames()
    (tmp_path / "d.json").write_text('{"schema_version": "1.0.0",\n "track_id": "0123456789abcdef", "tempo": {"bpm_global": 0.0, "confidence": 2.0}}')
    doc = documents.read(spark, str(tmp_path / "d.json"), "audio_features")
    assert {r.constraint.split()[0] for r in documents.faults(doc, "audio_features").collect()} == {"tempo.bpm_global", "tempo.confidence"}
    text = documents.with_hash(doc, "audio_features").first().document
    assert text == '{"schema_version":"1.0.0","track_id":"0123456789abcdef","tempo":{"bpm_global":0.0,"confidence":2.0}}'
    assert documents.pretty(text).endswith("}\n") and '  "track_id"' in documents.pretty(text)
    documents.write(doc, "audio_features", str(tmp_path / "lib"))
    assert documents.stored(spark, str(tmp_path / "lib"), "audio_features").collect() == doc.collect()


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("First line of words\nSecond line\n\nThird after a blank\n")
    (tmp_path / "b.lrc").write_text("[00:01]x\n")
    (tmp_path / "c.bin").write_bytes(b"\x00" * 10)
    found = {r["format"]: r for r in media.read_lyrics(spark, f"{tmp_path}/*.[lt][rx][ct]").collect()}
    assert (found["txt"].line_count, found["txt"].has_timestamps, found["lrc"].has_timestamps) == (3, False, True)
    import hashlib

    ids = {r.filename: r.track_id for r in media.files(spark, str(tmp_path)).collect()}
    assert ids["c.bin"] == hashlib.sha256(b"\x00" * 10).hexdigest()[:16]


def test_features_take_one_pass_over_spectra(monkeypatch):
    passes = []
    plain = kernels.spectra
    monkeypatch.setattr(kernels, "spectra", lambda y: passes.append(len(y)) or plain(y))
    kernels.track_features(click_track(2.0)[0])
    assert passes == [2 * kernels.RATE]


def test_tracks_are_dealt_out_though_they_are_few_bytes(spark):
    samples = spark.range(48).select(F.col("id").cast("string").alias("track_id"), F.lit(500).cast("long").alias("i"), F.lit(0.5).alias("v"))
    found = kernels.features_of_samples(samples).select("track_id", F.spark_partition_id().alias("task")).collect()
    assert len(found) == 48 and len({r.task for r in found}) > 6
