import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from meterline import cli
from meterline.functions.scalars import content_sha256
from meterline.operators import kernels, ledger, lines, shots
from meterline.plans import config, schemas, stages
from meterline.plans.library import Library
from meterline.sources import documents, media

T = "0123456789abcdef"


def bursts(seconds=10.0):
    t = np.arange(int(seconds * kernels.RATE)) / kernels.RATE
    on = ((t >= 2) & (t < 4)) | ((t >= 6) & (t < 8))
    return (0.15 * np.sin(2 * np.pi * 440 * t) * on).astype(np.float32)


def features_of(spark):
    rows = []
    for c in stages.CHANNELS:
        y = bursts() if c in ("mix", "vocals") else np.zeros(kernels.RATE, np.float32)
        rows.append({"track_id": T, "channel": c, **kernels.track_features(y)})
    channels = spark.createDataFrame(rows, f"track_id string, channel string, {kernels.FEATURES}")
    return stages.audio_features(channels, spark.createDataFrame([(T, 10.0)], "track_id string, duration_seconds double"))


def check(df, kind):
    assert df.schema.simpleString() == schemas.schema(kind).simpleString()
    assert documents.faults(df, kind).count() == 0
    return df.first()


def test_source(spark):
    files = spark.createDataFrame([(T, "/m/song.flac", "song.flac", 9, "ab" * 32), ("f" * 16, "/m/mute.mp4", "mute.mp4", 9, "cd" * 32)], "track_id string, path string, filename string, size_bytes long, sha256 string")
    text = json.dumps({"format": {"format_name": "flac", "duration": "2.0", "tags": {"title": "", "artist": "A"}}, "streams": [{"codec_type": "audio", "codec_name": "flac", "sample_rate": "44100", "channels": 2}]})
    mute = json.dumps({"format": {"format_name": "mp4"}, "streams": [{"codec_type": "video", "codec_name": "h264", "avg_frame_rate": "0/0", "r_frame_rate": "24/1"}]})
    probes = media.probed(spark.createDataFrame([(T, text), ("f" * 16, mute)], "track_id string, probe string"))
    audio = media.pcm(spark.createDataFrame([(T, bytearray(44100 * 4 * 2)), ("f" * 16, bytearray(4))], "track_id string, pcm binary"))
    doc = stages.source(files, probes, audio)
    row = check(doc, "source")
    assert doc.count() == 1 and row.media.tags.artist == "A" and row.media.tags.title is None and row.normalized_audio.duration_seconds == 2.0 and row.lyrics_input is None


def test_features_and_lyrics(spark):
    features = features_of(spark).cache()
    row = check(features, "audio_features")
    regions = [(r.start_seconds, r.end_seconds) for r in row.vocal_activity.regions]
    assert len(regions) == 2 and all(abs(a - b) < 0.05 for r, w in zip(regions, [(2, 4), (6, 8)], strict=True) for a, b in zip(r, w, strict=True))
    assert set(row.stems.drums.spectral_centroid_hz["values"]) == {0.0} and row.stems.drums.onsets.strength_reference == 1.0
    segments = spark.createDataFrame([(T, 0, " one two ", 2.1, 3.5, 0.05, 1.2), (T, 1, "ghost", 4.5, 5.5, 0.9, 1.2), (T, 2, "  ", 9.0, 9.5, 0.0, 1.0)], "track_id string, seg_idx int, text string, start double, end double, no_speech_prob double, compression_ratio double")
    words = spark.createDataFrame([(T, 0, 0, "one", 2.1, 2.4, 0.9), (T, 0, 1, " two", 2.5, 3.5, 0.8), (T, 0, 2, " ", 3.5, 3.5, 0.1), (T, 1, 0, "ghost", 4.5, 11.5, 0.3)], "track_id string, seg_idx int, word_idx int, text string, start double, end double, probability double")
    durations = spark.createDataFrame([(T, 10.0)], "track_id string, duration_seconds double")
    tracks = spark.createDataFrame([(T, "en")], "track_id string, detected_language string")
    doc = check(stages.lyrics(tracks, stages.transcribed_lines(segments, words, durations), features, "transcribed"), "lyrics")
    assert [(x.text, x.flags) for x in doc.lines] == [("one two", []), ("ghost", ["low_confidence", "long_word_duration", "possibly_non_lexical", "outside_vocal_activity"])]
    assert [w.text for w in doc.lines[0].words] == ["one", "two"] and doc.lines[0].confidence == 0.85
    assert doc.coverage.lines_flagged_ratio == 0.5 and doc.supplied_markup is None and doc.engine.language_source == "detected_vocal_window"
    assert doc.untranscribed_regions == [] or all(r.end_seconds - r.start_seconds >= 1.0 for r in doc.untranscribed_regions)
    empty = check(stages.lyrics(tracks, stages.transcribed_lines(segments.limit(0), words, durations), features, "transcribed"), "lyrics")
    assert empty.lines == [] and empty.coverage.lines_flagged_ratio == 0.0 and len(empty.untranscribed_regions) == 2
    supplied = lines.parse_supplied(spark.createDataFrame([(T, "[Verse 1]\none two\nzzz")], "track_id string, text string"), "track_id")
    sung = supplied.where("label is null").select("track_id", F.col("source_line_index").alias("line_idx"), "text", "hint_seconds")
    observed = words.where("seg_idx = 0 and word_idx < 2").select("track_id", "word_idx", "text", "start", "end")
    aligned = stages.aligned_lines(lines.anchor_lines(sung, observed))
    told = check(stages.lyrics(tracks, aligned, features, "aligned", supplied.where("label is not null")), "lyrics")
    assert [(x.text, x.start_seconds) for x in told.lines] == [("one two", 2.1), ("zzz", 3.5)] and told.supplied_markup[0].label == "verse"
    assert told.lines[1].flags[:3] == ["low_confidence", "unaligned", "timing_interpolated"]
    assert {(round(r.start, 1), round(r.end, 1)) for r in stages.clip_windows(features).collect()} == {(1.5, 4.5), (5.5, 8.5)}
    assert stages.detection_windows(features).count() == 2


def test_video_and_structure(spark):
    fps = F.lit(24.0)
    tracks = spark.createDataFrame([(T, 240)], "track_id string, frame_count int")
    cuts = spark.createDataFrame([(T, 72), (T, 144)], "track_id string, frame int")
    parts = shots.partition(shots.from_cuts(tracks, cuts, ["track_id"]), ["track_id"], fps)
    plan = shots.frame_plan(parts, ["track_id"], fps).withColumn("sha256", content_sha256("name"))
    pairs = spark.createDataFrame([(T, 0.5, 0.1)], "track_id string, t double, value double")
    pixels = parts.select("track_id", "idx", F.lit(255).alias("r"), F.lit(0).alias("g"), F.lit(0).alias("b"))
    videos = stages.video(parts, plan, shots.motion(parts, pairs, ["track_id"]), shots.palettes(pixels, ["track_id", "idx"]))
    row = check(videos, "video")
    assert [(s.start_seconds, len(s.representative_frames), s.palette[0].hex) for s in row.shots] == [(0.0, 1, "#ff0000"), (3.0, 1, "#ff0000"), (6.0, 2, "#ff0000")]
    assert (row.video_span.end_seconds, row.shots[0].motion["mean"], row.shots[1].motion.p95, row.shots[0].caption) == (10.0, 0.1, 0.0, None)
    grid = spark.createDataFrame([(T, 0, [i * 0.5 for i in range(20)])], "track_id string, off int, times array<double>").select("track_id", F.struct("times", F.lit(4).alias("beats_per_bar"), F.col("off").alias("downbeat_offset")).alias("beats"))
    sections = spark.createDataFrame([(T, "verse", 0.0, 4.0, 0.9, ["novelty"]), (T, "chorus", 4.0, 8.0, 0.8, ["novelty"]), (T, "verse", 8.0, 10.0, 0.7, ["novelty"])], "track_id string, label string, start double, end double, confidence double, evidence array<string>")
    got = check(stages.structure(sections, grid, videos), "structure")
    assert [(s.label, s.occurrence, s.start_beat_index, s.start_bar_index) for s in got.sections] == [("verse", 1, 0, 0), ("chorus", 1, 8, 2), ("verse", 2, 16, 4)]
    assert got.editing.on_beat_cut_ratio == 1.0 and [c.nearest_beat_index for c in got.editing.cuts] == [6, 12] and got.editing.cuts_per_bar_global == 0.4
    wide = plan.withColumn("width", F.lit(1280)).withColumn("height", F.lit(720))
    none = spark.createDataFrame([], "cache_key string, caption string")
    calls = stages.caption_calls(wide, none)
    assert ledger.cost_estimate(calls, ledger.prices(spark), []).first().calls == 3
    one = calls.limit(1).select("cache_key", F.lit("x").alias("caption"))
    assert stages.caption_calls(wide, one).count() == 2


def test_library(spark, tmp_path, capsys):
    root = f"file://{tmp_path}/lib"
    library = Library(spark, root)
    assert library.status().count() == library.track_ids().count() == 0
    tracks = spark.createDataFrame([(T, "Song", None, False), ("f" * 16, "Other", None, True)], "track_id string, title string, artist string, has_video boolean")
    library.add_tracks(tracks)
    library.add_tracks(tracks)
    assert library.facts().count() == 2 and library.work_list("audio_features").count() == 2
    features = features_of(spark)
    usage = spark.createDataFrame([(T, (3, 100, 20, 0.25, 0.5))], f"track_id string, api_usage {schemas.USAGE}")
    library.store("audio_features", features, usage)
    assert [r.track_id for r in library.work_list("audio_features").collect()] == ["f" * 16]
    assert library.documents("audio_features").first() == features.first()
    shown = {(r.track_id, r.stage): r.shown for r in library.status().collect()}
    assert shown[T, "audio_features"] == "ok" and shown[T, "video"] == "not_applicable" and shown["f" * 16, "video"] == "pending"
    other = Library(spark, root, config.parse({"features": {"vocal_enter_db": -30.0}}))
    assert {(r.track_id, r.stage): r.shown for r in other.status().collect()}[T, "audio_features"] == "stale"
    assert other.work_list("audio_features").count() == 2
    library.fail("lyrics", spark.createDataFrame([(T, "e" * 900)], "track_id string, error string"), usage)
    entry = [r for r in documents.manifest_entries(library.manifests()).collect() if (r.track_id, r.stage) == (T, "lyrics")]
    assert (entry[0].status, entry[0].path, len(entry[0].error)) == ("failed", None, 500)
    assert tuple(library.costs().first()) == (2, 6, 200, 40, 0.5, 1.0)
    assert cli.main(["version"]) == 0 and cli.main(["--config", "/none.toml", "version"]) == 2
    assert cli.main(["costs", root]) == 0 and '"runs": 2' in capsys.readouterr().out
    assert cli.main(["status", root]) == 0 and "lyrics=failed" in capsys.readouterr().out
    assert cli.main(["export-schemas", "--out", str(tmp_path / "s")]) == 0 and (tmp_path / "s/lyrics.schema.json").is_file()


def test_prerequisites_rates_and_frames_are_refused(spark):

    tracks = spark.createDataFrame([("a",), ("b",)], "track_id string")
    entries = spark.createDataFrame([("a", "source", "ok"), ("a", "lyrics", "ok"), ("b", "source", "ok"), ("b", "lyrics", "failed")], "track_id string, stage string, status string")
    assert ledger.required(tracks.where("track_id = 'a'"), entries, ["source", "lyrics"]).count() == 1
    with pytest.raises(Exception, match="track b needs lyrics"):
        ledger.required(tracks, entries, ["source", "lyrics"]).collect()
    rates = spark.createDataFrame([("a", 44100), ("b", 48000)], "track_id string, sample_rate int")
    assert media.at_rate(rates.where("track_id = 'a'")).count() == 1
    with pytest.raises(Exception, match="sample rate 48000, wanted 44100"):
        media.at_rate(rates).collect()
    frames = spark.createDataFrame([("a", i, i * 2) for i in range(5)], "track_id string, frame int, v int")
    plan = spark.createDataFrame([("a", 1), ("a", 4), ("a", 4)], "track_id string, frame int")
    assert sorted(r.v for r in media.frames_at(frames, plan, ["track_id"]).collect()) == [2, 8]
    with pytest.raises(Exception, match="too short: no frame 9"):
        media.frames_at(frames, spark.createDataFrame([("a", 9)], "track_id string, frame int"), ["track_id"]).collect()


def test_a_run_beyond_its_budget_makes_no_call(spark):

    frames = [(100, 75)]
    calls = spark.createDataFrame([(r, ledger.PRICES[0][0], frames, f"{r}-{i}") for r, n in (("small", 2), ("large", 50), ("cached", 50)) for i in range(n)], "run string, model string, frames array<struct<width:int,height:int>>, cache_key string")
    cache = spark.createDataFrame([(f"cached-{i}",) for i in range(49)], "cache_key string")
    gates, allowed = ledger.spendable(calls, cache, ledger.prices(spark), ["run"], 0.01)
    assert {r.run: (r.calls, r.within_budget) for r in gates.collect()} == {"small": (2, True), "large": (50, False), "cached": (1, True)}
    assert sorted(r.cache_key for r in allowed.collect()) == ["cached-49", "small-0", "small-1"]


def test_the_video_is_kept_where_asked(spark):

    rows = spark.sql("select '/x/a.MP4' path, named_struct('video', named_struct('codec', 'h264')) m union all select '/x/b.flac', named_struct('video', null)")
    (own, none), (copied, _) = ([r[0] for r in rows.select(media.video_copy(F.col("path"), c, F.col("m"))).collect()] for c in (False, True))
    assert own == "/x/a.MP4" and none is None and copied.startswith("media/") and copied.endswith(".mp4") and len(copied) == len("media/") + 64 + 4
