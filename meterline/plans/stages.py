"""Documents from tables: each stage joins its inputs by track id and gives the columns of its document, in schema order.

Decoders, separators and recognisers run outside; what they give comes in as tables. Every stage handles any number of tracks
in one plan. Arrays are built at the very end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rounding import rounded
from ..functions.scalars import cache_key
from ..operators import intervals, lines, series, shots
from ..operators.ledger import uncached
from . import schemas
from .config import Features, Ingest, Lyrics, Video

KEY = ["track_id"]
CHANNELS = ("mix", "vocals", "drums", "bass", "other")
HOP = 0.01


def _in_schema(df: DataFrame, kind: str) -> DataFrame:
    held = df.withColumn("schema_version", F.lit(schemas.VERSIONS[kind]))
    return held.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in schemas.schema(kind).fields))


def source(files: DataFrame, probed: DataFrame, audio: DataFrame, lyrics: DataFrame | None = None, config: Ingest = Ingest()) -> DataFrame:
    """Source documents of files (track_id, path, filename, size_bytes, sha256), media (track_id, media) and decoded audio (track_id,
    audio_stream_sha256, duration_seconds); lyrics (track_id, path, format, sha256, line_count, has_timestamps) where there are any.
    A track without an audio stream gives no document."""
    joined = files.join(probed.where("media.audio is not null"), KEY).join(audio, KEY)
    file = F.struct(F.col("path").alias("original_path"), "filename", "size_bytes", "sha256")
    normal = F.struct(F.lit("audio.flac").alias("path"), F.lit(config.sample_rate).alias("sample_rate"), F.lit(config.channels).alias("channels"), "duration_seconds", "audio_stream_sha256")
    held = joined.select("track_id", file.alias("file"), normal.alias("normalized_audio"), "media")
    if lyrics is None:
        return _in_schema(held.withColumn("lyrics_input", F.lit(None)), "source")
    told = lyrics.select("track_id", F.struct("path", "format", "sha256", "line_count", "has_timestamps").alias("lyrics_input"))
    return _in_schema(held.join(told, KEY, "left"), "source")


def vocal_regions(samples: DataFrame, config: Features = Features()) -> DataFrame:
    """(track_id, start_seconds, end_seconds, mean_rms_db) of activity in rounded dB samples (track_id, i, v)."""
    up = lambda x, d: int(x * 10**d + 0.5) / 10**d if x >= 0 else -int(-x * 10**d + 0.5) / 10**d
    found = intervals.activity_regions(
        samples,
        KEY,
        enter=up(config.vocal_enter_db, 2),
        exit=up(config.vocal_exit_db, 2),
        max_gap=round(up(config.vocal_min_gap_seconds, 3) / HOP),
        min_length=round(up(config.vocal_min_region_seconds, 3) / HOP),
    )
    return found.select("track_id", rounded(F.col("start") * HOP, "seconds").alias("start_seconds"), rounded(F.col("end") * HOP, "seconds").alias("end_seconds"), rounded("mean", "db").alias("mean_rms_db"))


def audio_features(channels: DataFrame, durations: DataFrame, config: Features = Features()) -> DataFrame:
    """Feature documents from channel rows (track_id, channel, and the kernels' columns) of the mix and the four stems."""
    form = lambda values, unit: F.struct(F.lit(unit).alias("unit"), F.lit(0.0).alias("start_seconds"), F.lit(HOP).alias("hop_seconds"), F.col(values).alias("values"))
    part = F.struct(
        form("rms_db", "dbfs").alias("rms_db"),
        form("centroid_hz", "hz").alias("spectral_centroid_hz"),
        F.struct(F.col("onset_times").alias("times"), F.col("onset_strengths").alias("strengths"), "strength_reference").alias("onsets"),
    )
    of = lambda c, x: F.max(F.when(F.col("channel") == c, x))
    beats = F.struct(F.col("beats").alias("times"), F.lit(4).alias("beats_per_bar"), "downbeat_offset", F.lit("assumed_4_4_phase_fit").alias("downbeat_method"))
    tracks = channels.groupBy("track_id").agg(
        of("mix", F.struct("bpm_global", "confidence")).alias("tempo"),
        of("mix", beats).alias("beats"),
        of("mix", F.struct("integrated_lufs")).alias("loudness"),
        *(of(c, part).alias(f"_{c}") for c in CHANNELS),
    )
    vocals = channels.where("channel = 'vocals'").select("track_id", F.posexplode("rms_db").alias("i", "v"))
    found = vocal_regions(vocals, config).groupBy("track_id").agg(F.array_sort(F.collect_list(F.struct("start_seconds", "end_seconds", "mean_rms_db"))).alias("_regions"))
    params = F.struct(*(rounded(F.lit(v), k).alias(n) for n, v, k in (("enter_db", config.vocal_enter_db, "db"), ("exit_db", config.vocal_exit_db, "db"), ("min_region_seconds", config.vocal_min_region_seconds, "seconds"), ("min_gap_seconds", config.vocal_min_gap_seconds, "seconds"))))
    empty = F.expr("cast(array() as array<struct<start_seconds:double,end_seconds:double,mean_rms_db:double>>)")
    joined = tracks.join(durations.select("track_id", "duration_seconds"), KEY).join(found, KEY, "left")
    stems = F.struct(*(F.col(f"_{c}").alias(c) for c in CHANNELS[1:]))
    return _in_schema(joined.withColumn("mix", F.col("_mix")).withColumn("stems", stems).withColumn("vocal_activity", F.struct(params.alias("params"), F.coalesce("_regions", empty).alias("regions"))), "audio_features")


def transcribed_lines(segments: DataFrame, words: DataFrame, durations: DataFrame) -> DataFrame:
    """(track_id, line_idx, text, start, end, words, no_speech, compression) from segments (track_id, seg_idx, text, start, end,
    no_speech_prob, compression_ratio) and words (track_id, seg_idx, word_idx, text, start, end, probability), moved into the
    track's time; blank words and empty segments are dropped."""
    limits = durations.select("track_id", "duration_seconds")
    timed = words.join(limits, KEY)
    first, last = lines.clamped(F.col("start"), F.col("end"), F.col("duration_seconds"))
    held = timed.withColumn("_s", first).withColumn("_e", last).groupBy("track_id", "seg_idx").agg(F.array_sort(F.collect_list(F.struct("word_idx", "text", F.col("_s").alias("start"), F.col("_e").alias("end"), "probability"))).alias("_w"))
    first, last = lines.clamped(F.col("start"), F.col("end"), F.col("duration_seconds"))
    joined = segments.where(F.trim("text") != "").join(limits, KEY).withColumn("_s", first).withColumn("_e", last).join(held, ["track_id", "seg_idx"], "left")
    none = F.expr("cast(array() as array<struct<word_idx:int,text:string,start:double,end:double,probability:double>>)")
    return joined.select("track_id", F.col("seg_idx").cast("long").alias("line_idx"), F.trim("text").alias("text"), F.col("_s").alias("start"), F.col("_e").alias("end"), lines.words_of(F.coalesce("_w", none)).alias("words"), F.col("no_speech_prob").alias("no_speech"), F.col("compression_ratio").alias("compression"))


def aligned_lines(anchored: DataFrame) -> DataFrame:
    """The same columns, with confidence and the flags they have so far, from the lines that ``anchor_lines`` gives."""
    words = F.transform("words", lambda w: F.struct(w["text"].alias("text"), rounded(w["start"], "seconds").alias("start_seconds"), rounded(w["end"], "seconds").alias("end_seconds"), w["confidence"].alias("confidence")))
    return anchored.select("track_id", "line_idx", "text", "start", "end", words.alias("words"), F.lit(None).cast("double").alias("no_speech"), F.lit(None).cast("double").alias("compression"), "confidence", F.col("flags").alias("base"))


def lyrics(tracks: DataFrame, told: DataFrame, features: DataFrame, mode: str, markup: DataFrame | None = None, config: Lyrics = Lyrics(), engine: str = "external") -> DataFrame:
    """Lyrics documents for tracks (track_id, detected_language), lines as above, and feature documents. ``markup``: (track_id,
    source_line_index, text, label, hint_seconds) of section markup; a track without any has no such field."""
    held = told if "base" in told.columns else told.withColumn("base", F.expr("cast(array() as array<string>)")).withColumn("confidence", rounded(lines.mean_confidence(F.col("words")), "ratio"))
    act = features.select("track_id", F.col("vocal_activity.regions").alias("_r"), F.col("stems.vocals.rms_db.values").alias("_v"), F.col("stems.vocals.rms_db.hop_seconds").alias("_hop"))
    regions = act.select("track_id", F.inline("_r")).select("track_id", F.col("start_seconds").alias("start"), F.col("end_seconds").alias("end"))
    spans = held.select("track_id", "start", "end").distinct()
    placed = held.join(lines.flag_outside(spans, regions, KEY, width=30.0), ["track_id", "start", "end"])
    one = F.struct("start", "line_idx", "end", "text", "confidence", "words", "base", "no_speech", "compression", "outside")
    by_track = placed.groupBy("track_id").agg(F.array_sort(F.collect_list(one)).alias("_lines"))
    rules = lines.LineRules(config.confidence_threshold, config.long_word_seconds, config.flag_no_speech_threshold, config.compression_ratio_threshold, config.overlap_rms_db)
    # The loud share needs the track's samples: they stay one array in the track's row while its lines are gone through.
    flags = lambda x: lines.line_flags(x["base"], x["words"], x["no_speech"], x["compression"], series.loud_share(F.col("_v"), x["start"], x["end"], F.col("_hop"), rules.overlap_db), x["outside"], rules)
    shaped = F.transform("_lines", lambda x: F.struct(x["text"].alias("text"), rounded(x["start"], "seconds").alias("start_seconds"), rounded(x["end"], "seconds").alias("end_seconds"), x["confidence"].alias("confidence"), flags(x).alias("flags"), x["words"].alias("words")))
    covers = held.select("track_id", F.inline("words")).select("track_id", F.col("start_seconds").alias("start"), F.col("end_seconds").alias("end"))
    uncovered = intervals.subtract(regions, covers, KEY, config.uncovered_min_seconds, width=30.0)
    gaps = uncovered.groupBy("track_id").agg(F.array_sort(F.collect_list(F.struct(rounded("start", "seconds").alias("start_seconds"), rounded("end", "seconds").alias("end_seconds")))).alias("untranscribed_regions"))
    covered = intervals.coverage(regions, covers, KEY, width=30.0)
    joined = tracks.join(act, KEY).join(by_track, KEY, "left").join(gaps, KEY, "left").join(covered, KEY, "left")
    language, how = lines.language_source(F.lit(config.language).cast("string"), F.size("_r"), F.col("detected_language"), config.fallback_language)
    no_lines = F.col("_lines").isNull()
    built = joined.withColumn("lines", F.when(no_lines, F.expr("cast(array() as array<struct<text:string,start_seconds:double,end_seconds:double,confidence:double,flags:array<string>,words:array<struct<text:string,start_seconds:double,end_seconds:double,confidence:double>>>>)")).otherwise(shaped))
    flagged = F.when(F.size("lines") > 0, F.size(F.filter("lines", lambda x: F.size(x["flags"]) > 0)) / F.size("lines")).otherwise(0.0)
    built = built.withColumn("coverage", F.struct(rounded(F.coalesce("covered_ratio", F.lit(1.0)), "ratio").alias("vocal_activity_covered_ratio"), rounded(flagged, "ratio").alias("lines_flagged_ratio")))
    built = built.withColumn("mode", F.lit(mode)).withColumn("language", language).withColumn("engine", F.struct(F.lit(engine).alias("name"), F.lit(config.model).alias("model"), how.alias("language_source")))
    built = built.withColumn("untranscribed_regions", F.coalesce("untranscribed_regions", F.expr("cast(array() as array<struct<start_seconds:double,end_seconds:double>>)")))
    if markup is None:
        return _in_schema(built.withColumn("supplied_markup", F.lit(None)), "lyrics")
    marks = markup.groupBy("track_id").agg(F.array_sort(F.collect_list(F.struct("source_line_index", "text", "label", "hint_seconds"))).alias("_m"))
    shape = F.transform("_m", lambda m: F.struct(m["text"].alias("text"), m["label"].alias("label"), m["source_line_index"].alias("source_line_index"), m["hint_seconds"].alias("hint_seconds")))
    return _in_schema(built.join(marks, KEY, "left").withColumn("supplied_markup", shape), "lyrics")


def video(partition: DataFrame, stills: DataFrame, motion: DataFrame, palettes: DataFrame, captions: DataFrame | None = None, config: Video = Video()) -> DataFrame:
    """Video documents from shots (track_id, idx, start_frame, end_frame, start, end), stills (track_id, idx, place, time, name, sha256),
    motion (track_id, idx, mean, p95), palettes (track_id, idx, palette) and captions (track_id, idx, caption)."""
    per = ["track_id", "idx"]
    frames = stills.groupBy(*per).agg(F.array_sort(F.collect_list(F.struct("place", rounded("time", "seconds").alias("time_seconds"), F.concat(F.lit("frames/"), "name").alias("path"), "sha256"))).alias("_f"))
    held = partition.join(frames, per).join(motion.select(*per, F.struct("mean", "p95").alias("motion")), per).join(palettes.select(*per, "palette"), per)
    held = held.join(captions.select(*per, "caption"), per, "left") if captions is not None else held.withColumn("caption", F.lit(None).cast("struct<text:string,tags:array<string>>"))
    shot = F.struct(
        F.col("idx").cast("int").alias("index"),
        F.col("start").alias("start_seconds"),
        F.col("end").alias("end_seconds"),
        F.col("start_frame").cast("int").alias("start_frame"),
        F.col("end_frame").cast("int").alias("end_frame"),
        F.transform("_f", lambda f: F.struct(f["time_seconds"].alias("time_seconds"), f["path"].alias("path"), f["sha256"].alias("sha256"))).alias("representative_frames"),
        "palette",
        "motion",
        "caption",
    )
    tracks = held.groupBy("track_id").agg(F.array_sort(F.collect_list(shot)).alias("shots"))
    span = F.struct(F.try_element_at("shots", F.lit(1))["start_seconds"].alias("start_seconds"), F.try_element_at("shots", F.lit(-1))["end_seconds"].alias("end_seconds"))
    detector = F.struct(F.lit("content").alias("name"), F.lit(config.detector_threshold).alias("threshold"), F.lit(config.min_shot_seconds).alias("min_shot_seconds"))
    on = config.caption_backend != "null"
    backend = F.struct(F.lit(config.caption_backend).alias("name"), F.lit(config.caption_model if on else None).cast("string").alias("model"), F.lit(config.caption_prompt_version if on else None).cast("string").alias("prompt_version"))
    return _in_schema(tracks.withColumn("video_span", span).withColumn("detector", detector).withColumn("caption_backend", backend), "video")


def structure(sections: DataFrame, features: DataFrame, videos: DataFrame, *, window: float = 0.07) -> DataFrame:
    """Structure documents. Sections (track_id, label, start, end, confidence, evidence) come in; occurrence, beat and bar indices and the
    editing figures are worked out. The section's first beat is the nearest one to its start."""
    beats = features.select("track_id", F.col("beats.downbeat_offset").alias("_off"), F.col("beats.beats_per_bar").alias("_bpb"), F.posexplode("beats.times").alias("i", "t"))
    grid = features.select("track_id", F.col("beats.downbeat_offset").alias("_off"), F.col("beats.beats_per_bar").alias("_bpb"), F.size("beats.times").alias("_n"))
    cuts = videos.select("track_id", F.inline("shots")).where("index > 0").select("track_id", F.col("start_seconds").alias("t"))
    near = series.nearest(cuts, beats.select("track_id", "i", "t"), KEY)
    placed = series.nearest(series.occurrence(sections, KEY, "label", ["start"]), beats.select("track_id", "i", "t"), KEY, at="start").join(grid, KEY)
    ranked = placed.withColumn("section", F.row_number().over(Window.partitionBy("track_id").orderBy("start")) - 1)
    bar = F.greatest(F.lit(0), F.floor((F.col("nearest_index") - F.col("_off")) / F.col("_bpb")))
    shape = F.struct(F.col("start").alias("_o"), "label", F.col("occurrence").cast("int").alias("occurrence"), rounded("start", "seconds").alias("start_seconds"), rounded("end", "seconds").alias("end_seconds"), F.col("nearest_index").cast("int").alias("start_beat_index"), bar.cast("int").alias("start_bar_index"), rounded("confidence", "ratio").alias("confidence"), "evidence")
    counted = intervals.samples_in_spans(beats.select("track_id", "t"), ranked.select("track_id", "section", "start", "end"), KEY, "t", width=30.0).groupBy("track_id", "section").agg(F.count("*").alias("n_beats"))
    timed = ranked.select("track_id", "section", "start", "end").join(counted, ["track_id", "section"], "left").fillna(0, ["n_beats"])
    per = shots.cuts_per_section(near.select("track_id", "t", "offset"), timed, KEY, on_beat=window)
    per_section = per.groupBy("track_id").agg(F.array_sort(F.collect_list(F.struct(F.col("section").cast("int").alias("section_index"), "cuts_per_bar", F.col("on_beat_ratio").alias("on_beat_cut_ratio")))).alias("_per"))
    cut = F.struct(rounded("t", "seconds").alias("time_seconds"), F.col("nearest_index").cast("int").alias("nearest_beat_index"), rounded("offset", "seconds").alias("offset_seconds"))
    all_cuts = near.groupBy("track_id").agg(F.array_sort(F.collect_list(cut)).alias("_cuts"), F.avg((F.abs("offset") <= window).cast("double")).alias("_share"))
    told = ranked.groupBy("track_id").agg(F.array_sort(F.collect_list(shape)).alias("_s"))
    joined = grid.join(told, KEY, "left").join(per_section, KEY, "left").join(all_cuts, KEY, "left")
    bars = F.col("_n") / F.col("_bpb")
    editing = F.struct(
        F.lit(window).alias("on_beat_window_seconds"),
        rounded(F.coalesce(F.try_divide(F.coalesce(F.size("_cuts"), F.lit(0)).cast("double"), bars), F.lit(0.0)), "ratio").alias("cuts_per_bar_global"),
        rounded(F.coalesce("_share", F.lit(0.0)), "ratio").alias("on_beat_cut_ratio"),
        F.coalesce("_per", F.expr("cast(array() as array<struct<section_index:int,cuts_per_bar:double,on_beat_cut_ratio:double>>)")).alias("per_section"),
        F.coalesce("_cuts", F.expr("cast(array() as array<struct<time_seconds:double,nearest_beat_index:int,offset_seconds:double>>)")).alias("cuts"),
    )
    shown = F.transform("_s", lambda s: F.struct(*(s[c].alias(c) for c in ("label", "occurrence", "start_seconds", "end_seconds", "start_beat_index", "start_bar_index", "confidence", "evidence"))))
    return _in_schema(joined.withColumn("sections", shown).withColumn("editing", editing), "structure")


def detection_windows(features: DataFrame, seconds: float = 30.0) -> DataFrame:
    """(track_id, start, end): the earliest activity of 30 s in all, which language detection should hear."""
    regions = features.select("track_id", F.inline("vocal_activity.regions")).select("track_id", F.col("start_seconds").alias("start"), F.col("end_seconds").alias("end"))
    return intervals.budgeted_prefix(regions, KEY, seconds)


def clip_windows(features: DataFrame, config: Lyrics = Lyrics()) -> DataFrame:
    """(track_id, start, end): padded activity, which transcription should hear; none where clipping is off."""
    regions = features.select("track_id", F.inline("vocal_activity.regions")).select("track_id", F.col("start_seconds").alias("start"), F.col("end_seconds").alias("end"))
    return intervals.padded(regions if config.clip_to_vocal_activity else regions.where("false"), KEY, config.clip_padding_seconds)


def caption_calls(stills: DataFrame, cache: DataFrame, config: Video = Video()) -> DataFrame:
    """(track_id, idx, cache_key, model, frames) of shots whose caption isn't in ``cache`` (cache_key, caption): what a run would pay for.
    Stills carry width and height."""
    ordered = stills.groupBy("track_id", "idx").agg(F.array_sort(F.collect_list(F.struct("place", "sha256", "width", "height"))).alias("_f"))
    hashes = F.transform("_f", lambda f: f["sha256"])
    keyed = ordered.select("track_id", "idx", cache_key(hashes, F.lit(config.caption_prompt_version), F.lit(config.caption_model)).alias("cache_key"), F.lit(config.caption_model).alias("model"), F.transform("_f", lambda f: F.struct(f["width"].alias("width"), f["height"].alias("height"))).alias("frames"))
    return uncached(keyed, cache)

