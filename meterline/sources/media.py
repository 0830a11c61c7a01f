"""Media and lyric files as tables. Decoding is done outside; probe output, PCM and frames come in as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rounding import rounded
from ..functions.scalars import content_sha256, fraction
from ..functions.text import has_stamp

STREAM = "struct<index:int,codec_type:string,codec_name:string,sample_rate:string,channels:int,bit_rate:string,width:int,height:int,r_frame_rate:string,avg_frame_rate:string,nb_frames:string,disposition:struct<attached_pic:int>>"
PROBE = f"format struct<format_name:string,duration:string,tags:map<string,string>>, streams array<{STREAM}>"


def files(spark: SparkSession, path: str) -> DataFrame:
    """(path, filename, size_bytes, sha256, track_id) of the files under ``path``; identity is their content."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    digest = content_sha256("content")
    return found.select("path", F.element_at(F.split("path", "/"), -1).alias("filename"), F.col("length").alias("size_bytes"), digest.alias("sha256"), F.substring(digest, 1, 16).alias("track_id"))


def first_stream(streams: Column, kind: str) -> Column:
    """The first stream of a kind that isn't an attached picture; null without one."""
    real = F.filter(streams, lambda s: (s["codec_type"] == kind) & (F.coalesce(s["disposition"]["attached_pic"], F.lit(0)) == 0))
    return F.try_element_at(real, F.lit(1))


def frame_count(stream: Column, duration: Column, fps: Column) -> Column:
    """The stream's own count, else duration times rate, else 0."""
    return F.coalesce(stream["nb_frames"].try_cast("int"), F.bround(duration * fps, 0).cast("int"), F.lit(0))


def probed(probes: DataFrame, key: str = "track_id", text: str = "probe") -> DataFrame:
    """(key, media) in document form from probe output as JSON text; parts that aren't there are null. Tags are kept only where a
    title or an artist isn't empty. A track without an audio stream has no audio part."""
    p = probes.select(key, F.from_json(text, PROBE).alias("p")).select(key, "p.*")
    audio, video = first_stream(F.col("streams"), "audio"), first_stream(F.col("streams"), "video")
    held = p.withColumn("_a", audio).withColumn("_v", video).withColumn("_d", F.col("format.duration").try_cast("double"))
    fps = F.coalesce(fraction(F.col("_v.avg_frame_rate")), fraction(F.col("_v.r_frame_rate")))
    title, artist = F.nullif(F.try_element_at("format.tags", F.lit("title")), F.lit("")), F.nullif(F.try_element_at("format.tags", F.lit("artist")), F.lit(""))
    tags = F.when(title.isNotNull() | artist.isNotNull(), F.struct(title.alias("title"), artist.alias("artist")))
    media = F.struct(
        F.col("format.format_name").alias("container"),
        rounded("_d", "seconds").alias("duration_seconds"),
        tags.alias("tags"),
        F.when(F.col("_a").isNotNull(), F.struct(F.col("_a.codec_name").alias("codec"), F.col("_a.sample_rate").try_cast("int").alias("sample_rate"), F.col("_a.channels").alias("channels"), F.col("_a.bit_rate").try_cast("int").alias("bit_rate"))).alias("audio"),
        F.when(F.col("_v").isNotNull(), F.struct(F.col("_v.codec_name").alias("codec"), F.col("_v.width").alias("width"), F.col("_v.height").alias("height"), rounded(fps, "seconds").alias("fps"), frame_count(F.col("_v"), F.col("_d"), fps).alias("frame_count"))).alias("video"),
    )
    return held.select(key, media.alias("media"))


def title(given: Column, tag: Column, filename: Column) -> Column:
    """The title given, else the tag's, else the file name without its ending."""
    return F.coalesce(F.nullif(given, F.lit("")), F.nullif(tag, F.lit("")), F.regexp_replace(filename, r"(?<=.)\.[^.]*$", ""))


def pcm(decoded: DataFrame, key: str = "track_id", content: str = "pcm", rate: int = 44100, channels: int = 2) -> DataFrame:
    """(key, audio_stream_sha256, duration_seconds) of decoded 16-bit PCM; the duration is exact from the byte count."""
    return decoded.select(key, F.sha2(F.col(content), 256).alias("audio_stream_sha256"), rounded(F.octet_length(content) / float(rate * channels * 2), "seconds").alias("duration_seconds"))


def lyric_texts(texts: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """(path, format, sha256, line_count, has_timestamps) of .lrc and .txt files; blank lines don't count."""
    lines = F.filter(F.split(F.col(text), r"\r\n|\r|\n"), lambda line: F.regexp_replace(line, r"\s+", "") != "")
    kept = texts.where(F.lower(F.col(path)).rlike(r"\.(lrc|txt)$"))
    return kept.select(path, F.lower(F.element_at(F.split(path, r"\."), -1)).alias("format"), content_sha256(text).alias("sha256"), F.size(lines).alias("line_count"), has_stamp(F.col(text)).alias("has_timestamps"))


def read_lyrics(spark: SparkSession, path: str) -> DataFrame:
    found = spark.read.text(path, wholetext=True)
    return lyric_texts(found.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")))


def motion_size(width: Column, height: Column, target: int = 320) -> tuple[Column, Column]:
    """Size of the frames that the motion scan asks of a decoder: ``target`` wide, the height in proportion and even."""
    return F.lit(target), (F.bround(height * target / width / 2, 0) * 2).cast("int")


def still_size(width: Column, height: Column, most: int = 1280) -> tuple[Column, Column]:
    """Size of stored stills: never wider than ``most``, never enlarged."""
    return F.least(width, F.lit(most)), F.when(width > most, F.greatest(F.lit(1), F.bround(height * most / width, 0).cast("int"))).otherwise(height)


def at_rate(decoded: DataFrame, rate: int = 44100, column: str = "sample_rate") -> DataFrame:
    """``decoded`` as it is; the job fails at the first row of another sample rate, since frames are counted in samples of this one."""
    fault = F.raise_error(F.concat(F.lit("sample rate "), F.coalesce(F.col(column).cast("string"), F.lit("unknown")), F.lit(f", wanted {rate}"))).cast("int")
    return decoded.withColumn(column, F.when(F.col(column) == rate, F.col(column)).otherwise(fault))


def frames_at(frames: DataFrame, plan: DataFrame, keys: list[str], frame: str = "frame") -> DataFrame:
    """The rows of ``frames`` (keys..., frame, ...) that ``plan`` (keys..., frame) asks for; the job fails where a track is too short to
    have one of them."""
    held = plan.select(*keys, frame).distinct().join(frames.withColumn("_there", F.lit(True)), [*keys, frame], "left")
    fault = F.raise_error(F.concat(F.lit("too short: no frame "), F.col(frame).cast("string"))).cast("boolean")
    return held.where(F.when(F.col("_there"), F.lit(True)).otherwise(fault)).drop("_there")


def video_copy(path: Column, copy: bool, media: Column, at: str = "media") -> Column:
    """Where the first video of a track is kept: its own path, or, with copies asked for, a path by content; null without video."""
    kept = F.concat(F.lit(f"{at}/"), F.sha2(path.cast("binary"), 256), F.lit("."), F.lower(F.element_at(F.split(path, r"\."), -1))) if copy else path
    return F.when(media["video"].isNotNull(), kept)
