"""Scalar functions over columns; all run inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SILENCE_DB = -80.0
PIXELS_PER_TOKEN = 750


def content_sha256(x: Column | str) -> Column:
    x = F.col(x) if isinstance(x, str) else x
    return F.sha2(x.cast("binary"), 256)


def track_id(content: Column | str) -> Column:
    """First 16 hex digits of the SHA-256 of the content."""
    return F.substring(content_sha256(content), 1, 16)


def decibels(rms: Column) -> Column:
    """20 log10 of an amplitude, at least SILENCE_DB."""
    return F.greatest(F.lit(SILENCE_DB), 20 * F.log10(F.greatest(rms, F.lit(1e-12))))


def silent(db: Column) -> Column:
    return db <= SILENCE_DB + 1e-9


def strength(value: Column, reference: Column) -> Column:
    """Clipped to 0..1 relative to a reference."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), value / reference))


def frame_seconds(i: Column, hop: int = 441, rate: int = 44100) -> Column:
    return i * F.lit(float(hop)) / F.lit(float(rate))


def quantised(x: Column) -> Column:
    """A sample in -1..1 as a 16-bit integer, clamped, ties to even."""
    return F.bround(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x)) * 32767, 0).cast("int")


def image_tokens(width: Column, height: Column) -> Column:
    return F.greatest(F.lit(1), F.bround(width * height / PIXELS_PER_TOKEN, 0).cast("long"))


def call_usd(input_tokens: Column, output_tokens: Column, input_price: Column, output_price: Column) -> Column:
    """Price in USD with prices per million tokens."""
    return (input_tokens * input_price + output_tokens * output_price) / 1_000_000


def cache_key(frame_hashes: Column, prompt_version: Column, model: Column) -> Column:
    """Key of a caption: hash of all frame hashes, prompt version and model, joined by dots."""
    return F.concat_ws(".", F.sha2(F.array_join(frame_hashes, "").cast("binary"), 256), prompt_version, model)


def rgb_hex(r: Column, g: Column, b: Column) -> Column:
    return F.format_string("#%02x%02x%02x", r.cast("int"), g.cast("int"), b.cast("int"))


def fraction(text: Column) -> Column:
    """'num/den' as a double; a bare number is itself; a zero denominator or no number is null."""
    parts = F.split(text, "/")
    numerator, denominator = F.try_element_at(parts, F.lit(1)).try_cast("double"), F.try_element_at(parts, F.lit(2)).try_cast("double")
    return F.when(F.size(parts) == 1, numerator).otherwise(F.try_divide(numerator, denominator))


def diagonal(width: Column, height: Column) -> Column:
    return F.hypot(width.cast("double"), height.cast("double"))


def bar_index(beat: Column, offset: Column, beats_per_bar: Column | int = 4) -> Column:
    """Bar that a beat falls in; beats before the first downbeat belong to bar 0."""
    return F.greatest(F.lit(0), F.floor((beat - offset) / beats_per_bar)).cast("long")


def shortened_error(text: Column, size: int = 500) -> Column:
    return F.substring(text, 1, size)


def combined_error(first: Column, retry: Column) -> Column:
    """Message of a failed attempt and of its retry: 200 and 250 characters at most."""
    return F.concat(F.lit("first: "), F.substring(first, 1, 200), F.lit("; retry: "), F.substring(retry, 1, 250))


def estimate_text(calls: Column, input_tokens: Column, output_tokens: Column, usd: Column) -> Column:
    return F.format_string("%d calls, about %d input and up to %d output tokens, $%.4f", calls, input_tokens, output_tokens, usd)
