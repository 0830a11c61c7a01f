"""Numeric kernels over one track's audio: frame energy, spectral centroid, onsets, beats, loudness.

A track is a few minutes, so each kernel is one grouped numpy function per track, and tracks run in parallel. Values follow the
published definitions; they aren't those of any one audio library bit for bit.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .series import many_tasks

RATE, HOP, FRAME, FLOOR_DB = 44100, 441, 2048, -80.0


def _half_up(x: np.ndarray | float, places: int) -> np.ndarray:
    return np.floor(np.asarray(x, float) * 10**places + 0.5) / 10**places


def frames(y: np.ndarray, reflect: bool = False) -> np.ndarray:
    """Centred frames, one per hop; beyond the ends the signal is zero or mirrored."""
    pad = FRAME // 2
    mode = "reflect" if reflect and len(y) > pad else "constant"
    wide = np.pad(y.astype(np.float32), pad, mode=mode)
    return np.lib.stride_tricks.sliding_window_view(wide, FRAME)[::HOP]


def rms_db(y: np.ndarray) -> np.ndarray:
    if not len(y):
        return np.zeros(0)
    rms = np.sqrt(np.mean(np.square(frames(y), dtype=np.float64), axis=1))
    return np.maximum(20 * np.log10(np.maximum(rms, 1e-12)), FLOOR_DB)


def spectra(y: np.ndarray, block: int = 512) -> Iterator[np.ndarray]:
    """Magnitude spectra in blocks of frames, so memory doesn't grow with the track."""
    window = np.hanning(FRAME + 1)[:-1].astype(np.float32)
    framed = frames(y)
    for at in range(0, len(framed), block):
        yield np.abs(np.fft.rfft(framed[at : at + block] * window, axis=1))


def hold_last(values: np.ndarray, silent: np.ndarray) -> np.ndarray:
    """Values over silent frames are the last ones before, at the head the first; zero if all is silent."""
    return pd.Series(values, dtype=float).mask(silent).ffill().bfill().fillna(0.0).to_numpy()


def spectral(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(centroids, power in mel bands) of the frames, from one pass over their spectra."""
    hz, bank = np.fft.rfftfreq(FRAME, 1 / RATE), _mel_bank()
    if not len(y):
        return np.zeros(0), np.zeros((0, len(bank)))
    both = [((s @ hz) / np.maximum(s.sum(axis=1), 1e-12), (s * s) @ bank.T) for s in spectra(y)]
    return np.concatenate([c for c, _ in both]), np.concatenate([p for _, p in both])


def centroid_hz(raw: np.ndarray, db: np.ndarray) -> np.ndarray:
    """Centroids of frames as ``spectral`` gives them, held over silence."""
    return hold_last(raw, db <= FLOOR_DB + 1e-9)


@lru_cache(maxsize=1)
def _mel_bank(bands: int = 128) -> np.ndarray:
    to_mel, to_hz = (lambda f: 2595 * np.log10(1 + f / 700)), (lambda m: 700 * (10 ** (m / 2595) - 1))
    edges = to_hz(np.linspace(to_mel(0.0), to_mel(RATE / 2), bands + 2))
    hz = np.fft.rfftfreq(FRAME, 1 / RATE)
    up = (hz[None] - edges[:-2, None]) / np.diff(edges)[:-1, None]
    down = (edges[2:, None] - hz[None]) / np.diff(edges)[1:, None]
    return np.maximum(0, np.minimum(up, down)) * (2 / (edges[2:] - edges[:-2]))[:, None]


def onset_envelope(power: np.ndarray) -> np.ndarray:
    """Mean positive change of the log mel spectrum from frame to frame, from the power that ``spectral`` gives."""
    if not len(power):
        return np.zeros(0)
    db = 10 * np.log10(np.maximum(power, 1e-10))
    db = np.maximum(db, db.max() - 80)
    return np.concatenate([[0.0], np.maximum(0, np.diff(db, axis=0)).mean(axis=1)])


def pick_peaks(env: np.ndarray) -> np.ndarray:
    """Frames that are the largest within 30 ms before and after, exceed the mean of 100 ms around by 0.07 of the range, and lie 30 ms
    from the peak before."""
    if not len(env) or env.max() <= 0:
        return np.zeros(0, int)
    e = (env - env.min()) / max(env.max() - env.min(), 1e-12)
    wide = np.pad(e, 3, mode="edge")
    top = np.lib.stride_tricks.sliding_window_view(wide, 7).max(axis=1)
    mean = np.convolve(np.pad(e, 10, mode="edge"), np.ones(21) / 21, mode="valid")
    found, last = [], -4
    for i in np.flatnonzero((e >= top) & (e >= mean + 0.07)):
        if i - last > 3:
            found.append(i)
            last = i
    return np.array(found, int)


def onsets(env: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(times, strengths, reference)."""
    at = pick_peaks(env)
    if not len(at):
        return np.zeros(0), np.zeros(0), 1.0
    reference = max(float(_half_up(np.percentile(env, 98), 3)), 0.001)
    return _half_up(at * HOP / RATE, 3), _half_up(np.clip(env[at] / reference, 0, 1), 3), reference


def tempo(env: np.ndarray, start_bpm: float = 120.0) -> float:
    """Beats per minute from the envelope's autocorrelation, weighted by distance (in octaves) from a usual tempo; 0 without onsets."""
    x = env - env.mean() if len(env) else env
    if len(x) < 8 or not np.any(x):
        return 0.0
    size = 1 << (2 * len(x) - 1).bit_length()
    ac = np.fft.irfft(np.abs(np.fft.rfft(x, size)) ** 2)[: len(x)]
    lags = np.arange(1, len(ac))
    bpm = 60 * RATE / HOP / lags
    score = ac[1:] * np.exp(-0.5 * np.log2(bpm / start_bpm) ** 2)
    score = np.where((bpm >= 30) & (bpm <= 300), score, -np.inf)
    k = int(np.argmax(score))
    if not np.isfinite(score[k]) or score[k] <= 0:
        return 0.0
    lag = float(lags[k])
    if 0 < k < len(lags) - 1:  # a parabola through the three values around the peak
        a, b, c = ac[k], ac[k + 1], ac[k + 2]
        if (d := a - 2 * b + c) < 0:
            lag += 0.5 * (a - c) / d
    return 60 * RATE / HOP / lag


def beat_frames(env: np.ndarray, bpm: float, tightness: float = 100.0) -> np.ndarray:
    """Beats by dynamic programming: onset strength, less a penalty for gaps that differ from the tempo's."""
    if bpm <= 0 or not len(env):
        return np.zeros(0, int)
    period = 60 * RATE / HOP / bpm
    local = env / max(env.std(), 1e-12)
    width = int(round(period))
    kernel = np.exp(-0.5 * (np.arange(-width, width + 1) * 32.0 / period) ** 2)
    local = np.convolve(local, kernel, mode="same") if len(local) >= len(kernel) else local
    back = np.arange(-2 * width, -(width // 2) + 1)
    cost = -tightness * np.log(-back / period) ** 2
    came = np.full(len(local), -1)
    padded = np.zeros(2 * width + len(local))  # nothing stands before the first frame
    for i in range(len(local)):
        score = cost + padded[i : i + len(back)]
        k = int(score.argmax())
        padded[2 * width + i] = local[i] + score[k]
        came[i] = max(i + int(back[k]), -1)
    total = padded[2 * width :]
    at = int(np.argmax(np.where(np.arange(len(total)) >= len(total) - max(1, int(period)), total, -np.inf)))
    out = []
    while at >= 0:
        out.append(at)
        at = came[at]
    return np.array(out[::-1], int)


def downbeat_offset(env: np.ndarray, beats: np.ndarray, window: float = 0.03, beats_per_bar: int = 4) -> int:
    """The phase of the bar whose beats have the strongest onsets nearby; the lowest of equal ones, 0 without a full bar."""
    if len(beats) < beats_per_bar:
        return 0
    reach = max(1, int(round(window * RATE / HOP)))
    nearby = np.lib.stride_tricks.sliding_window_view(np.pad(env, reach, constant_values=-np.inf), 2 * reach + 1).max(axis=1)
    phase = np.arange(len(beats)) % beats_per_bar
    return int(np.argmax(np.bincount(phase, nearby[beats]) / np.bincount(phase)))


def tempo_confidence(times: np.ndarray) -> float:
    if len(times) < 3:
        return 0.0
    gaps = np.diff(times)
    return float(np.clip(1 - 4 * gaps.std() / max(gaps.mean(), 1e-9), 0, 1))


# K-weighting filters of the loudness standard for 48 kHz, given as shelf and high-pass parameters.
_SHELF = (1681.974450955533, 3.999843853973347, 0.7071752369554196)
_PASS = (38.13547087602444, 0.5003270373238773)


def _weighting(rate: int) -> np.ndarray:
    """Power response of the K-weighting at the bins of a transform, as a function of frequency."""
    f0, gain, q = _SHELF
    k, vh = np.tan(np.pi * f0 / rate), 10 ** (gain / 20)
    vb = vh**0.4996667741545416
    a0 = 1 + k / q + k * k
    shelf = np.array([(vh + vb * k / q + k * k) / a0, 2 * (k * k - vh) / a0, (vh - vb * k / q + k * k) / a0]), np.array([1, 2 * (k * k - 1) / a0, (1 - k / q + k * k) / a0])
    f0, q = _PASS
    k = np.tan(np.pi * f0 / rate)
    a0 = 1 + k / q + k * k
    high = np.array([1.0, -2.0, 1.0]), np.array([1, 2 * (k * k - 1) / a0, (1 - k / q + k * k) / a0])
    return shelf, high


def _transform_size(n: int) -> int:
    """A size of at least n, and few of them, that a transform takes fast: a product of 2, 3 and 5."""
    k = max(0, n.bit_length() - 5)
    return next(m << k for m in (16, 18, 20, 24, 25, 27, 30, 32) if m << k >= n)


def _response(size: int, rate: int) -> np.ndarray:
    z = np.exp(-2j * np.pi * np.arange(size // 2 + 1) / size)
    response = np.ones(len(z), complex)
    for b, a in _weighting(rate):
        response *= (b[0] + b[1] * z + b[2] * z * z) / (a[0] + a[1] * z + a[2] * z * z)
    return response


#: Of short tracks, which are many of about one length; of long ones it would take more memory than time.
_short_response = lru_cache(maxsize=8)(_response)


def _filtered(y: np.ndarray, rate: int) -> np.ndarray:
    """The K-weighted signal, by one transform with zeros behind the end for the filters' tails."""
    size = _transform_size(len(y) + rate // 2)
    response = (_short_response if size <= 1 << 18 else _response)(size, rate)
    return np.fft.irfft(np.fft.rfft(y, size) * response, size)[: len(y)]


def integrated_lufs(channels: np.ndarray, rate: int = RATE) -> float:
    """Gated loudness of (samples, channels): 400 ms blocks, a quarter apart, over -70 and within 10 of their mean; -70 for silence."""
    size, step = int(0.4 * rate), int(0.1 * rate)
    if len(channels) < size:
        return -70.0
    power = np.zeros(0)
    for c in range(channels.shape[1]):
        y = _filtered(channels[:, c].astype(float), rate)
        sums = np.concatenate([[0], np.cumsum(y * y)])
        starts = np.arange(0, len(y) - size + 1, step)
        block = (sums[starts + size] - sums[starts]) / size
        power = block if not len(power) else power + block
    loud = -0.691 + 10 * np.log10(np.maximum(power, 1e-20))
    held = power[loud > -70]
    if not len(held):
        return -70.0
    held = power[(loud > -70) & (loud > -0.691 + 10 * np.log10(held.mean()) - 10)]
    return float(_half_up(max(-70.0, -0.691 + 10 * np.log10(held.mean())), 2)) if len(held) else -70.0


def track_features(y: np.ndarray) -> dict:
    db = rms_db(y)
    centroids, power = spectral(y)
    env = onset_envelope(power)
    times, strengths, reference = onsets(env)
    bpm = tempo(env)
    beats = beat_frames(env, bpm)
    beat_times = beats * HOP / RATE
    return {
        "rms_db": _half_up(db, 2).tolist(),
        "centroid_hz": _half_up(centroid_hz(centroids, db), 1).tolist(),
        "onset_times": times.tolist(),
        "onset_strengths": strengths.tolist(),
        "strength_reference": reference,
        "bpm_global": float(_half_up(bpm, 1)),
        "confidence": float(_half_up(tempo_confidence(beat_times), 3)),
        "beats": _half_up(beat_times, 3).tolist(),
        "downbeat_offset": downbeat_offset(env, beats),
        "integrated_lufs": integrated_lufs(y[:, None]),
    }


FEATURES = "rms_db array<double>, centroid_hz array<double>, onset_times array<double>, onset_strengths array<double>, strength_reference double, bpm_global double, confidence double, beats array<double>, downbeat_offset int, integrated_lufs double"


def features_of_samples(samples: DataFrame, key: str = "track_id") -> DataFrame:
    """Features per track of samples (key, i, v); places without a sample are 0, of several the sum counts. Tracks are dealt out by
    number: their samples are few bytes for the time they take, so that tasks joined by bytes leave cores idle."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        y = np.zeros(int(part["i"].max()) + 1, np.float32)
        np.add.at(y, part["i"].to_numpy(), part["v"].to_numpy().astype(np.float32))
        return pd.DataFrame([{key: part[key].iloc[0], **track_features(y)}])

    kind = dict(samples.dtypes)[key]
    return samples.repartition(many_tasks(samples.sparkSession), key).groupBy(key).applyInPandas(run, f"{key} {kind}, {FEATURES}")


def features_of_pcm(tracks: DataFrame, key: str = "track_id", content: str = "pcm", channels: int = 2) -> DataFrame:
    """Features per row of 16-bit little-endian PCM at RATE, mixed down to one channel; loudness uses all channels."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for name, data in zip(part[key], part[content], strict=True):
                x = np.frombuffer(data, "<i2").reshape(-1, channels) / 32768.0
                yield pd.DataFrame([{key: name, **track_features(x.mean(axis=1).astype(np.float32)), "integrated_lufs": integrated_lufs(x)}])

    return tracks.select(key, content).mapInPandas(run, f"{key} {dict(tracks.dtypes)[key]}, {FEATURES}")
