"""Whole texts as numpy arrays: words, word hashes and word windows of an Arrow column, without a loop over words.

Texts go through in chunks of bounded bytes, so memory depends on the chunk (or on the longest single text), never on the
number of rows. A word's hash takes its bytes eight at a time and mixes after each step, so it isn't linear in the letters;
words of more than LONG_WORD bytes are hashed by a cryptographic digest. Hashes have 64 bits: callers whose results hang on
the identity of words compare two independent hashes or the words themselves.
"""

from __future__ import annotations

import ctypes
import functools
import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

CHUNK_BYTES = 1 << 20

#: Longer words are hashed one by one.
LONG_WORD = 256


def WHITESPACE(low: np.ndarray) -> np.ndarray:  # noqa: N802
    """``[^\x20\x09-\x0D]+``: everything but white space is part of a word. Bytes that separate words."""
    return (low == 0x20) | ((low - np.uint8(9)) < 5)


def NOT_ALNUM(low: np.ndarray) -> np.ndarray:  # noqa: N802
    """``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing: digits, a-z and everything beyond ASCII make words."""
    return ~(((low - np.uint8(0x30)) < 10) | ((low - np.uint8(0x61)) < 26) | (low >= 0x80))


_MASKS = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)
_FOLD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xA0761D6478BD642F))
_LENGTH = (np.uint64(0xE7037ED1A0B428DB), np.uint64(0x8EBC6AF09C88C6E3))
_STEP = np.uint64(0xD6E8FEB86659FD93)


def chunks(batches: Iterable[pa.RecordBatch], column: str, max_bytes: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in slices whose texts hold about max_bytes at most, or one longer text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(lengths(batch.column(batch.schema.get_field_index(column))))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + max_bytes, "right")))
            yield batch.slice(at, to - at)
            at = to


def _parts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts one after another, and the offset of each text in them (with the end)."""
    if texts.null_count:
        texts = texts.fill_null(b"" if pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type) else "")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and len(at) else np.zeros(0, np.uint8)
    return data, at - at[0]


def lengths(texts: pa.Array) -> np.ndarray:
    return np.diff(_parts(texts)[1]) if len(texts) else np.zeros(0, np.int64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose bits all depend on each other."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def lowered(data: np.ndarray) -> np.ndarray:
    """The bytes with A-Z in lower case, and eight zeros behind them."""
    out = np.zeros(len(data) + 8, np.uint8)
    np.add(data, ((data - np.uint8(65)) < 26).view(np.uint8) << np.uint8(5), out=out[: len(data)])
    return out


def give_back() -> None:
    """Hand freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library: it has no such call
        pass


_KEPT: list[dict] = []
_stage: list[int | None] = [None]


def kept_for_a_stage() -> dict:
    """A dictionary of a worker that outlives its tasks but not the stage: a later stage's needs don't come on top of it."""
    _KEPT.append({})
    return _KEPT[-1]


def _forget_other_stages() -> None:
    context = TaskContext.get()
    now = context.stageId() if context else None
    if now != _stage[0]:
        for held in _KEPT:
            held.clear()
        _stage[0] = now


def returning_memory(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow whose worker gives freed memory back to the system, now and then and when a task ends; Spark
    keeps workers for later stages, whose own needs would come on top."""

    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _forget_other_stages()
        try:
            for n, out in enumerate(run(batches)):
                yield out
                if n % 8 == 7:
                    give_back()
        finally:
            give_back()

    return wrapped


#: Arrow batches that Spark hands to a worker hold about so many bytes, unless the session says otherwise.
BATCH_SETTING, BATCH_DEFAULT, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", 4 << 20


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow in small batches, so that the memory of executors and workers doesn't follow 10,000 long rows. The session's
    setting is lowered where it is the default; a value that someone has chosen stays."""
    settings = df.sparkSession.conf
    if settings.get(BATCH_SETTING, BATCH_DEFAULT) == BATCH_DEFAULT:
        settings.set(BATCH_SETTING, str(BATCH_BYTES))
    return df.mapInArrow(returning_memory(run), schema)


class Words:
    """Words of several texts. ``starts``/``ends`` are byte positions, ``first[d]`` is the index of text d's first word."""

    def __init__(self, texts: pa.Array, separators: Callable[[np.ndarray], np.ndarray], hashes: bool = True):
        self.data, self.offsets = _parts(texts)
        self._low = lowered(self.data)
        self.low = self._low[: len(self.data)]
        inside = ~separators(self.low)
        edges = self.offsets[:-1][np.diff(self.offsets) > 0]
        starts, ends = inside.copy(), inside.copy()
        starts[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        starts[edges] = inside[edges]
        last = self.offsets[1:][np.diff(self.offsets) > 0] - 1
        ends[last] = inside[last]
        self.starts = np.flatnonzero(starts)
        self.ends = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.starts, self.offsets)
        self.counts = np.diff(self.first)
        self.text_of = np.repeat(np.arange(len(self.counts)), self.counts)
        self.hashes = self.hash_of(self.starts, self.ends) if hashes else None

    def heads(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The first eight lower-cased bytes of each range as an integer; a shorter range is filled up with zeros."""
        return np.ndarray((len(self._low) - 7,), "<u8", self._low, 0, (1,))[starts] & _MASKS[np.minimum(ends - starts, 8)]

    def hash_of(self, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
        """Hash of the lower-cased bytes of each range, wherever it stands; ``which`` chooses one of two independent hashes."""
        if not len(starts):
            return np.zeros(0, np.uint64)
        sizes = ends - starts
        out = mix((self.heads(starts, ends) + _LENGTH[which] * sizes.astype(np.uint64)) * _FOLD[which])
        some = np.flatnonzero((sizes > 8) & (sizes <= LONG_WORD))
        at = 8
        while len(some):
            out[some] = mix((out[some] ^ self.heads(starts[some] + at, ends[some])) * _FOLD[which] + _LENGTH[which])
            at += 8
            some = some[sizes[some] > at]
        for k in np.flatnonzero(sizes > LONG_WORD).tolist():
            digest = hashlib.blake2b(self.low[starts[k] : ends[k]].tobytes(), digest_size=16).digest()
            out[k] = int.from_bytes(digest[8 * which : 8 * which + 8], "little")
        return out

    def digests(self) -> list[bytes]:
        """A 128-bit cryptographic digest of each text's words, one space between them."""
        step = np.minimum(self.ends + 1, self.offsets[1:][self.text_of])  # behind the separator after each word
        mark = np.zeros(len(self.data) + 1, np.int8)
        mark[self.starts] += 1
        mark[step] -= 1
        kept = np.cumsum(mark[:-1], dtype=np.int8) > 0
        plain = self.low.copy()
        between = self.ends[self.ends < self.offsets[1:][self.text_of]] if len(self.ends) else self.ends
        plain[between] = 0x20
        plain = plain[kept]
        upto = np.concatenate([[0], np.cumsum(np.bincount(self.text_of, step - self.starts, len(self.counts)).astype(np.int64))])
        held = memoryview(plain)
        return [hashlib.blake2b(held[a:b].tobytes().rstrip(b" "), digest_size=16).digest() for a, b in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True)]

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the k words from each word on, and whether they all lie in that word's text."""
        return windows(self.hashes, self.first, self.text_of, k)


def windows(hashes: np.ndarray, first: np.ndarray, text_of: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    n = len(hashes)
    out = np.zeros(n, np.uint64)
    if n >= k:
        body = hashes[: n - k + 1].copy()
        for i in range(1, k):
            body = body * _STEP + hashes[i : n - k + 1 + i]
        out[: n - k + 1] = mix(body)
    return out, np.arange(n) + k <= first[1:][text_of] if n else np.zeros(0, bool)


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word windows of each text as (hashes sorted within a text, offsets by text). A text of fewer words, but not
    none, has its whole sequence as one."""
    hashes, whole = words.windows(k)
    short = np.flatnonzero((words.counts > 0) & (words.counts < k))
    extra = np.zeros(len(short), np.uint64)
    for length in range(1, k):
        of = short[words.counts[short] == length]
        if len(of):
            extra[words.counts[short] == length] = words.windows(length)[0][words.first[of]] ^ np.uint64(length)
    values = np.concatenate([hashes[whole], extra])
    owner = np.concatenate([words.text_of[whole], short])
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    fresh = np.ones(len(values), bool)
    fresh[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    values, owner = values[fresh], owner[fresh]
    return values, np.searchsorted(owner, np.arange(len(words.counts) + 1))
