"""Token counts of whole texts for a piece vocabulary with byte fallback, by the whole-token shortcut.

Offline, once per worker: every vocabulary string is encoded alone, and those that come out as one token form the shortcut
table; the vocabulary is searched for pieces that could reach over a cut (before a space that follows a non-space, and on
either side of a line feed), which proves that a text's count is the sum over the parts between cuts. All parts of a chunk are
looked up in that table at once; only the remaining distinct parts are merged, many in one call with line feeds between them,
and their counts are remembered by the worker, the ones used last longest.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks, memory
from .workspace import table

MODEL = "piece_bpe_32k.model"
#: Counts of about so many parts are remembered by a worker, in some 64 bytes each.
REMEMBERED = 1_000_000
#: Bytes of parts that are merged in one call.
CALL_BYTES = 32 << 10
SPACE = "▁"
#: One counter for each vocabulary file, for all tasks of a stage that a worker runs.
_COUNTERS: dict[str, Counter] = blocks.kept_for_a_stage()


class Counter:
    """Counts tokens of an Arrow array of texts exactly as the library does for each whole text."""

    def __init__(self, model: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=model)
        pieces = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size()) if not (self.library.is_control(i) or self.library.is_unknown(i) or self.library.is_byte(i))]
        #: No piece has a space after something else, or a line feed: merges never reach over a cut.
        self.cuts = not any(re.search(f"[^{SPACE}]{SPACE}|\n", p) for p in pieces) and self._tokens(["a", "\n"]) == [1, 1]
        own = [p.replace(SPACE, " ") for p in pieces]
        alone = [s for s, n in zip(own, self._tokens(own), strict=True) if n == 1] if self.cuts else []
        self.whole = [s.encode() for s in [*alone, "\n"]]
        short = [s for s in dict.fromkeys(self.whole) if len(s) <= memory.KEY_BYTES]
        sizes = np.fromiter(map(len, short), np.int64, len(short))
        keys = memory.keys_of(memory.eights(memory.padded(np.frombuffer(b"".join(short), np.uint8))), np.cumsum(sizes) - sizes, sizes)
        self.table = memory.Slots(memory.LANES, len(short))
        self.table.add(keys, memory.hashes(keys), np.ones(len(short), np.int64))
        self.long = {s for s in self.whole if len(s) > memory.KEY_BYTES}
        self.known = memory.Memory(REMEMBERED)
        self.feed = self.library.encode("\n")[-1]

    def _tokens(self, parts: list[str]) -> list[int]:
        """Tokens of each part as it stands inside a text: a line feed before it keeps the library's own leading space off."""
        return [len(ids) - 2 for ids in self.library.encode(["\n" + p for p in parts], num_threads=1)]

    def _merged(self, parts: list[bytes]) -> np.ndarray:
        """Tokens of parts without line feeds, in few calls: a merge never reaches over the line feeds between them."""
        out, at = [], 0
        ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))
        while at < len(parts):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CALL_BYTES, "right")))
            ids = np.array(self.library.encode("\n" + b"\n".join(parts[at:to]).decode() + "\n", num_threads=1), np.int32)
            out.append(np.diff(np.flatnonzero(ids == self.feed)) - 1)
            at = to
        return np.concatenate(out) if out else np.zeros(0, np.int64)

    def _counts(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Tokens of each part."""
        out = np.zeros(len(starts), np.int64)
        data = memory.padded(data)
        held = memoryview(data)
        short = np.flatnonzero(sizes <= memory.KEY_BYTES)
        keys = memory.keys_of(memory.eights(data), starts[short], sizes[short])
        found = self.table.find(keys, memory.hashes(keys))
        rest = np.flatnonzero(found < 0)
        found[rest] = self.known.find(keys[:, rest])
        rest = rest[found[rest] < 0]
        if len(rest):
            keys = keys[:, rest]
            one, which = memory.distinct(keys)
            at = short[rest[one]]
            merged = self._merged([held[a:b].tobytes() for a, b in zip(starts[at].tolist(), (starts[at] + sizes[at]).tolist(), strict=True)])
            found[rest] = merged[which]
            self.known.put(keys[:, one], merged)
        out[short] = found
        if len(long := np.flatnonzero(sizes > memory.KEY_BYTES)):
            parts = [held[a:b].tobytes() for a, b in zip(starts[long].tolist(), (starts[long] + sizes[long]).tolist(), strict=True)]
            new = [p for p in dict.fromkeys(parts) if p not in self.long]
            known = dict(zip(new, self._merged(new).tolist(), strict=True))
            out[long] = [known.get(p, 1) for p in parts]
        return out

    def count(self, texts: pa.Array) -> np.ndarray:
        texts = texts.fill_null("")
        if not self.cuts:
            return np.array([len(x) for x in self.library.encode(texts.to_pylist(), num_threads=1)], np.int64)
        # The library puts one space before each text.
        data, at = blocks._parts(pc.binary_join_element_wise("", texts, " "))
        n = len(data)
        space, feed = data == 0x20, data == 0x0A
        cut = feed.copy()
        opens = space[1:] & ~space[:-1]
        if n >= 4:  # a literal space symbol before a space
            opens[2:] &= ~((data[:-3] == 0xE2) & (data[1:-2] == 0x96) & (data[2:-1] == 0x81))
        cut[1:] |= feed[:-1] | opens
        cut[at[:-1]] = True
        starts = np.flatnonzero(cut)
        counts = self._counts(data, starts, np.diff(np.append(starts, n)))
        sums = np.concatenate([[0], np.cumsum(counts)])
        out = np.diff(sums[np.searchsorted(starts, at)])
        return np.where(np.diff(at) > 1, out, 0)


def counter_of(model: str | None) -> Counter:
    if model is None:
        import public_tokenizers

        model = public_tokenizers.path(MODEL)
    if model not in _COUNTERS:
        _COUNTERS[model] = Counter(model)
    return _COUNTERS[model]


def _counted(model: str | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks.chunks(batches, "text", 2 << 20):
            n_tokens = counter_of(model).count(part.column(1))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(blocks.lengths(part.column(1))), pa.array(n_tokens)], names=["doc_id", "n_bytes", "n_tokens"])

    return run


def token_counts(docs: DataFrame, *, limit: int = 4096, model: str | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for each row of ``docs`` (doc_id, text; more columns are ignored).

    Counts are the library's for the whole text without begin, end or special tokens. A null text counts as empty: 0 bytes, 0
    tokens. Repeated rows give repeated rows; a null doc_id is carried; an empty table gives no rows. A very long text is counted
    whole, in memory of some tens of times its bytes. One pass, no shuffle; ``model`` is a path that every executor can open, by
    default the installed vocabulary file.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return blocks.map_arrow(texts, _counted(model), "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
