"""BPE encoding and decoding by speculation and verification, for a word vocabulary with word ends.

Greedy longest match (one automaton over all vocabulary strings) proposes the tokens of all new words at once. A sequence of
tokens is the merge result exactly when every two neighbours are the merge result of their own concatenation. That is decided
for all pairs at once from the vocabulary's merge trees: along the right edge of the left token and the left edge of the right
one, no merge over the seam may come before the merges that make up the tokens. Only words with an incompatible pair, or with
an end that no token matches, undergo exact merging. Words and their ids are remembered by the worker.
"""

from __future__ import annotations

import functools
import itertools
import json
import os
import unicodedata
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks, memory
from .workspace import table

MODEL = "word_bpe_49k.json"
#: About so many words and pairs are remembered by a worker, and so many ids of words, in some 64 and 4 bytes each.
REMEMBERED, PAIRS, HELD_IDS = 250_000, 120_000, 2_000_000
_NEVER = np.iinfo(np.int64).max
_BEYOND = regex.compile("[\u0530-\U0010ffff]")
#: One codec for each vocabulary file, for all tasks of a stage that a worker runs.
_CODECS: dict[str, Codec] = blocks.kept_for_a_stage()


def _byte_letters() -> list[str]:
    """The printable letter of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, spare = [""] * 256, iter(range(256, 512))
    for b in range(256):
        letters[b] = chr(b) if b in plain else chr(next(spare))
    return letters


_SPACE, _LETTER, _NUMBER, _OTHER = range(4)


@functools.cache
def _kinds() -> np.ndarray:
    """Kind of every code point."""
    out = np.full(0x110000, _OTHER, np.uint8)
    low, high = "".join(map(chr, range(0xD800))), "".join(map(chr, range(0xE000, 0x110000)))
    for kind, pattern in ((_SPACE, r"\s+"), (_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+")):
        for base, text in ((0, low), (0xE000, high)):
            for found in regex.finditer(pattern, text):
                out[base + found.start() : base + found.end()] = kind
    return out


def _gather(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The ranges of ``flat`` one after another."""
    ends = np.cumsum(sizes)
    return flat[np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]


class Codec:
    def __init__(self, model: str):
        from tokenizers import Tokenizer, models

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.path = model
        with open(model, encoding="utf-8") as f:
            told = json.load(f)
        bpe = told["model"]
        self.end = bpe["end_of_word_suffix"]
        self.vocabulary: dict[str, int] = bpe["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in bpe["merges"]]
        self.special = {t["content"]: t["id"] for t in told["added_tokens"]}
        self.names = pa.array(self._names(), pa.string())
        self.words_of = regex.compile(told["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.special_of = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        letters = _byte_letters()
        #: Code points of the letters of bytes.
        self.letters = np.array([ord(c) for c in letters], np.uint32)
        self.byte_of = {c: b for b, c in enumerate(letters)}
        self.automaton = ahocorasick.Automaton()
        for text, i in self.vocabulary.items():
            # "\0" stands for the word end; a token without it is one from inside a word
            key = text[: -len(self.end)] + "\0" if text.endswith(self.end) and len(text) > len(self.end) else text
            self.automaton.add_word(key, len(key) << 20 | i)
        self.automaton.make_automaton()
        self.library = None
        self.merger = Tokenizer(models.BPE(vocab=self.vocabulary, merges=merges, end_of_word_suffix=self.end))
        self._trees(merges, Tokenizer(models.BPE(vocab=self.vocabulary, merges=merges)))
        self.pairs = memory.Memory(PAIRS, lanes=1)
        #: Words seen so far, by their place in ``flat``: the number of ids, then the ids.
        self.known = memory.Memory(REMEMBERED)
        self.flat, self.used = np.zeros(1 << 16, np.int32), 0

    def _names(self) -> list[str]:
        size = max([*self.vocabulary.values(), *self.special.values()]) + 1
        names = [""] * size
        for text, i in [*self.vocabulary.items(), *self.special.items()]:
            names[i] = text
        return names

    def _trees(self, merges: list[tuple[str, str]], inside) -> None:
        """For each token the rank of the merge that makes it and its two sides (-1: a single letter); ``sound`` tokens are those
        that come out when their own text is merged, by one merge only, and later than their sides."""
        size = len(self.names)
        self.rank, self.left, self.right = np.full(size, -1, np.int64), np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        made = np.zeros(size, np.int64)
        at = self.vocabulary
        of = np.array([(at[a], at[b], at[a + b]) for a, b in merges], np.int64).reshape(-1, 3)
        np.add.at(made, of[:, 2], 1)
        self.rank[of[:, 2]], self.left[of[:, 2]], self.right[of[:, 2]] = np.arange(len(of)), of[:, 0], of[:, 1]
        self.ranks = memory.Slots(1, len(of))
        code = (of[:, 0] << 20 | of[:, 1]).astype(np.uint64)[None, :]
        self.ranks.add(code, memory.hashes(code), np.arange(len(of)))
        self.sound = made <= 1
        some = np.flatnonzero(self.left >= 0)
        self.sound[some] &= self.rank[some] > np.maximum(self.rank[self.left[some]], self.rank[self.right[some]])
        texts = [(text, i) for text, i in self.vocabulary.items()]
        last = [text.endswith(self.end) and len(text) > len(self.end) for text, _ in texts]
        for merger, own in ((self.merger, [(t[: -len(self.end)], i) for (t, i), e in zip(texts, last, strict=True) if e]), (inside, [x for x, e in zip(texts, last, strict=True) if not e])):
            for (_, i), found in zip(own, merger.encode_batch([t for t, _ in own], add_special_tokens=False), strict=True):
                self.sound[i] &= found.ids == [i]

    # Exact merging

    def exact(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Exact merging of whole words, given in byte letters, by the library's own merger and nothing else of it: all ids, and
        the number of each word's."""
        if not words:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        found = self.merger.encode(words, is_pretokenized=True, add_special_tokens=False)
        return np.array(found.ids, np.int32), np.bincount(np.array(found.word_ids, np.int64), minlength=len(words))

    # Speculation

    def fits(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the tokens a and b side by side are what merging their text gives.

        Merges are undone from the last to the first. While x ends the left side and y begins the right one, x is used up by the
        merge of rank x_till and y by that of rank y_till; a merge of x with y that comes before both reaches over the seam. Of
        equal merges the one further left comes first.
        """
        good = self.sound[a] & self.sound[b]
        on = np.flatnonzero(good)
        x, y = a[on].astype(np.int64), b[on].astype(np.int64)
        x_till, y_till = np.full(len(on), _NEVER), np.full(len(on), _NEVER)
        while len(on):
            code = (x << 20 | y).astype(np.uint64)[None, :]
            seam = self.ranks.find(code, memory.hashes(code))
            over = (seam >= 0) & (seam < x_till) & (seam <= y_till)
            good[on[over]] = False
            rank_x, rank_y = self.rank[x], self.rank[y]
            undo_x = rank_x > rank_y
            x_till, y_till = np.where(undo_x, rank_x, x_till), np.where(undo_x, y_till, rank_y)
            x, y = np.where(undo_x, self.right[x], x), np.where(undo_x, y, self.left[y])
            more = ~over & (x >= 0) & (y >= 0)
            on, x, y, x_till, y_till = on[more], x[more], y[more], x_till[more], y_till[more]
        return good

    def _compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = (a << 20 | b).astype(np.uint64)[None, :]
        found = self.pairs.find(keys)
        miss = np.flatnonzero(found < 0)
        if len(miss):
            one, which = memory.distinct(keys[:, miss])
            new = miss[one]
            fits = self.fits(a[new], b[new]).astype(np.int64)
            found[miss] = fits[which]
            self.pairs.put(keys[:, new], fits)
        return found == 1

    def propose(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words, none empty, that stand in ``data`` as UTF-8: all ids, and the number of each word's."""
        n = len(starts)
        ends = np.cumsum(sizes + 1)
        points = np.zeros(int(ends[-1]), np.uint32)
        points[np.arange(len(points) - n) + np.repeat(np.arange(n), sizes)] = self.letters[_gather(data, starts, sizes)]
        text = points.tobytes().decode("utf-32-le")
        hits = np.fromiter(itertools.chain.from_iterable(self.automaton.iter_long(text)), np.int64).reshape(-1, 2)
        at, size, ids = hits[:, 0], hits[:, 1] >> 20, hits[:, 1] & 0xFFFFF
        word = np.searchsorted(ends, at, "right")
        counts = np.bincount(word, minlength=n)
        good = self.sound[ids]
        pair = np.flatnonzero(word[:-1] == word[1:])
        good[pair] &= self._compatible(ids[pair], ids[pair + 1])
        fine = (np.bincount(word, size, n) == sizes + 1) & (np.bincount(word, ~good, n) == 0)
        bad = np.flatnonzero(~fine)
        if not len(bad):
            return ids.astype(np.int32), counts
        merged, of_merged = self.exact([text[a:b] for a, b in zip((ends[bad] - sizes[bad] - 1).tolist(), (ends[bad] - 1).tolist(), strict=True)])
        sources = np.where(fine, np.cumsum(counts) - counts, 0)
        counts = counts.copy()
        counts[bad] = of_merged
        sources[bad] = len(ids) + np.cumsum(of_merged) - of_merged
        return _gather(np.concatenate([ids.astype(np.int32), merged]), sources, counts), counts

    # Texts

    def _split(self, text: str) -> list[str]:
        """Words of one stretch without special tokens, in the library's normal form."""
        if self._strange(text):
            # Letters that this Python's Unicode tables don't have: the library's own tables decide.
            if self.library is None:
                from tokenizers import Tokenizer

                self.library = Tokenizer.from_file(self.path)
            found = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
            return [bytes(self.byte_of[c] for c in w).decode() for w, _ in found]
        return self.words_of.findall(_normal(text))

    @staticmethod
    def _strange(text: str) -> bool:
        return bool(_BEYOND.search(text)) and any(c == "\U0001d6a6" or unicodedata.category(c) == "Cn" for c in set(text))

    def words(self, text: str) -> list[str]:
        out = []
        for part in self.special_of.split(text):
            out += [part] if part in self.special else self._split(part)
        return out

    @staticmethod
    def _cut(texts: list[str]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
        """Words of plain texts in normal form, all at once: (UTF-8, starts, sizes, number of each word's text)."""
        joined = "\n".join(texts) + "\n\n\n\n"
        data = joined.encode()
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        kind = _kinds()[points]
        n = len(points)
        starts, ends = kind != _SPACE, kind != _SPACE
        change = kind[1:] != kind[:-1]
        starts[1:] &= change | (kind[1:] == _NUMBER)
        ends[:-1] &= change | (kind[:-1] == _NUMBER)
        # An apostrophe alone takes one of s, t, m, d, re, ve, ll with it.
        mark = np.flatnonzero((points == 0x27) & starts & ends)
        mark = mark[mark < n - 3]
        one, two = points[mark + 1], points[mark + 2]
        short = (one == 0x73) | (one == 0x74) | (one == 0x6D) | (one == 0x64)
        long = ((one == 0x72) | (one == 0x76)) & (two == 0x65) | (one == 0x6C) & (two == 0x6C)
        mark, size = mark[short | long], np.where(short, 1, 2)[short | long]
        ends[mark], starts[mark + 1] = False, False
        ends[mark + size] = True
        after = mark + size + 1
        starts[after[kind[after] == _LETTER]] = True
        starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
        of = np.searchsorted(np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1), starts, "right")
        if len(data) != n:
            place = np.append(np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80), len(data))
            starts, ends = place[starts], place[ends]
        return data, starts, ends - starts, of

    def _remember(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Append ids of words to ``flat``; the place of each."""
        size = len(ids) + len(counts)
        if self.used + size > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.used], np.zeros(max(size, self.used), np.int32)])
        places = self.used + np.cumsum(counts + 1) - (counts + 1)
        part = np.ones(size, bool)
        part[places - self.used] = False
        self.flat[self.used : self.used + size][part] = ids
        self.flat[places] = counts
        self.used += size
        return places

    def _compact(self) -> None:
        """Leave what no remembered word refers to."""
        for slots in filter(None, (self.known.old, self.known.young)):
            held = slots.values >= 0
            places = slots.values[held]
            counts = self.flat[places].astype(np.int64)
            slots.moved = held, _gather(self.flat, places + 1, counts), counts
        self.used = 0
        self.flat = np.zeros(1 << 16, np.int32)
        for slots in filter(None, (self.known.old, self.known.young)):
            held, ids, counts = slots.moved
            slots.values[held] = self._remember(ids, counts)
            del slots.moved

    def _places(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Place in ``flat`` of each word's ids."""
        data = memory.padded(data)
        out = np.zeros(len(starts), np.int64)
        short = np.flatnonzero(sizes <= memory.KEY_BYTES)
        keys = memory.keys_of(memory.eights(data), starts[short], sizes[short])
        found = self.known.find(keys)
        miss = np.flatnonzero(found < 0)
        if len(miss):
            one, which = memory.distinct(keys[:, miss])
            new = short[miss[one]]
            places = self._remember(*self.propose(data, starts[new], sizes[new]))
            found[miss] = places[which]
            self.known.put(keys[:, miss[one]], places)
        out[short] = found
        if len(long := np.flatnonzero(sizes > memory.KEY_BYTES)):
            held = memoryview(data)
            first: dict[bytes, int] = {}
            which = [first.setdefault(held[a:b].tobytes(), len(first)) for a, b in zip(starts[long].tolist(), (starts[long] + sizes[long]).tolist(), strict=True)]
            new = long[np.unique(which, return_index=True)[1]]
            out[long] = self._remember(*self.propose(data, starts[new], sizes[new]))[which]
        return out

    def encode(self, texts: pa.Array) -> pa.ListArray:
        """Ids of each text; null counts as empty."""
        if self.used > HELD_IDS:
            self._compact()
        plain, odd = [], {}
        for i, text in enumerate(texts.fill_null("").to_pylist()):
            if "<|" in text or self._strange(text):
                odd[i] = self.words(text)
                plain.append("")
            else:
                plain.append(_normal(text))
        data, starts, sizes, of = self._cut(plain)
        special = np.full(len(starts), -1, np.int64)
        if odd:
            words = [w for i in odd for w in odd[i]]
            coded = [b"" if w in self.special else w.encode() for w in words]
            more = np.fromiter(map(len, coded), np.int64, len(coded))
            starts = np.concatenate([starts, len(data) + np.cumsum(more) - more])
            sizes = np.concatenate([sizes, more])
            of = np.concatenate([of, np.repeat(np.fromiter(odd, np.int64, len(odd)), [len(w) for w in odd.values()])])
            special = np.concatenate([special, np.array([self.special.get(w, -1) for w in words], np.int64)])
            data += b"".join(coded)
            order = np.argsort(of, kind="stable")
            starts, sizes, of, special = starts[order], sizes[order], of[order], special[order]
        usual = np.flatnonzero(special < 0)
        places = np.zeros(len(starts), np.int64)
        places[usual] = self._places(np.frombuffer(data, np.uint8), starts[usual], sizes[usual])
        if len(usual) < len(starts):
            some = np.flatnonzero(special >= 0)
            places[some] = self._remember(special[some].astype(np.int32), np.ones(len(some), np.int64))
        counts = self.flat[places].astype(np.int64)
        ids = _gather(self.flat, places + 1, counts)
        ends = np.concatenate([[0], np.cumsum(counts)])[np.searchsorted(of, np.arange(len(texts) + 1))]
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids, pa.int32()))

    def decode(self, ids: pa.ListArray) -> pa.Array:
        """Token strings of each list joined by a space, which is what the library gives where a vocabulary file has no decoder."""
        return pc.binary_join(pa.ListArray.from_arrays(ids.offsets, self.names.take(ids.values)), " ")


def _normal(text: str) -> str:
    return unicodedata.normalize("NFC", text).replace("\u03a3", "\u03c3").lower()


def codec_of(model: str | None) -> Codec:
    if model is None:
        import public_tokenizers

        model = public_tokenizers.path(MODEL)
    if model not in _CODECS:
        _CODECS[model] = Codec(model)
    return _CODECS[model]


def _coded(model: str | None, size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks.chunks(batches, "text", size):
            codec = codec_of(model)
            ids = codec.encode(part.column(1))
            yield pa.RecordBatch.from_arrays([part.column(0), ids, codec.decode(ids)], names=["doc_id", "ids", "decoded"])

    return run


def encode_decode(docs: DataFrame, *, model: str | None = None) -> DataFrame:
    """(doc_id, ids array<int>, decoded string) for each row of ``docs`` (doc_id, text; more columns are ignored).

    Ids are those of the library without added special tokens, truncation or padding; special strings inside a text are the
    special tokens. A null or empty text has no ids and decodes to an empty string. Repeated rows give repeated rows; an empty
    table gives no rows. A very long text is coded whole, in memory of some tens of times its bytes. One pass over Arrow batches,
    no shuffle; ``model`` is a path that every executor can open, by default the installed file.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return blocks.map_arrow(texts, _coded(model, 1 << 19), "doc_id long, ids array<int>, decoded string")


def digests(coded: DataFrame) -> DataFrame:
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids.cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op10_bpe_encoding_and_decoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(encode_decode(table(spark, sf_dir, "documents")))
