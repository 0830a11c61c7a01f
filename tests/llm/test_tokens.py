import hashlib
import json
import random

import numpy as np
import pyarrow as pa
import pytest

from meterline.llm import bpe, token_counts

from ..conftest import DATA
from .conftest import EDGE

ODD = ["a", " a", "a ", "\n\n a\n b", "x▁ y", "▁", "▁▁ ▁a", "a▁", "▁ \n", "<s> </s> <unk> <0x0A>", "<|endoftext|>", "a<|startoftext|>b <|ENDOFTEXT|>", "ΟΔΟΣ İ", "l'été n'est 'S", "a</w>b </w>", "\U0003d000x", "՘a", "１２½", "\x1c\x85"]


def texts():
    rng = random.Random(3)
    letters = "ab c\n▁\tdeéßñ日😀'1.,!<|>/wsStT"
    return [*EDGE, *ODD, *("".join(rng.choice(letters) for _ in range(rng.randrange(50))) for _ in range(500))]


@pytest.fixture(scope="module")
def paths():
    return pytest.importorskip("public_tokenizers")


def test_counts_are_the_library_s(paths):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=paths.path(token_counts.MODEL))
    counter = token_counts.counter_of(None)
    assert counter.cuts and len(counter.whole) > 20000 and counter.table.held > 20000
    want = [len(library.encode(t or "", num_threads=1)) for t in texts()]
    assert counter.count(pa.array(texts(), pa.string())).tolist() == want


def test_counts_without_the_cut_proof(paths):
    counter = token_counts.Counter(paths.path(token_counts.MODEL))
    want = counter.count(pa.array(texts(), pa.string())).tolist()
    counter.cuts = False
    assert counter.count(pa.array(texts(), pa.string())).tolist() == want


def test_ids_are_the_library_s(paths):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(paths.path(bpe.MODEL))
    codec = bpe.codec_of(None)
    ids = codec.encode(pa.array(texts(), pa.string()))
    decoded = codec.decode(ids).to_pylist()
    for t, got, back in zip(texts(), ids.to_pylist(), decoded, strict=True):
        want = library.encode(t or "", add_special_tokens=False).ids
        assert got == want and back == library.decode(want, skip_special_tokens=False)


def plain_merge(codec, ranks, symbols):
    """Lowest rank first, leftmost among equals."""
    while True:
        found = [(ranks[pair], i) for i, pair in enumerate(zip(symbols, symbols[1:], strict=False)) if pair in ranks]
        if not found:
            return [codec.vocabulary[s] for s in symbols]
        _, i = min(found)
        symbols = [*symbols[:i], symbols[i] + symbols[i + 1], *symbols[i + 2 :]]


@pytest.fixture(scope="module")
def ranks(paths):
    with open(paths.path(bpe.MODEL), encoding="utf-8") as f:
        merges = json.load(f)["model"]["merges"]
    return {tuple(m) if isinstance(m, list) else tuple(m.split(" ")): k for k, m in enumerate(merges)}


def symbols_of(codec, text):
    if text.endswith(codec.end) and len(text) > len(codec.end):
        text = text[: -len(codec.end)]
        return [*text[:-1], text[-1] + codec.end]
    return list(text)


def test_pairs_fit_when_merging_gives_them_back(paths, ranks):
    codec, rng = bpe.codec_of(None), random.Random(4)
    names = codec.names.to_pylist()
    inside = [i for t, i in codec.vocabulary.items() if not t.endswith(codec.end)]
    some = [(rng.choice(inside), rng.randrange(49406)) for _ in range(3000)]
    some += [(i, j) for x in ("a", "aa", "aaa", "th", "the", "e", "in", "ing") for y in ("a", "aa", "aaa</w>", "a</w>", "e</w>", "ing</w>", "g", "h") if (i := codec.vocabulary.get(x)) and (j := codec.vocabulary.get(y))]
    a, b = np.array(some, np.int64).T
    got = codec.fits(a, b)
    want = [plain_merge(codec, ranks, symbols_of(codec, names[x]) + symbols_of(codec, names[y])) == [x, y] for x, y in some]
    assert got.tolist() == want and 0 < sum(want) < len(want)


def test_proposals_that_fail_are_merged(paths, ranks):
    codec, rng = bpe.codec_of(None), random.Random(5)
    words = ["zxqj", "thththe", "ingination", "a", "aaaaaaaaaaaa", "qqqqqq", *("".join(rng.choice("thenaioslrd") for _ in range(rng.randrange(1, 14))) for _ in range(400))]
    data = "".join(words).encode()
    sizes = np.array([len(w) for w in words])
    ids, counts = codec.propose(np.frombuffer(data, np.uint8), np.cumsum(sizes) - sizes, sizes)
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [plain_merge(codec, ranks, [*w[:-1], w[-1] + codec.end]) for w in words]


def test_small_memories_change_nothing(paths, monkeypatch):
    """Memories that overflow all the time, over texts half of whose words are new."""
    from tokenizers import Tokenizer
    import sentencepiece

    monkeypatch.setattr(bpe, "REMEMBERED", 300)
    monkeypatch.setattr(bpe, "PAIRS", 200)
    monkeypatch.setattr(bpe, "HELD_IDS", 2000)
    monkeypatch.setattr(token_counts, "REMEMBERED", 300)
    codec, counter = bpe.Codec(paths.path(bpe.MODEL)), token_counts.Counter(paths.path(token_counts.MODEL))
    library, pieces = Tokenizer.from_file(paths.path(bpe.MODEL)), sentencepiece.SentencePieceProcessor(model_file=paths.path(token_counts.MODEL))
    rng = random.Random(9)
    name = lambda: "".join(rng.choice("abcdeghilmnorstuéü") for _ in range(rng.randrange(1, 30)))
    common = [name() for _ in range(300)]
    for _ in range(12):
        batch = [" ".join(rng.choice(common) if rng.random() < 0.5 else name() for _ in range(200)) for _ in range(5)]
        assert codec.encode(pa.array(batch)).to_pylist() == [library.encode(t, add_special_tokens=False).ids for t in batch]
        assert counter.count(pa.array(batch)).tolist() == [len(pieces.encode(t)) for t in batch]


def test_whole_tables_are_the_library_s(paths):
    from tokenizers import Tokenizer
    import pyarrow.parquet as pq
    import sentencepiece

    texts = pq.read_table(DATA / "documents.parquet", columns=["text"])["text"].to_pylist()
    library, pieces = Tokenizer.from_file(paths.path(bpe.MODEL)), sentencepiece.SentencePieceProcessor(model_file=paths.path(token_counts.MODEL))
    codec, counter = bpe.codec_of(None), token_counts.counter_of(None)
    assert codec.encode(pa.array(texts, pa.string())).to_pylist() == [x.ids for x in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert counter.count(pa.array(texts, pa.string())).tolist() == [len(x) for x in pieces.encode([t or "" for t in texts])]


def test_queries_on_edges(spark, edge_docs, no_docs, paths):
    counts = token_counts.token_counts(edge_docs).collect()
    assert len(counts) == edge_docs.count()
    by_id = {r.doc_id: r for r in counts}
    assert by_id[0].n_bytes == by_id[0].n_tokens == 0 and by_id[10].over_limit and None in by_id
    coded = bpe.digests(bpe.encode_decode(edge_docs)).collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert {(r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in coded if r.doc_id in (0, 1, 2)} == {(0, empty, empty)}
    assert sum(r.doc_id == 6 for r in coded) == 2
    assert token_counts.token_counts(no_docs).count() == bpe.encode_decode(no_docs).count() == 0
