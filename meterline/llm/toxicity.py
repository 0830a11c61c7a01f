"""Toxicity by a classifier chain.

Categories are label columns in a fixed order. Each category's linear model sees the words of a text and the probabilities
of the categories before it; for training, those are out-of-fold predictions, so that a later model never leans on
probabilities which an earlier one had learned by heart. Features are whole words and word beginnings (six bytes), chosen by
chi-square on a bounded sample of labelled rows; scoring goes over every whole text in one pass.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks
from .workspace import table, without

#: Bound on the labelled rows that training sees; features kept per category; folds; bytes of a word beginning.
SAMPLE_ROWS, FEATURES, FOLDS, BEGINNING = 10_000, 256, 5, 6
_BEGINNING_SALT = np.uint64(0x5851F42D4C957F2D)


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(feature hashes, offsets by text) of each text: distinct words and beginnings of longer words."""
    words = blocks.Words(texts, blocks.NOT_ALNUM)
    long = np.flatnonzero(words.ends - words.starts > BEGINNING)
    heads = words.hash_of(words.starts[long], words.starts[long] + BEGINNING) ^ _BEGINNING_SALT
    values, owner = np.concatenate([words.hashes, heads]), np.concatenate([words.text_of, words.text_of[long]])
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    fresh = np.ones(len(values), bool)
    fresh[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    return values[fresh], np.searchsorted(owner[fresh], np.arange(len(texts) + 1))


@dataclass
class Chain:
    categories: list[str]
    keys: np.ndarray  #: sorted feature hashes
    weights: np.ndarray  #: categories x features
    bias: np.ndarray
    links: np.ndarray  #: categories x categories, weight of an earlier category's log-odds
    thresholds: np.ndarray

    def probabilities(self, texts: pa.Array) -> np.ndarray:
        """texts x categories."""
        values, offsets = features(texts)
        n = len(texts)
        at = np.searchsorted(self.keys, values)
        known = at < len(self.keys)
        known[known] = self.keys[at[known]] == values[known]
        owner = np.repeat(np.arange(n), np.diff(offsets))[known]
        at = at[known]
        odds = np.zeros((n, len(self.categories)))
        for k in range(len(self.categories)):
            odds[:, k] = self.bias[k] + np.bincount(owner, self.weights[k][at], n) + _clipped(odds[:, :k]) @ self.links[k, :k]
        return 1 / (1 + np.exp(-odds))


def _clipped(odds: np.ndarray) -> np.ndarray:
    return np.clip(odds, -8, 8)


class _Rows:
    """0/1 features by row as index pairs, beside a few dense columns and an intercept."""

    def __init__(self, owner: np.ndarray, column: np.ndarray, dense: np.ndarray, width: int):
        self.owner, self.column, self.width = owner, column, width
        self.dense = np.concatenate([dense, np.ones((len(dense), 1))], axis=1)

    def some(self, keep: np.ndarray) -> _Rows:
        held = keep[self.owner]
        return _Rows((np.cumsum(keep) - 1)[self.owner[held]], self.column[held], self.dense[keep, :-1], self.width)

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.owner, w[self.column], len(self.dense)) + self.dense @ w[self.width :]

    def back(self, r: np.ndarray) -> np.ndarray:
        return np.concatenate([np.bincount(self.column, r[self.owner], self.width), self.dense.T @ r])


def _fit(x: _Rows, y: np.ndarray, ridge: float = 1.0, steps: int = 200) -> np.ndarray:
    """Ridge logistic regression by accelerated gradient steps: weights of the features, of the dense columns, the intercept;
    the last isn't shrunk."""
    size = x.width + x.dense.shape[1]
    shrink = np.full(size, ridge)
    shrink[-1] = 0
    v, top = np.ones(size), 1.0
    for _ in range(20):  # largest eigenvalue, for the step
        v = x.back(x.times(v))
        top = np.linalg.norm(v) or 1.0
        v /= top
    step = 1 / (0.25 * max(top, 1.0) + ridge)
    w, t = np.zeros(size), 1.0
    ahead = w
    for _ in range(steps):
        new = ahead - step * (x.back(1 / (1 + np.exp(-x.times(ahead))) - y) + shrink * ahead)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead = new + (t - 1) / t_new * (new - w)
        w, t = new, t_new
    return w


def _best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The cutoff with the highest F1 on out-of-fold predictions; 0.5 without positives."""
    if not y.any():
        return 0.5
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    last = np.append(p[order][1:] != p[order][:-1], True)
    at = int(np.argmax(np.where(last, f1, -1)))
    below = p[order][at + 1] if at + 1 < len(y) else p[order][at] / 2
    return float(np.clip((p[order][at] + below) / 2, 0.2, 0.8))


def _counts(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in ascending order, and how often each occurs."""
    values = np.concatenate(lists) if lists else np.zeros(0, np.uint64)
    values.sort()
    fresh = np.ones(len(values), bool)
    fresh[1:] = values[1:] != values[:-1]
    at = np.flatnonzero(fresh)
    return values[at], np.diff(np.append(at, len(values)))


def train(rows: list[tuple[int, np.ndarray, list[float]]], categories: list[str]) -> Chain:
    """``rows``: (fold number, distinct feature hashes, 0/1 label of each category). Without rows nothing is ever found."""
    n, m = len(rows), len(categories)
    y = np.array([r[2] for r in rows], float).reshape(n, m)
    # Features are counted by sorting; what the chosen ones don't need is never held as indices.
    distinct, seen = _counts([r[1] for r in rows])
    chosen = np.zeros(len(distinct), bool)
    for k in range(m):
        total = y[:, k].sum()
        with np.errstate(divide="ignore", invalid="ignore"):
            held, times = _counts([r[1] for r, on in zip(rows, y[:, k] > 0, strict=True) if on])
            both = np.zeros(len(distinct))
            both[np.searchsorted(distinct, held)] = times
            expected = seen * total / max(n, 1)
            chi = (both - expected) ** 2 * n / (expected * (1 - total / max(n, 1)) * (n - seen))
        chi = np.where((seen >= 3) & np.isfinite(chi), chi, 0)
        best = np.lexsort((distinct, -chi))[:FEATURES]
        chosen[best[chi[best] >= 10.83]] = True
    keys = distinct[chosen]
    owner, column = [], []
    for i, r in enumerate(rows):
        at = np.searchsorted(keys, r[1])
        at = at[keys[np.minimum(at, len(keys) - 1)] == r[1]] if len(keys) else at[:0]
        column.append(at)
        owner.append(np.full(len(at), i))
    owner, column = (np.concatenate(x) if n else np.zeros(0, np.int64) for x in (owner, column))
    fold = np.array([r[0] for r in rows], int) % FOLDS
    weights, bias, links, thresholds = np.zeros((m, len(keys))), np.full(m, -8.0), np.zeros((m, m)), np.full(m, 0.5)
    earlier = np.zeros((n, 0))  # out-of-fold log-odds of the categories so far
    for k in range(m):
        if not n or not y[:, k].any():
            earlier = np.concatenate([earlier, np.full((n, 1), -8.0)], axis=1)
            continue
        full = _Rows(owner, column, earlier / 4, len(keys))
        held_out = np.zeros(n)
        for f in range(FOLDS):
            held_out[fold == f] = full.some(fold == f).times(_fit(full.some(fold != f), y[fold != f, k]))
        w = _fit(full, y[:, k])
        weights[k], links[k, :k], bias[k] = w[: len(keys)], w[len(keys) : -1] / 4, w[-1]
        thresholds[k] = _best_threshold(1 / (1 + np.exp(-held_out)), y[:, k])
        earlier = np.concatenate([earlier, _clipped(held_out)[:, None]], axis=1)
    return Chain(categories, keys, weights, bias, links, thresholds)


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in blocks.chunks(batches, "text"):
        values, offsets = features(part.column(1))
        yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values.view(np.int64)))], names=["doc_id", "found"])


def fit_chain(docs: DataFrame, labels: DataFrame, categories: dict[str, str], *, sample_rows: int = SAMPLE_ROWS) -> Chain:
    """Train on the ``sample_rows`` labelled documents with the smallest hash of doc_id. ``categories`` maps a category to a SQL
    predicate on ``labels`` (doc_id, ...), in chain order; rows with a null label or id, or without a text, are left out."""
    label = [F.expr(rule).cast("double").alias(name) for name, rule in categories.items()]
    sample = labels.select(F.col("doc_id").cast("long").alias("doc_id"), *label).dropna().dropDuplicates(["doc_id"]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    # sample_rows bounds this side, so it may be broadcast.
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    held = texts.join(F.broadcast(sample.select("doc_id")), "doc_id", "left_semi")
    found = blocks.map_arrow(held, _featured, "doc_id long, found array<long>").dropDuplicates(["doc_id"])
    got = found.join(F.broadcast(sample), "doc_id").withColumn("_fold", F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(FOLDS))).select("doc_id", "_fold", "found", *categories).toArrow()
    ids = got.column("found")
    order = np.argsort(got.column("doc_id").to_numpy(), kind="stable").tolist()
    lists = [ids[i].values.to_numpy().view(np.uint64) for i in range(len(ids))]
    folds, ys = got.column("_fold").to_pylist(), np.stack([got.column(c).to_numpy() for c in categories], axis=1) if len(ids) else np.zeros((0, len(categories)))
    chain = train([(folds[i], lists[i], ys[i].tolist()) for i in order], list(categories))
    del got, ids, lists
    blocks.give_back()
    return chain


def _scored(chain: Chain) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks.chunks(batches, "text"):
            p = chain.probabilities(part.column(1).fill_null(""))
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(np.ascontiguousarray(p[:, k])) for k in range(p.shape[1]))], names=["doc_id", *(f"p_{c}" for c in chain.categories)])

    return run


def score(docs: DataFrame, chain: Chain) -> DataFrame:
    """(doc_id, p_<category>..., <category> boolean...) for each row of ``docs`` (doc_id, text; more columns are ignored).

    Whole texts are scored, no shuffle. A null or empty text has no features and gets the models' base rates. Repeated rows give
    repeated rows; a null doc_id is carried; an empty table gives no rows. A very long text is scored whole, in memory of some
    tens of times its bytes.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = blocks.map_arrow(texts, _scored(chain), ", ".join(["doc_id long", *(f"p_{c} double" for c in chain.categories)]))
    return scored.select("*", *((F.col(f"p_{c}") >= float(t)).alias(c) for c, t in zip(chain.categories, chain.thresholds, strict=True)))


#: The labelled categories in chain order. The labels at hand know only one kind of toxicity; low quality goes before it as the one
#: other category. With labels of more kinds (insult, threat, ...) the chain takes one link for each, see ``toxicity``.
CATEGORIES = {"low_quality": "quality = 0", "toxic": "toxic = 1"}


def toxicity(docs: DataFrame, labels: DataFrame, *, categories: dict[str, str] | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Train a chain on ``labels`` and score every document; see ``fit_chain`` and ``score``."""
    return score(docs, fit_chain(docs, labels, categories or CATEGORIES, sample_rows=sample_rows))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that aren't found toxic, all columns unchanged; rows without doc_id stay, and an empty table stays
    empty. A doc_id that occurs more than once goes with all its rows."""
    return without(docs, toxicity(docs, labels).where("toxic").select("doc_id"), "toxic")


def op7_classifier_chain_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "p_low_quality", "p_toxic", "toxic", (~F.col("toxic")).alias("kept"))
