"""Toxicity by a classifier chain: linear models in a fixed order, each fed with the probabilities of those before it.

Features are words that tell: lower-cased runs of letters, of which those are taken whose presence in a text depends on
some label of the training rows (chi-squared of at least TELLING). Link k of the chain is a logistic regression on which
of them the whole text holds and on the probabilities of links 1 to k - 1. Later links are trained with out-of-fold
predictions of the earlier ones (FOLDS folds by hash of the document; words, too, are chosen without the fold's rows), so
that they see such errors as they will meet.

Training takes at most SAMPLE labelled rows, those with the smallest hash of their doc_id; all rows are scored.

Defined results: null texts are empty; a text without words gets the chain's base rates; labels that are null are left
out of training; repeated labels of one doc_id count each; rows with a null doc_id are scored but not trained on; without
usable labels every probability is 0 and nothing is rejected; an empty table stays empty; extra columns are carried along,
those named like the added ones are replaced.
"""
from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import arrow, words

#: Labelled rows that training takes at most, and bytes of text that it takes of them.
SAMPLE, SAMPLE_BYTES = 8_000, 32 << 20
#: Chi-squared from which a word tells.
TELLING = 40.0
FOLDS, EPOCHS = 3, 150
#: Probability of the last category from which a row is rejected.
THRESHOLD = 0.4
#: Categories in the order of the chain; a row is rejected by the last one.
CATEGORIES = ("low_quality", "toxic")
_U = np.uint64


@dataclass
class Rows:
    """Words of rows: row i has the entries at[i] to at[i + 1] of index, numbers below width."""

    at: np.ndarray
    index: np.ndarray
    width: int

    def dot(self, w: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0.0], np.cumsum(w[self.index])])
        return total[self.at[1:]] - total[self.at[:-1]]

    def back(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.index, np.repeat(r, np.diff(self.at)), self.width)


def _words(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The number of rows, and hashes and rows of their words, by blocks."""
    for lo, hi, data, off in words.blocks(texts, lower=True):
        letters = np.where((data < 97) | (data > 122) & (data < 128), np.uint8(32), data)
        start, end, row = words.spans(letters, off)
        yield hi - lo, words.hashes(letters, start, end), row


@dataclass
class Held:
    """Which words rows hold: each (row, word hash) once."""

    rows: int
    row: np.ndarray
    word: np.ndarray

    def take(self, some: np.ndarray) -> Held:
        """Those rows, numbered anew."""
        to = np.full(self.rows, -1)
        to[some] = np.arange(len(some))
        own = to[self.row] >= 0
        return Held(len(some), to[self.row[own]], self.word[own])

    def known(self, known: np.ndarray) -> Rows:
        """Which of the known words (sorted hashes) each row holds."""
        width = max(len(known), 1)
        if not len(known):
            return Rows(np.zeros(self.rows + 1, np.int64), np.zeros(0, np.int64), width)
        hit = _among(known, self.word)
        own = np.sort(self.row[hit] * width + np.searchsorted(known, self.word[hit]))
        return Rows(np.append(0, np.cumsum(np.bincount(own // width, minlength=self.rows))), own % width, width)


def _among(known: np.ndarray, h: np.ndarray) -> np.ndarray:
    return known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h if len(known) else np.zeros(len(h), bool)


def held(texts: pa.Array, only: np.ndarray | None = None) -> Held:
    """The words of texts, or those among `only` (sorted hashes)."""
    row, word, first = [np.zeros(0, np.int64)], [np.zeros(0, _U)], 0
    for n, h, r in _words(texts):
        if only is not None:
            there = _among(only, h)
            h, r = h[there], r[there]
        by = np.lexsort((h, r))
        h, r = h[by], r[by]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
        row.append(r[new] + first)
        word.append(h[new])
        first += n
    return Held(first, np.concatenate(row), np.concatenate(word))


def telling(own: Held, labels: np.ndarray) -> np.ndarray:
    """Sorted hashes of the words whose presence in a row depends on some label."""
    word, which = np.unique(own.word, return_inverse=True)
    there = np.bincount(which, minlength=len(word)).astype(float)
    best, total = np.zeros(len(word)), max(len(labels), 1)
    for y in labels.T:
        both = np.bincount(which, y[own.row], len(word))
        due = there * y.sum() / total
        spread = due * (1 - y.sum() / total) * (1 - there / total)
        best = np.maximum(best, np.where(spread > 0, (both - due) ** 2 / np.maximum(spread, 1e-12), 0))
    return word[best >= TELLING]


@dataclass
class Linear:
    w: np.ndarray
    extra: np.ndarray
    bias: float

    def probability(self, x: Rows, before: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x.dot(self.w) + before @ self.extra + self.bias, -60, 60)))


def train(x: Rows, before: np.ndarray, y: np.ndarray, epochs: int = EPOCHS) -> Linear:
    """Logistic regression by Adagrad on the whole sample."""
    w, extra, bias = np.zeros(x.width), np.zeros(before.shape[1]), 0.0
    gw, ge, gb = np.full(len(w), 1e-12), np.full(len(extra), 1e-12), 1e-12
    for _ in range(epochs):
        r = (Linear(w, extra, bias).probability(x, before) - y) / max(len(y), 1)
        dw, de, db = x.back(r) + 1e-6 * w, before.T @ r, r.sum()
        gw += dw * dw
        ge += de * de
        gb += db * db
        w = w - 0.7 * dw / np.sqrt(gw)
        extra = extra - 0.7 * de / np.sqrt(ge)
        bias -= 0.7 * db / np.sqrt(gb)
    return Linear(w, extra, bias)


@dataclass
class Chain:
    known: np.ndarray
    links: list[Linear]


def fit(own: Held, fold: np.ndarray, labels: np.ndarray) -> Chain:
    """The chain for labels (rows, links)."""
    known = telling(own, labels)
    x = own.known(known)
    parts = []  # of each fold: its rows, the other rows, and both by words that tell in the other rows
    for f in range(FOLDS):
        out, rest = np.flatnonzero(fold == f), np.flatnonzero(fold != f)
        if len(out) and len(rest):
            learns = own.take(rest)
            tell = telling(learns, labels[rest])
            parts.append((out, rest, own.take(out).known(tell), learns.known(tell)))
    before = np.zeros((len(labels), 0))
    chain = []
    for k in range(labels.shape[1]):
        y = labels[:, k].astype(bool)
        chain.append(train(x, before, y))
        seen = np.full(len(y), y.mean())  # of rows without a fold to learn from
        for out, rest, unseen, learnt in parts:
            seen[out] = train(learnt, before[rest], y[rest]).probability(unseen, before[out])
        before = np.column_stack([before, seen])
    return Chain(known, chain)


def learned(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Chain:
    """The chain, trained on a bounded sample of the labelled rows."""
    y = labels.select("doc_id", (F.col("quality") == 0).cast("int").alias("y0"), (F.col("toxic") == 1).cast("int").alias("y1")).dropna()
    y = y.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # at most `sample` small rows
    some = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(y), "doc_id")
    some = some.withColumn("h", F.xxhash64("doc_id")).withColumn("_b", F.octet_length("text"))
    # Texts are counted against SAMPLE_BYTES in the order of the hash; whole texts only.
    share = some.agg(F.sum("_b")).first()[0] or 0
    if share > SAMPLE_BYTES:
        some = some.filter(F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(1 << 20)) < int((1 << 20) * SAMPLE_BYTES / share))
    got = some.select("text", "h", "y0", "y1").toArrow()
    if not got.num_rows:
        return Chain(np.zeros(0, _U), [])
    by = np.lexsort([got["h"].to_numpy()])
    got = got.take(pa.array(by))
    return fit(held(got["text"]), got["h"].to_numpy().view(_U) % FOLDS, np.stack([got["y0"].to_numpy(), got["y1"].to_numpy()], 1))


def _probabilities(texts: pa.Array, chain: Chain, links: int) -> np.ndarray:
    """(rows, links) probabilities; 0 without a trained chain."""
    p = np.zeros((len(texts), links))
    if chain.links and len(texts):
        x = held(texts, chain.known).known(chain.known)
        for k, link in enumerate(chain.links):
            p[:, k] = link.probability(x, p[:, :k])
    return p


def scored(docs: DataFrame, chain: Chain, names: Sequence[str] = CATEGORIES) -> DataFrame:
    """docs with the probability p_<name> of each link."""
    docs = docs.drop(*(f"p_{n}" for n in names))
    at = docs.columns.index("text")
    schema = docs.schema
    for name in names:
        schema = T.StructType([*schema.fields, T.StructField(f"p_{name}", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = _probabilities(batch.column(at), chain, len(names))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(np.ascontiguousarray(p[:, k])) for k in range(len(names)))], names=schema.names)

    return arrow.over(docs, run, schema)


def judged(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs with p_low_quality, p_toxic and toxic (boolean): whether the last link's probability reaches the threshold."""
    return scored(docs, learned(docs, labels)).withColumn("toxic", F.col(f"p_{CATEGORIES[-1]}") >= threshold)


def kept(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that `judged` doesn't call toxic, whatever their other columns."""
    chain, at = learned(docs, labels), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_probabilities(batch.column(at), chain, len(CATEGORIES))[:, -1] < threshold))

    return arrow.over(docs, run, docs.schema)
