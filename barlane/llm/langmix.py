"""Languages of texts as mixtures, fitted by expectation-maximisation over n-gram likelihoods.

A text is lower-cased, runs of bytes that are no letters become one space, and each run of ORDER bytes is an event. Events
fall into buckets by hash, and for each language the smoothed share of every bucket is learned from all training texts. A
text's events are taken as drawn from a mixture of languages; EM estimates its proportions. The set of languages grows from
the likeliest one: the one that promises most joins, and stays if the likelihood rises by more than PENALTY for each doubling
of the number of events. By concavity of the likelihood the gradient at a set bounds what any further language can add, so
most texts are settled without EM.

The model has a row for each bucket and a column for each language; BUCKETS is halved until it takes MODEL_BYTES at most, so
what goes to the driver and to tasks is bounded whatever the corpus.

Defined results: a text that is null or has no letter is `und` with score 0 and no languages; without training rows all are;
a text of fewer than ORDER bytes in words has the most frequent language; languages are ordered by share, then name; rows
without a doc_id or without a lang are not learned from; repeated rows count each; a text is read whole, however long; an
empty table stays empty; extra columns are carried along, those named like the added ones are replaced.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import arrow, words

#: Bytes of an event.
ORDER = 4
#: Buckets at most, and bytes of the model at most.
BUCKETS, MODEL_BYTES = 1 << 17, 64 << 20
#: Added to each bucket's count, in events for each bucket.
SMOOTH = 0.1
#: Logarithmic likelihood that a further language has to bring, for each doubling of the number of events.
PENALTY = 4.0
ROUNDS, STILL = 200, 1e-7
#: Events that are worked on at once.
PIECE = 1 << 20
UNKNOWN = "und"
ADDED = ("lang_pred", "score", "languages", "shares")
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = _LETTER[128:] = True


def _lower(texts: pa.Array) -> pa.Array:
    texts = texts.cast(pa.large_string())
    try:
        return pc.utf8_lower(texts)
    except pa.ArrowInvalid:  # bytes that are no UTF-8
        return pa.array([None if b is None else b.decode("utf-8", "replace").lower() for b in texts.cast(pa.large_binary()).to_pylist()], pa.large_string())


def buckets(texts: pa.Array, number: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows and buckets of the events of texts, PIECE at a time."""
    for lo, _, data, off in words.blocks(_lower(texts), lower=True):
        letter = _LETTER[data]
        keep = letter.copy()
        keep[1:] |= letter[:-1]  # the byte after a run stands for its end
        starts = off[:-1][off[:-1] < off[1:]]
        keep[starts] = True  # and one before the first
        kept = np.flatnonzero(keep)
        flat = np.where(letter[kept], data[kept], np.uint8(32))
        row = np.searchsorted(off, kept, "right") - 1
        view = words.eights(flat)
        mask = np.uint64((1 << 8 * ORDER) - 1)
        for a in range(0, max(len(flat) - ORDER + 1, 0), PIECE):
            b = min(a + PIECE, len(flat) - ORDER + 1)
            own = row[a:b] == row[a + ORDER - 1 : b + ORDER - 1]
            yield row[a:b][own] + lo, (words.mix(view[a:b][own] & mask) & np.uint64(number - 1)).astype(np.int64)


@dataclass(frozen=True)
class Model:
    """Names of the languages, their shares of training texts, and the share of each bucket in each of them."""

    names: list[str]
    prior: np.ndarray
    p: np.ndarray  # (buckets, languages)


def learned(train: DataFrame, number: int = BUCKETS) -> Model:
    """The model of train (text, lang), by counts over all its rows."""
    train = train.filter("text IS NOT NULL AND lang IS NOT NULL").select("text", "lang")
    texts = {r.lang: r.n for r in train.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row for each language
    names = sorted(texts)
    while len(names) * number * 8 > MODEL_BYTES and number > 256:
        number //= 2
    place = {n: i for i, n in enumerate(names)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(len(names) * number, np.int64)
        for batch in batches:
            lang = np.array([place[x] for x in batch.column(1).to_pylist()], np.int64)
            for row, bucket in buckets(batch.column(0), number):
                counts += np.bincount(lang[row] * number + bucket, minlength=len(counts))
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], names=["at", "n"])

    got = arrow.over(train, run, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n")).toArrow()  # languages times buckets at most
    counts = np.full(len(names) * number, SMOOTH)
    counts[got["at"].to_numpy()] += got["n"].to_numpy()
    p = counts.reshape(len(names), number)
    p = p / p.sum(1, keepdims=True)
    prior = np.array([texts[n] for n in names], float)
    return Model(names, prior / max(prior.sum(), 1), np.ascontiguousarray(p.T))


def fitted(p: np.ndarray, n: np.ndarray, share: np.ndarray) -> np.ndarray:
    """EM from `share`: proportions of the columns of p (events, languages) for events that occur n times."""
    total = n.sum()
    for _ in range(ROUNDS):
        new = share * ((n / (p @ share)) @ p) / total
        if np.abs(new - share).max() < STILL:
            return new
        share = new
    return share


def mixture(p: np.ndarray, n: np.ndarray, prior: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chosen languages and their proportions, for events with the likelihoods p (events, languages) that occur n times."""
    total = n.sum()
    penalty = PENALTY * np.log2(total + 1)
    chosen = [int((n @ np.log(p) + np.log(prior)).argmax())]
    share = np.ones(1)
    while len(chosen) < p.shape[1]:
        mixed = p[:, chosen] @ share
        gain = (n / mixed) @ p - total  # no mixture with that language gains more
        gain[chosen] = -np.inf
        more = int(gain.argmax())
        if gain[more] <= penalty:
            break
        wider = fitted(p[:, [*chosen, more]], n, np.append(0.9 * share, 0.1))
        if n @ np.log((p[:, [*chosen, more]] @ wider) / mixed) <= penalty:
            break
        chosen, share = [*chosen, more], wider
    return np.array(chosen), share


def mixtures(texts: pa.Array, model: Model) -> list[tuple[np.ndarray, np.ndarray]]:
    """Chosen languages and proportions of each text.

    A first pass adds up each text's likelihood under every language, a second one the gradients at the likeliest; only
    texts that a further language may help are fitted by EM, on their distinct events.
    """
    rows, k = len(texts), len(model.names)
    number = len(model.p)
    single, events = np.zeros((rows, k)), np.zeros(rows)
    logs = np.log(model.p)
    for row, bucket in buckets(texts, number):
        events += np.bincount(row, minlength=rows)
        for j in range(k):
            single[:, j] += np.bincount(row, logs[bucket, j], rows)
    best = (single + np.log(model.prior)).argmax(1)
    slope = np.zeros((rows, k))
    for row, bucket in buckets(texts, number):
        mine = model.p[bucket, best[row]]
        for j in range(k):
            slope[:, j] += np.bincount(row, model.p[bucket, j] / mine, rows)
    gain = slope - events[:, None]
    gain[np.arange(rows), best] = -np.inf
    open_ = gain.max(1) > PENALTY * np.log2(events + 1)
    out = [(np.array([b]), np.ones(1)) for b in best]
    for i in np.flatnonzero(open_):
        counts: tuple[np.ndarray, np.ndarray] = np.zeros(0, np.int64), np.zeros(0)
        for _, bucket in buckets(texts.slice(i, 1), number):
            seen, at = np.unique(np.concatenate([counts[0], bucket]), return_inverse=True)
            counts = seen, np.bincount(at, np.concatenate([counts[1], np.ones(len(bucket))]))
        out[i] = mixture(model.p[counts[0]], counts[1], model.prior)
    return out


def predicted(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred, its score (the language's proportion), and languages and shares of the whole mixture."""
    docs = docs.drop(*ADDED)
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    asked = docs.withColumn("__letters", letters)
    at, ok = docs.columns.index("text"), len(docs.columns)
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("languages", T.ArrayType(T.StringType())), T.StructField("shares", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = np.flatnonzero(batch.column(ok).to_numpy(zero_copy_only=False)) if model.names else np.zeros(0, np.int64)
            pred, score, names, shares = [UNKNOWN] * len(batch), np.zeros(len(batch)), [[] for _ in range(len(batch))], [[] for _ in range(len(batch))]
            if len(some):
                for i, (own, share) in zip(some, mixtures(batch.column(at).take(pa.array(some)), model)):
                    by = np.lexsort((own, -share))
                    names[i], shares[i] = [model.names[own[j]] for j in by], share[by].tolist()
                    pred[i], score[i] = names[i][0], min(1.0, share[by[0]])
            added = [pa.array(pred, pa.string()), pa.array(score), pa.array(names, pa.list_(pa.string())), pa.array(shares, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:ok], *added], names=schema.names)

    return arrow.over(asked, run, schema)


def identified(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, languages: learned from texts with a lang whose crc32(doc_id) mod 4 isn't 2."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    train = docs.filter(~held & F.col("doc_id").isNotNull())
    asked = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held.alias("held_out"), "text")
    return predicted(asked, learned(train)).select("doc_id", "held_out", "lang_pred", "score", "languages")
