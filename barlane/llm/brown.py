"""A Brown class-based bigram model: exchange clustering of words, class transitions and word emissions.

Words are lower-cased (A-Z) and hashed to 64 bits. Every training token counts. Classes are seeded on the driver: the HEAD
most frequent words one by one and all others by their shape (length and last two bytes, SHAPES groups) are exchanged
between classes as long as the likelihood of class bigrams grows. Then every other word that occurs LEAST times or more
is exchanged by its own counts of the classes before and after it, in Spark; only rarer and unseen words keep the class of
their shape. P(token) = P(class | class before) * P(word | class); a class keeps back a share for unseen words by its words
that occur once. An end token closes each text and stands before its first word.

Rows that outgrow one machine stay distributed: counts of words by class and the classes of words are tables, and each
chunk of documents gets the counts and classes of its own distinct words by a join. The driver sees HEAD words, counts of
item pairs and counts of class pairs, all bounded.

Defined results: a null text is empty (the end token only); a null doc_id counts as the text `null`; repeated rows are
scored, and learned from, each; without training rows all counts are 0; other columns are ignored.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrow, words
from .chunks import chunked
from .store import discard, written

HEAD, SHAPES, CLASSES, ROUNDS = 500, 220, 40, 8
LEAST = 3
CHUNK_BYTES = 16 << 20
BUCKET_WORDS = 20_000
BLOCK_TOKENS = 1_000_000
_U = np.uint64
_COLUMNS = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def _tokens(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, row after the last, word hashes, rows counted from the first, shapes) by blocks."""
    for lo, hi, data, off in words.blocks(texts, lower=True):
        start, end, row = words.spans(data, off)
        size = end - start
        last = data[end - 1].astype(_U) if len(end) else np.zeros(0, _U)
        second = np.where(size > 1, data[np.maximum(end - 2, 0)], 0).astype(_U) if len(end) else last
        shape = words.mix(last | second << _U(8) | np.minimum(size, 12).astype(_U) << _U(16)) % _U(SHAPES)
        yield lo, hi, words.hashes(data, start, end), row, shape.astype(np.int64)


def word_counts(train: DataFrame) -> DataFrame:
    """w (hash), n, shape of each distinct word in text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def merged() -> pa.RecordBatch:
            w, n, s = (np.concatenate(x) for x in zip(*parts))
            parts.clear()
            u, some, inverse = np.unique(w, return_index=True, return_inverse=True)
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(np.bincount(inverse, n, len(u)).astype(np.int64)), pa.array(s[some])], names=["w", "n", "shape"])

        for batch in batches:
            for _, _, h, _, shape in _tokens(batch.column(0)):
                u, some, n = np.unique(h, return_index=True, return_counts=True)
                parts.append((u, n, shape[some]))
                if sum(len(p[0]) for p in parts) > 1_000_000:
                    yield merged()
        if parts:
            yield merged()

    return arrow.over(train.select("text"), run, "w bigint, n bigint, shape bigint").groupBy("w").agg(F.sum("n").alias("n"), F.min("shape").alias("shape"))


@dataclass
class Items:
    """Words with an item of their own, by hash; items after them are shapes, the last one is the end token."""

    head: np.ndarray

    @property
    def number(self) -> int:
        return len(self.head) + SHAPES + 1

    def of(self, h: np.ndarray, shape: np.ndarray) -> np.ndarray:
        if not len(self.head):
            return shape
        at = np.minimum(np.searchsorted(self.head, h), len(self.head) - 1)
        return np.where(self.head[at] == h, at, len(self.head) + shape)


def _with_ends(item: np.ndarray, row: np.ndarray, rows: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Items with the end item after each row's last, and the row of each."""
    n = np.bincount(row, minlength=rows) + 1
    stop = np.cumsum(n) - 1
    out = np.full(len(item) + rows, end)
    keep = np.ones(len(out), bool)
    keep[stop] = False
    out[keep] = item
    return out, np.repeat(np.arange(rows), n)


def pair_counts(train: DataFrame, items: Items) -> np.ndarray:
    """How often item j follows item i; before a text's first word stands the end item."""
    m = items.number

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(m * m, np.int64)
        for batch in batches:
            for lo, hi, h, row, shape in _tokens(batch.column(0)):
                item, _ = _with_ends(items.of(h, shape), row, hi - lo, m - 1)
                total += np.bincount(np.concatenate([[m - 1], item[:-1]]) * m + item, minlength=m * m)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["pair", "n"])

    got = arrow.over(train.select("text"), run, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()  # at most m * m rows
    out = np.zeros(m * m)
    out[got["pair"].to_numpy()] = got["n"].to_numpy()
    return out.reshape(m, m)


def _h(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange(pairs: np.ndarray, classes: int = CLASSES, rounds: int = ROUNDS) -> np.ndarray:
    """The class of each item; the last item keeps a class of its own (the last one).

    Items start dealt out by frequency. Each is taken out of its class and put where the sum of n log n over class pairs,
    less twice that over classes, is largest; ties go to the smallest class.
    """
    m = len(pairs)
    total = pairs.sum(0)
    rank = np.argsort(np.argsort(-total[:-1], kind="stable"), kind="stable")
    of = np.append(rank % classes, classes)
    member = np.zeros((classes + 1, m))
    member[of, np.arange(m)] = 1
    both = member @ pairs @ member.T
    left, right = pairs @ member.T, member @ pairs  # item before class, class before item
    size = member @ total
    for _ in range(rounds):
        moved = 0
        for i in np.argsort(-total[:-1], kind="stable"):
            if not total[i]:
                continue
            a, own = of[i], pairs[i, i]
            out, into = left[i].copy(), right[:, i].copy()
            out[a] -= own
            into[a] -= own
            both[a] -= out
            both[:, a] -= into
            both[a, a] -= own
            size[a] -= total[i]
            rows = (_h(both + out) - _h(both)).sum(1)
            cols = (_h(both + into[:, None]) - _h(both)).sum(0)
            d = np.arange(classes + 1)
            same = both[d, d]
            corner = _h(same + out[d] + into[d] + own) - _h(same + out[d]) - _h(same + into[d]) + _h(same)
            gain = rows + cols + corner - 2 * (_h(size + total[i]) - _h(size))
            b = int(np.argmax(np.round(gain[:-1], 6)))
            both[b] += out
            both[:, b] += into
            both[b, b] += own
            size[b] += total[i]
            if a != b:
                of[i] = b
                left[:, a] -= pairs[:, i]
                left[:, b] += pairs[:, i]
                right[a] -= pairs[i]
                right[b] += pairs[i]
                moved += 1
        if not moved:
            break
    return of


@dataclass
class Seeds:
    """Items, their classes, and the counts of class pairs and classes."""

    items: Items
    of: np.ndarray
    both: np.ndarray
    size: np.ndarray

    @property
    def end(self) -> int:
        """The class of the end token, the last one."""
        return len(self.size) - 1


def seeded(train: DataFrame, counts: DataFrame, head: int = HEAD, classes: int = CLASSES) -> Seeds:
    top = counts.orderBy(F.desc("n"), "w").limit(head).select("w").toArrow()["w"].to_numpy()
    items = Items(np.sort(top.view(_U)))
    pairs = pair_counts(train, items)
    of = exchange(pairs, classes)
    member = np.zeros((classes + 1, items.number))
    member[of, np.arange(items.number)] = 1
    return Seeds(items, of, member @ pairs @ member.T, member @ pairs.sum(0))


def contexts(train: DataFrame, seeds: Seeds) -> DataFrame:
    """w, context, n of words outside the head: how often the class `context` came before w, or (from the number of classes on) after it."""
    k = seeds.end + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> pa.RecordBatch:
            h, context = (np.concatenate(x) for x in zip(*parts))
            parts.clear()
            w, at = np.unique(h, return_inverse=True)
            key, n = np.unique(at * (2 * k) + context, return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(w[key // (2 * k)].view(np.int64)), pa.array((key % (2 * k)).astype(np.int32)), pa.array(n.astype(np.int64))], names=["w", "context", "n"])

        for batch in batches:
            for lo, hi, h, row, shape in _tokens(batch.column(0)):
                end = seeds.items.number - 1
                item, _ = _with_ends(seeds.items.of(h, shape), row, hi - lo, end)
                of, word = seeds.of[item], item != end
                own = item[word] >= len(seeds.items.head)
                before, after = np.concatenate([[seeds.end], of[:-1]])[word][own], np.concatenate([of[1:], [seeds.end]])[word][own]
                parts += [(h[own], before), (h[own], after + k)]
                if sum(len(p[0]) for p in parts) > BLOCK_TOKENS:
                    yield merged()
        if parts:
            yield merged()

    return arrow.over(train.select("text"), run, "w bigint, context int, n bigint")


def best(word: np.ndarray, context: np.ndarray, n: np.ndarray, of: np.ndarray, total: np.ndarray, both: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The class of each word (an index into of, its class now, and total, its count) by its counts n of contexts.

    It is the class where the sum of n log n over class pairs, less twice that over classes, is largest when the word is
    taken out of its own class and all other words stay; a word's pairs with words of its own class count as they are.
    """
    k = len(size)
    key, at = np.unique(word * (2 * k) + context, return_inverse=True)
    n, word, context = np.bincount(at, n, len(key)), key // (2 * k), key % (2 * k)
    table = np.concatenate([both, both.T])  # context, class of the word
    every = np.arange(len(of))
    gain = -2 * (_h(size + total[:, None]) - _h(size))
    gain[every, of] = -2 * (_h(size[of]) - _h(size[of] - total))
    for lo in range(0, len(key), 1 << 16):
        w, c, m = word[lo : lo + (1 << 16)], context[lo : lo + (1 << 16)], n[lo : lo + (1 << 16)]
        more = _h(table[c] + m[:, None]) - _h(table[c])
        now = table[c, of[w]]
        more[np.arange(len(w)), of[w]] = _h(now) - _h(now - m)
        first = np.flatnonzero(np.append(True, w[1:] != w[:-1]))
        gain[w[first]] += np.add.reduceat(more, first)
    return np.argmax(np.round(gain[:, :-1], 6), axis=1)


def word_classes(train: DataFrame, counts: DataFrame, seeds: Seeds, least: int = LEAST) -> DataFrame:
    """w, n, class of each word."""
    buckets = F.pmod("w", F.lit(max(1, -(-counts.count() // BUCKET_WORDS)))).alias("bucket")

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        w, total = right["w"].to_numpy().view(_U), right["n"].to_numpy()
        item = seeds.items.of(w, right["shape"].to_numpy())
        of = seeds.of[item]
        some = np.flatnonzero((total >= least) & (item >= len(seeds.items.head)))
        some = some[np.argsort(w[some])]
        if len(some):
            h = left["w"].to_numpy().view(_U)
            at = np.minimum(np.searchsorted(w[some], h), len(some) - 1)
            own = w[some][at] == h
            of[some] = best(at[own], left["context"].to_numpy()[own], left["n"].to_numpy()[own], of[some], total[some], seeds.both, seeds.size)
        return pa.table([right["w"], right["n"], pa.array(of.astype(np.int32))], names=["w", "n", "class"])

    # Added up by word and context first: a bucket then has so many rows of a word at most, however many tasks saw it.
    seen = contexts(train, seeds).groupBy("w", "context").agg(F.sum("n").alias("n"))
    left, right = seen.select(buckets, "*"), counts.select(buckets, "*")
    return arrow.over_pairs(left, "bucket", right, "bucket", run, "w bigint, n bigint, class int")


@dataclass
class Model:
    items: Items
    of: np.ndarray  # item -> class, for words without a class of their own
    size: np.ndarray  # tokens of each class
    unseen: np.ndarray  # P(a word that wasn't seen | class)
    tokens: int
    types: int
    ends: int


def fit(seeds: Seeds, classes: DataFrame) -> Model:
    """The model of word_classes, but for the steps between classes."""
    size, once, types = np.zeros(seeds.end + 1), np.zeros(seeds.end + 1), 0
    for row in classes.groupBy("class").agg(F.sum("n").alias("n"), F.count("*").alias("v"), F.sum((F.col("n") == 1).cast("int")).alias("once")).collect():
        size[row["class"]], once[row["class"]] = row.n, row.once
        types += row.v
    ends = int(seeds.size[-1])
    size[-1] = ends
    return Model(seeds.items, seeds.of, size, (once + 1) / (size + once + 2), int(size.sum()), types + (ends > 0), ends)


def steps(passed: DataFrame, size: np.ndarray) -> np.ndarray:
    """log10 P(class | class before), from the steps of the rows that are learned from."""
    k = len(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k * k, np.int64)
        for batch in batches:
            for x in batch.column(0):
                total += np.bincount(np.frombuffer(x.as_buffer(), np.uint16), minlength=k * k)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["pair", "n"])

    got = arrow.over(passed.filter("NOT held_out").select("steps"), run, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()  # at most k * k rows
    both = np.zeros(k * k)
    both[got["pair"].to_numpy()] = got["n"].to_numpy()
    both = both.reshape(k, k)
    share = (size + 0.5) / (size + 0.5).sum()
    return np.log10((both + 2 * share) / (both.sum(1, keepdims=True) + 2))


def score(docs: DataFrame, size: int = CHUNK_BYTES) -> DataFrame:
    """Each document's counts, base score and score; documents with crc32(doc_id) mod 7 = 2 aren't learned from."""
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))) % 7 == 2
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", held.alias("held_out"))
    train = docs.filter("NOT held_out").select("text")
    counts = written(word_counts(train), "brown-counts")
    seeds = seeded(train, counts)
    classes = written(word_classes(train, counts, seeds), "brown-classes")
    discard(counts)
    model = fit(seeds, classes)
    dealt = chunked(docs, size)

    def distinct(key: tuple, table: pa.Table) -> pa.Table:
        seen = [np.unique(h) for _, _, h, _, _ in _tokens(table["text"])]
        w = np.unique(np.concatenate(seen)) if seen else np.zeros(0, _U)
        return pa.table([pa.array(np.full(len(w), key[0].as_py())), pa.array(w.view(np.int64))], names=["chunk", "w"])

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        w = right["w"].to_numpy().view(_U)
        by = np.argsort(w)
        known, times, own = w[by], right["n"].to_numpy()[by], right["class"].to_numpy()[by]
        last, scale = len(model.size) - 1, np.log10(model.tokens + model.types + 1)
        parts, paths = [], []
        for lo, hi, h, row, shape in _tokens(left["text"]):
            at = np.minimum(np.searchsorted(known, h), max(len(known) - 1, 0))
            here = known[at] == h if len(known) else np.zeros(len(h), bool)
            n = np.where(here, times[at], 0) if len(known) else np.zeros(len(h), np.int64)
            of = model.of[model.items.of(h, shape)]
            of = np.where(here, own[at], of) if len(known) else of
            n, rows = _with_ends(n, row, hi - lo, model.ends)
            of, _ = _with_ends(of, row, hi - lo, last)
            before = np.concatenate([of[-1:], of[:-1]])  # a text's first word comes after an end
            word = np.where(n > 0, np.log10(np.maximum(n, 1) / np.maximum(model.size[of], 1)) + np.log10(1 - model.unseen[of]), np.log10(model.unseen[of]))
            total = lambda x: np.bincount(rows, x, hi - lo)  # noqa: E731, B023
            parts.append((total(None), total(n > 0), total(np.log10(n + 1.0) - scale), total(np.where(of == last, 0, word))))
            ends = np.append(0, np.cumsum(2 * parts[-1][0])).astype(np.int32)
            path = (before * (last + 1) + of).astype(np.uint16)
            paths.append(pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer(ends), pa.py_buffer(path)]))
        tokens, seen, base, p = (np.concatenate(x) for x in zip(*parts))
        return pa.table(
            [left["doc_id"], left["held_out"], tokens.astype(np.int64), seen.astype(np.int64), base, p, pa.chunked_array(paths)],
            names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "words", "steps"],
        )

    asked = arrow.over_groups(dealt, "chunk", distinct, "chunk bigint, w bigint").join(classes, "w")
    passed = written(
        arrow.over_pairs(dealt, "chunk", asked, "chunk", run, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, words double, steps binary"), "brown-steps"
    )
    step = steps(passed, model.size).reshape(-1)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = b["words"].to_numpy() + np.array([step[np.frombuffer(x.as_buffer(), np.uint16)].sum() for x in b["steps"]])
            trained = np.full(len(own), model.tokens)
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["held_out"], b["n_tokens"], b["n_known"], pa.array(trained), b["base_score"], pa.array(own)], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return arrow.over(passed, summed, _COLUMNS)
