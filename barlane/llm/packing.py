"""Packing documents into sequences of at most WINDOW tokens by non-negative least squares over length combinations.

Each document's ids, with the end id, are cut into whole windows and a tail. The histogram of tail lengths (at most
WINDOW - 1 numbers) goes to the driver, which lists all pairs and triples of lengths that fill a window, finds repeat
counts by non-negative least squares, rounds them down so that no length is used more often than it occurs, and packs
what is left one after another, cutting at window ends. Tails get their places from their rank among tails of equal
length, so no task sees more than one bucket of documents.

Defined results: a null text is empty, so only the end id remains; repeated rows and repeated or null doc_ids are packed
each as rows of their own; an empty table gives no pieces; other columns are ignored.
"""
from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from . import arrow, words
from .bpe import byte_map
from .memo import Memo
from .store import written

WINDOW = 1024
#: Tokens that one bucket of documents holds about.
BUCKET_TOKENS = 4_000_000
_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


class Ids:
    """Ids that the tokenizer of a file gives without adding special tokens; made once in each worker.

    Added tokens that stand in a text get their ids, as the library's default is; with `ordinary`, special ones are
    plain text.
    """

    _made: dict[tuple[str, bool], Ids] = {}

    @classmethod
    def of(cls, path: str, ordinary: bool) -> Ids:
        if (path, ordinary) not in cls._made:
            cls._made[path, ordinary] = cls(path, ordinary)
        return cls._made[path, ordinary]

    def __init__(self, path: str, ordinary: bool = False):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = ordinary
        self.marks = [t["content"] for t in spec.get("added_tokens") or [] if not (ordinary and t["special"])]
        self.memo = None
        if _plain(spec):
            back = {c: b for b, c in enumerate(byte_map())}
            ranks = {bytes(back[c] for c in t): i for t, i in spec["model"]["vocab"].items()}
            one = tiktoken.Encoding("own", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
            self.memo = Memo(lambda texts: list(map(one, texts)))

    def _whole(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text by the library, a block of texts at a time."""
        out = []
        for lo, hi, _, _ in words.blocks(texts):
            out += [np.array(e.ids, np.uint32) for e in self.library.encode_batch_fast(texts.slice(lo, hi - lo).fill_null("").to_pylist(), add_special_tokens=False)]
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All rows' ids one after another, and the offsets of the rows in them."""
        marked = np.zeros(len(texts), bool)
        for m in self.marks if self.memo else ():
            marked |= pc.match_substring(texts, m).fill_null(False).to_numpy(zero_copy_only=False)
        if self.memo and not marked.any():
            return self.memo.encode(texts)
        parts: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(texts)
        if self.memo:
            flat, off = self.memo.encode(pc.if_else(pa.array(marked), pa.scalar("", texts.type), texts))
            parts = np.split(flat, off[1:-1])
            own = np.flatnonzero(marked)
        else:
            own = np.arange(len(texts))
        for i, ids in zip(own, self._whole(texts.take(pa.array(own)))):
            parts[i] = ids
        return np.concatenate([np.zeros(0, np.uint32), *parts]), np.cumsum([0, *map(len, parts)])


def _plain(spec: dict) -> bool:
    """Whether a tokenizer file is byte-level BPE whose merge order is its id order, cut by _PATTERN and by nothing else."""
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    if spec.get("normalizer") or spec.get("truncation") or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
        return False
    odd = ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")
    if model.get("type", "BPE") != "BPE" or any(model.get(k) for k in odd):
        return False
    vocab, merges = model["vocab"], [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    return len(vocab) == 256 + len(merges) and all(vocab.get(c, 256) < 256 for c in byte_map()) and all(vocab.get(a + b) == 256 + i for i, (a, b) in enumerate(merges))


def combinations(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (n, 2) and triples (n, 3), each ascending, of the given lengths that sum to window."""
    there = np.zeros(window + 1, bool)
    there[lengths] = True
    low = lengths[2 * lengths <= window]
    pairs = np.stack([low, window - low], 1)
    a, b = np.meshgrid(lengths[3 * lengths <= window], lengths, indexing="ij")
    c = window - a - b
    ok = (a <= b) & (b <= c)
    ok[ok] &= there[c[ok]]
    return pairs[there[pairs[:, 1]]], np.stack([a[ok], b[ok], c[ok]], 1)


def repeats(hist: np.ndarray, window: int = WINDOW, steps: int = 300) -> list[tuple[tuple[int, ...], int]]:
    """Combinations and how often each is used; hist[n]: tails of length n. No length is used beyond its count."""
    lengths = np.flatnonzero(hist[:window])
    lengths = lengths[lengths > 0]
    groups = [g for g in combinations(lengths, window) if len(g)]
    if not groups:
        return []
    scale = float(hist.max())
    want = hist[: window + 1] / scale

    def used(x: list[np.ndarray]) -> np.ndarray:
        return sum(np.bincount(g.ravel(), np.repeat(v, g.shape[1]), window + 1) for g, v in zip(groups, x))

    def back(r: np.ndarray) -> list[np.ndarray]:
        return [r[g].sum(1) for g in groups]

    v = [np.ones(len(g)) for g in groups]
    for _ in range(12):  # the largest eigenvalue bounds the step
        v = back(used(v))
        norm = np.sqrt(sum(float(x @ x) for x in v))
        v = [x / norm for x in v]
    step = 1 / (1.05 * norm)
    x = [np.zeros(len(g)) for g in groups]
    y, t = x, 1.0
    for _ in range(steps):
        grad = back(used(y) - want)
        new = [np.maximum(a - step * b, 0) for a, b in zip(y, grad)]
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = [a + (t - 1) / t_new * (a - b) for a, b in zip(new, x)]
        x, t = new, t_new
    left = hist[: window + 1].astype(np.int64).copy()
    out = []
    for most in (True, False):  # rounded down first, then what the rest still allows
        rated = sorted(((float(c), tuple(map(int, row))) for g, v in zip(groups, x) for c, row in zip(v * scale, g) if c > 1e-3), key=lambda p: (-p[0], p[1]))
        for c, row in rated:
            need = {n: row.count(n) for n in row}
            n = min(left[k] // m for k, m in need.items())
            n = int(min(n, c) if most else n)
            if n:
                out.append((row, n))
                for k, m in need.items():
                    left[k] -= n * m
    return out


class Plan:
    """Where the r-th tail of each length goes."""

    def __init__(self, hist: np.ndarray, window: int = WINDOW):
        self.window = window
        slots: list[list[tuple[int, int, int, int]]] = [[] for _ in range(window + 1)]  # by length: first rank, count, sequence, offset
        taken, at = np.zeros(window + 1, np.int64), 0
        for row, n in repeats(hist, window):
            offset = 0
            for k in row:
                slots[k].append((int(taken[k]), n, at, offset))
                taken[k] += n
                offset += k
            at += n
        self.slots = [np.array(s, np.int64).reshape(-1, 4) for s in slots]
        self.taken, self.rest = taken, at
        left = np.maximum(hist[: window + 1] - taken, 0) * np.arange(window + 1)
        self.stream = np.cumsum(left[::-1])[::-1] - left  # the longest first
        self.sequences = at + -(-int(left.sum()) // window)

    def places(self, length: int, rank: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Pieces of tails of one length by rank: (which of them, start in the tail, length, sequence, offset)."""
        out = []
        s, planned = self.slots[length], np.flatnonzero(rank < self.taken[length])
        if len(planned):
            r = rank[planned]
            k = np.searchsorted(s[:, 0], r, "right") - 1
            out.append((planned, np.zeros(len(r), np.int64), np.full(len(r), length), s[k, 2] + r - s[k, 0], s[k, 3]))
        own = np.flatnonzero(rank >= self.taken[length])
        if len(own):
            at = self.stream[length] + (rank[own] - self.taken[length]) * length
            fits = np.minimum(length, self.window - at % self.window)
            out.append((own, np.zeros(len(own), np.int64), fits, self.rest + at // self.window, at % self.window))
            cut = np.flatnonzero(fits < length)
            out.append((own[cut], fits[cut], length - fits[cut], self.rest + at[cut] // self.window + 1, np.zeros(len(cut), np.int64)))
        return out


def _tokenized(docs: DataFrame, path: str, end_id: int, ordinary: bool) -> DataFrame:
    """uid, doc_id, n and the little-endian 32-bit ids of each document, packed to 16 bits where all fit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Ids.of(path, ordinary)
        for batch in batches:
            flat, off = codec.encode(batch.column(2))
            narrow = not len(flat) or flat.max() < 1 << 16
            kind = np.uint16 if narrow and end_id < 1 << 16 else np.uint32
            end = np.array([end_id], kind).tobytes()
            flat = flat.astype(kind)
            ids = [flat[a:b].tobytes() + end for a, b in zip(off[:-1], off[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(np.diff(off) + 1, pa.int64()), pa.array(ids, pa.binary())], names=["uid", "doc_id", "n", "ids"]
            )

    numbered = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text"))
    return arrow.over(numbered, run, "uid bigint, doc_id bigint, n bigint, ids binary")


def pack(docs: DataFrame, path: str, end_id: int = 0, window: int = WINDOW, ordinary: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Planned sequences are numbered from 0; whole windows have numbers after them, by bucket.
    """
    ids = written(_tokenized(docs, path, end_id, ordinary), "packing-ids")
    total = ids.agg(F.sum("n")).first()[0] or 0
    buckets = max(1, -(-total // BUCKET_TOKENS))
    ids = ids.withColumn("bucket", F.pmod(F.xxhash64("uid"), F.lit(buckets)))
    tail = F.pmod(F.col("n"), F.lit(window)).alias("tail")
    counts = ids.groupBy("bucket", tail).agg(F.count("*").alias("c"), F.sum(F.floor(F.col("n") / window)).alias("full"))
    hist = np.zeros(window + 1, np.int64)
    for row in counts.groupBy("tail").agg(F.sum("c").alias("c")).collect():  # at most `window` rows
        hist[row.tail] = row.c if row.tail else 0
    stride = counts.groupBy("bucket").agg(F.sum("full").alias("f")).agg(F.max("f")).first()[0] or 0
    plan = Plan(hist, window)
    before = Window.partitionBy("tail").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("bucket", "tail", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("base"))

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.sort_by("uid")
        n = left["n"].to_numpy()
        raw = left["ids"].to_pylist()
        tails, full = n % window, n // window
        base = dict(zip(right["tail"].to_pylist(), right["base"].to_pylist()))
        which = np.repeat(np.arange(len(n)), full)
        k = np.arange(len(which)) - np.repeat(np.cumsum(full) - full, full)
        first = plan.sequences + key[0].as_py() * stride + np.arange(len(which))
        parts = [(which, k * window, np.full(len(which), window), first, np.zeros(len(which), np.int64))]
        for length in np.unique(tails[tails > 0]):
            own = np.flatnonzero(tails == length)
            for some, start, size, sequence, offset in plan.places(int(length), base[int(length)] + np.arange(len(own))):
                parts.append((own[some], full[own[some]] * window + start, size, sequence, offset))
        which, start, size, sequence, offset = (np.concatenate(x) for x in zip(*parts))
        crc = [zlib.crc32(np.frombuffer(raw[i], np.uint16 if len(raw[i]) == 2 * n[i] else np.uint32)[a : a + s].astype("<u4").tobytes()) for i, a, s in zip(which, start, size)]
        return pa.table(
            [left["doc_id"].take(pa.array(which)), start, size, pa.array(crc, pa.int64()), n[which], sequence, offset],
            names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
        )

    return arrow.over_pairs(ids, "bucket", bases, "bucket", run, _PIECES)
