"""Embedding near-duplicates by Euclidean p-stable hashing and exact cosine checks.

Normalised vectors are projected on Gaussian directions, shifted and cut into cells of WIDTH; a table's key is the cells of
k projections, and two vectors are compared where they share a key in any table. k and the number of tables follow from
the number of distinct vectors, so that unlike vectors share a key about once a table and a pair at the threshold is
found with probability RECALL. Equal vectors are compared once and counted as often as they occur. Keys shared by many
vectors are compared in pairs of bounded blocks; a pair counts only in the first table in which it meets.

Defined results: vectors that are null, zero, or hold null or non-finite components link with nothing, nor do vectors of
different lengths; an empty table stays empty; rows of one vec_id count as vectors of their own but have the same id;
rows with a null vec_id link with nothing and have no component; other columns are ignored.
"""
from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrow, words
from .graphs import block_pairs, components, roots
from .store import discard, written

THRESHOLD, WIDTH, RECALL = 0.95, 1.5, 0.99
_U = np.uint64


def _meet(distance: float, width: float) -> float:
    """The probability that one projection puts two points at a distance into one cell."""
    r = width / distance
    return math.erf(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def tables(n: int, threshold: float = THRESHOLD, width: float = WIDTH, recall: float = RECALL) -> tuple[int, int]:
    """Projections of a key, and number of keys, for n distinct vectors."""
    near, far = _meet(math.sqrt(2 - 2 * threshold), width), _meet(math.sqrt(2), width)
    k = max(4, math.ceil(math.log(max(n, 2)) / -math.log(far)))
    return k, math.ceil(math.log(1 - recall) / math.log(1 - near**k))


def keys(unit: np.ndarray, k: int, number: int, width: float = WIDTH) -> np.ndarray:
    """(rows, number) keys of normalised rows; directions depend on the number of components only."""
    rng = np.random.default_rng(unit.shape[1])
    out = np.zeros((len(unit), number), _U)
    for t in range(number):
        cell = np.floor((unit @ rng.standard_normal((unit.shape[1], k)) + rng.uniform(0, width, k)) / width).astype(np.int64).view(_U)
        key = np.full(len(unit), t, _U)
        for j in range(k):
            key = words.mix(key * _U(0x9E3779B97F4A7C15) + cell[:, j])
        out[:, t] = key
    return out


def _valid(embeddings: DataFrame) -> DataFrame:
    """vec_id, x, y (128 bits of the vector) and its components as little-endian doubles; invalid ones have nulls."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = []
            for v, known in zip(batch.column(1), batch.column(0).is_valid().to_pylist()):
                a = np.array(v.values.to_numpy(zero_copy_only=False), "<f8") if v.is_valid and known else np.zeros(0)
                raw.append(a.tobytes() if len(a) and np.isfinite(a).all() and a.any() else None)
            digest = [None if r is None else hashlib.blake2b(r, digest_size=16).digest() for r in raw]
            half = [pa.array([None if d is None else int.from_bytes(d[i : i + 8], "little", signed=True) for d in digest], pa.int64()) for i in (0, 8)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *half, pa.array(raw, pa.binary())], names=["vec_id", "x", "y", "v"])

    return arrow.over(embeddings.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e")), run, "vec_id bigint, x bigint, y bigint, v binary")


def _units(raw: list[bytes]) -> np.ndarray:
    a = np.frombuffer(b"".join(raw), "<f8").reshape(len(raw), -1)
    a = a / np.abs(a).max(1, keepdims=True)  # else squares of very large or small components leave the range
    return a / np.linalg.norm(a, axis=1, keepdims=True)


def links(embeddings: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per row of embeddings."""
    rows = written(_valid(embeddings), "vectors")
    one = rows.filter("v IS NOT NULL").groupBy("x", "y").agg(F.min("vec_id").alias("id"), F.count("*").alias("c"), F.first("v").alias("v"))
    one = written(one, "distinct-vectors")
    k, number = tables(one.count(), threshold)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(1).to_pylist()
            size = np.array([len(r) for r in raw])
            got = np.zeros((len(raw), number), _U)
            for n in np.unique(size):
                own = np.flatnonzero(size == n)
                got[own] = words.mix(keys(_units([raw[i] for i in own]), k, number) ^ _U(n))
            off = pa.array(np.arange(len(raw) + 1, dtype=np.int32) * number)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(off, pa.array(got.ravel().view(np.int64)))], names=["id", "keys"])

    keyed = written(arrow.over(one.select("id", "v"), hashed, "id bigint, keys array<bigint>"), "vector-keys")
    member = keyed.select("id", F.explode("keys").alias("bucket"))
    busy = member.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1").select("bucket")
    member = member.join(busy, "bucket").join(keyed, "id").join(one.select("id", "c", "v"), "id").withColumn("tag", F.lit(0))

    def pairs(table: pa.Table, todo: list[tuple[np.ndarray, np.ndarray, bool]]) -> list[pa.Array]:
        ids, c, bucket = (table[n].to_numpy() for n in ("id", "c", "bucket"))
        raw = table["v"].to_pylist()
        key = table["keys"].combine_chunks().flatten().to_numpy().reshape(-1, number)
        node, count, root = [], [], []
        for a, b, same in todo:
            if len(raw[a[0]]) != len(raw[b[0]]):
                continue
            ua = _units([raw[i] for i in a])
            near = (ua @ (ua if same else _units([raw[i] for i in b])).T) >= threshold
            i, j = np.nonzero(np.triu(near, 1) if same else near)
            if not len(i):
                continue
            i, j = a[i], b[j]
            table_no = int(np.flatnonzero(key[a[0]] == bucket[a[0]])[0])
            new = np.ones(len(i), bool)
            for lo in range(0, len(i), 1 << 16):
                part = slice(lo, lo + (1 << 16))
                new[part] = ~(key[i[part], :table_no] == key[j[part], :table_no]).any(1)
            i, j = i[new], j[new]
            all_, at = np.unique(np.concatenate([i, j]), return_inverse=True)
            x, y = at[: len(i)], at[len(i) :]
            by = np.argsort(ids[all_], kind="stable")
            place = np.empty(len(by), np.int64)
            place[by] = np.arange(len(by))
            node.append(ids[all_])
            count.append(np.bincount(x, c[j], len(all_)) + np.bincount(y, c[i], len(all_)))
            root.append(ids[all_[by[roots(place[x], place[y], len(by))[place]]]])
        cat = lambda v: pa.array(np.concatenate(v).astype(np.int64) if v else np.zeros(0, np.int64))
        return [cat(node), cat(count), cat(root)]

    found = written(block_pairs(member, pairs, "id bigint, n bigint, root bigint", ["id", "n", "root"]), "vector-links")
    discard(keyed)
    counts = found.groupBy("id").agg(F.sum("n").alias("n"))
    groups = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    named = one.select("x", "y", "id", "c").join(counts, "id", "left").join(groups, F.col("id") == F.col("node"), "left")
    named = named.select("x", "y", (F.col("c") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    valid = rows.filter("v IS NOT NULL").drop("v").join(named, ["x", "y"]).select("vec_id", "n_links", "component_id")
    alone = rows.filter("v IS NULL").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return valid.unionAll(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
