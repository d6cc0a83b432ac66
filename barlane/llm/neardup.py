"""Near-duplicate documents: BagMinHash over word shingles, banding, and exact multiset overlap.

A text's elements are its runs of five words with their counts; two texts are linked if sum(min) / sum(max) of the counts
is at least THRESHOLD. Equal word sequences form one class, which is represented by its smallest doc_id. Signatures of M
registers are cut into bands of ROWS; classes that share a band may be linked.

Each band's members are checked against its smallest one first. Where members of a band are in different components after
that, they are compared with one another by their signatures, in pairs of bounded blocks and only in the first band that
two share: first each member outside the bucket's main component with the few most alike of other components, then all
whose signatures agree in at least SURE of the registers. A pair at the threshold agrees in fewer with a probability of
1e-6. So links between different texts are found, but links within a component that is known already aren't listed.

Of those, texts are fetched only for pairs that their cells leave open: a text's shingles are counted in CELLS cells by
hash, and the cells of two texts never differ by more than their multisets do. Where they differ by more than a pair at
the threshold may, the pair is no link, for certain; so a group of texts just below the threshold costs no joined rows.

Defined results: texts of fewer than five words (null: none) have no elements and are linked with nothing, not even
equal ones; rows with a null doc_id likewise; repeated rows have the same class and are kept or not together; rows of one
doc_id with different texts are texts of their own, each with its own class; an empty table stays empty; other columns
are ignored by `classes` and carried along by `deduplicated`.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrow, words
from .bagminhash import bags, bands, shingles, signatures
from .graphs import block_pairs, components, spread
from .store import discard, written

SHINGLE, THRESHOLD, M, ROWS, SURE, FEW = 5, 0.8, 100, 5, 0.60, 3
CELLS = 512
_U = np.uint64
_OTHER = _U(0x5851F42D4C957F2D)


def _signed(docs: DataFrame) -> DataFrame:
    """doc_id, a hash of the text, 128 bits of the words, the number of shingles, band keys and two bytes of each register.

    A row that is linked with nothing has nulls after the first two.
    """
    kind = "doc_id bigint, t bigint, x bigint, y bigint, n bigint, keys array<bigint>, sig binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, off in words.blocks(batch.column(1)):
                n = hi - lo
                h, row, g, grow = shingles(data, off, SHINGLE)
                size = np.bincount(row, minlength=n)
                place = np.arange(len(h)) - np.repeat(np.cumsum(size) - size, size)
                weight = words.mix(place.astype(_U) + _OTHER)
                x, y = (words.mix(_summed(words.mix(v ^ weight), size) + size.astype(_U)) for v in (h, words.mix(h + _OTHER)))
                total = np.bincount(grow, minlength=n)
                there = (total > 0) & batch.column(0).slice(lo, n).is_valid().to_numpy(zero_copy_only=False)
                own, rest = np.flatnonzero(there), np.flatnonzero(~there)
                if len(rest):
                    names = ["doc_id", "t", "x", "y", "n", "keys", "sig"]
                    kinds = [pa.int64()] * 3 + [pa.list_(pa.int64()), pa.binary()]
                    yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(lo, n).take(pa.array(rest)) for c in (0, 2)), *(pa.nulls(len(rest), k) for k in kinds)], names=names)
                if not len(own):
                    continue
                _, one, back = np.unique(np.stack([x[own], y[own]]), axis=1, return_index=True, return_inverse=True)
                at = np.full(n, -1)
                at[own[one]] = np.arange(len(one))
                keep = at[grow] >= 0
                sig = signatures(*bags(g[keep], at[grow[keep]]), len(one), M)
                key = bands(sig, ROWS)
                byte = (words.mix(sig.view(_U)) & _U(0xFFFF)).astype("<u2")
                back = back.ravel()
                off32 = pa.array(np.arange(len(own) + 1, dtype=np.int32) * key.shape[1])
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(c).slice(lo, n).take(pa.array(own)) for c in (0, 2)), *(pa.array(v[own].view(np.int64)) for v in (x, y)), pa.array(total[own]),
                        pa.ListArray.from_arrays(off32, pa.array(key[back].ravel().view(np.int64))), pa.array([r.tobytes() for r in byte[back]], pa.binary()),
                    ],
                    names=["doc_id", "t", "x", "y", "n", "keys", "sig"],
                )

    return arrow.over(_named(docs), run, kind)


def _named(docs: DataFrame) -> DataFrame:
    """doc_id, text and t, a hash of the text; both name a text."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.xxhash64("text").alias("t"))


def _summed(v: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of v of the given sizes, modulo 2 ** 64."""
    total = np.concatenate([np.zeros(1, _U), np.cumsum(v, dtype=_U)])
    ends = np.cumsum(size)
    return total[ends] - total[ends - size]


def _linked(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Those of pairs (a, b) whose texts' multisets overlap enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(0), batch.column(1)
            ok = np.zeros(len(batch), bool)
            step = 1000
            for lo in range(0, len(batch), step):
                n = min(step, len(batch) - lo)
                both = pa.concat_arrays([batch.column(2).slice(lo, n), batch.column(3).slice(lo, n)])
                sides = []
                for first, last, data, off in words.blocks(both):
                    _, _, g, grow = shingles(data, off, SHINGLE)
                    r, e, c = bags(g, grow)
                    cut = np.searchsorted(r, np.arange(last - first + 1))
                    sides += [(e[i:j], c[i:j]) for i, j in zip(cut[:-1], cut[1:])]
                for i in range(n):
                    (e, c), (f, d) = sides[i], sides[n + i]
                    _, p, q = np.intersect1d(e, f, True, True)
                    least = int(np.minimum(c[p], d[q]).sum())
                    ok[lo + i] = least >= threshold * (int(c.sum()) + int(d.sum()) - least) and least > 0
            yield pa.RecordBatch.from_arrays([a.filter(pa.array(ok)), b.filter(pa.array(ok))], names=["a", "b"])

    left, right = (texts.select(F.col("id").alias(k), F.col("text").alias(f"{k}_text")) for k in ("a", "b"))
    return arrow.over(pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "a_text", "b_text"), run, "a bigint, b bigint")


def _celled(texts: DataFrame) -> DataFrame:
    """texts (id, text) with n, the number of shingles, and cells, a byte for each of CELLS counts (255: that or more)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, off in words.blocks(batch.column(1)):
                _, _, g, grow = shingles(data, off, SHINGLE)
                cell = (words.mix(g ^ _OTHER) % _U(CELLS)).astype(np.int64)
                for first in range(0, hi - lo, 2000):
                    last = min(first + 2000, hi - lo)
                    i, j = np.searchsorted(grow, [first, last])
                    count = np.bincount((grow[i:j] - first) * CELLS + cell[i:j], minlength=(last - first) * CELLS).reshape(-1, CELLS)
                    part = batch.slice(lo + first, last - first)
                    cells = pa.array([c.tobytes() for c in np.minimum(count, 255).astype(np.uint8)], pa.binary())
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(count.sum(1)), cells], names=["id", "text", "n", "cells"])

    return arrow.over(texts.select("id", "text"), run, "id bigint, text string, n bigint, cells binary")


def classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id (the smallest doc_id reachable by links) and kept (doc_id = class_id), a row per row of docs."""
    return _classes(docs, threshold).drop("t")


def _classes(docs: DataFrame, threshold: float) -> DataFrame:
    signed = written(_signed(docs), "bagminhash")
    one = signed.filter("x IS NOT NULL").groupBy("x", "y").agg(F.min(F.struct("doc_id", "t")).alias("first"), F.first("n").alias("n"), F.first("keys").alias("keys"), F.first("sig").alias("sig"))
    # Numbers of texts hold once they are written. A doc_id may have several texts, so it can't stand for one.
    one = written(one.select(F.monotonically_increasing_id().alias("id"), "x", "y", "first.doc_id", "first.t", "n", "keys", "sig"), "distinct-texts")
    member = one.select("id", F.posexplode("keys").alias("band", "bucket"))
    star = member.groupBy("bucket").agg(F.min("id").alias("a"), F.max("id").alias("z")).filter("a <> z").select("bucket", "a")
    shared = written(spread(member, star, "bucket", "id"), "bands")
    first = shared.filter("a <> id").select("a", F.col("id").alias("b")).distinct()
    size = one.select("id", "n")
    for k in ("a", "b"):
        first = first.join(size.select(F.col("id").alias(k), F.col("n").alias(f"n{k}")), k)
    least = F.least("na", "nb") >= threshold * F.greatest("na", "nb")
    first = first.filter(least).select("a", "b")
    wanted = one.select("id", "doc_id", "t").join(shared.select("id").distinct(), "id")
    texts = _named(docs).join(wanted, ["doc_id", "t"]).select("id", "text").dropDuplicates(["id"])
    texts = written(_celled(texts), "candidate-texts")
    links = written(_linked(first, texts, threshold), "text-links")
    found = components(links)
    base, sketch = shared.select("id", "bucket", "band"), one.select("id", "sig").join(texts.select("id", "n", "cells"), "id")
    for few in (FEW, None):
        tagged = base.join(found, base.id == found.node, "left").select("id", "bucket", "band", F.coalesce("component", "id").alias("tag"))
        open_ = tagged.groupBy("bucket").agg(F.min("tag").alias("low"), F.max("tag").alias("high")).filter("low <> high").select("bucket")
        opened = written(spread(tagged, open_, "bucket", "id"), "open-bands")
        tagged = opened.join(sketch, "id")
        pairs = block_pairs(tagged, _across(threshold, few), "a bigint, b bigint", ["a", "b"], "low <> high").distinct()
        before, links = links, written(links.unionAll(_linked(pairs, texts, threshold)), "text-links")
        discard(before, opened, found)
        found = components(links)
    discard(links, shared, texts)
    linked = one.select("id", "doc_id").join(found, one.id == found.node).select("id", "doc_id", "component")
    low = linked.groupBy("component").agg(F.min("doc_id").alias("class_id"))
    linked = spread(linked.drop("doc_id"), low, "component", "id").select("id", "class_id")
    named = one.join(linked, "id", "left").select("x", "y", F.coalesce("class_id", "doc_id").alias("class_id"))
    rows = signed.select("doc_id", "t", "x", "y").join(named, ["x", "y"], "left").select("doc_id", "t", F.coalesce("class_id", "doc_id").alias("class_id"))
    return rows.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)))


def _across(threshold: float, few: int | None):
    """Pairs of different components whose signatures agree enough and whose cells leave a link open; with few, only each
    member's most alike ones."""
    most = (1 - threshold) / (1 + threshold) * (1 + 1e-9)

    def pairs(table: pa.Table, todo: list[tuple[np.ndarray, np.ndarray, bool]]) -> list[pa.Array]:
        ids, n, tag, band = (table[c].to_numpy() for c in ("id", "n", "tag", "band"))
        sig = np.frombuffer(b"".join(table["sig"].to_pylist()), "<u2").reshape(-1, M)
        cells = np.frombuffer(b"".join(table["cells"].to_pylist()), np.uint8).reshape(-1, CELLS)
        out = [np.zeros((2, 0), np.int64)]
        for a, b, same in todo:
            if tag[a].min() == tag[b].max() and tag[a].max() == tag[b].min():
                continue
            ok = (tag[a][:, None] != tag[b]) & (np.minimum(n[a][:, None], n[b]) >= threshold * np.maximum(n[a][:, None], n[b]))
            i, j = np.nonzero(np.triu(ok, 1) if same else ok)
            i, j = a[i], b[j]
            agree = np.zeros(len(i), np.int64)
            for lo in range(0, len(i), 20_000):
                part = slice(lo, lo + 20_000)
                equal = sig[i[part]] == sig[j[part]]
                first = equal.reshape(-1, M // ROWS, ROWS).all(2).argmax(1)
                agree[part] = np.where(first == band[a[0]], equal.sum(1), 0)
            sure = agree >= SURE * M
            i, j, agree = i[sure], j[sure], agree[sure]
            maybe = np.ones(len(i), bool)
            for lo in range(0, len(i), 5000):
                p, q = i[lo : lo + 5000], j[lo : lo + 5000]
                apart = np.maximum(cells[p], cells[q]) - np.minimum(cells[p], cells[q])
                maybe[lo : lo + 5000] = apart.sum(1, dtype=np.int64) <= most * (n[p] + n[q])
            i, j, agree = i[maybe], j[maybe], agree[maybe]
            if few is not None and len(i):
                value, times = np.unique(tag[np.concatenate([a, b])], return_counts=True)
                main = value[times.argmax()]
                by = np.argsort(-agree, kind="stable")
                i, j = i[by], j[by]
                keep = (_nth(ids[i]) < few) & (tag[i] != main) | (_nth(ids[j]) < few) & (tag[j] != main)
                i, j = i[keep], j[keep]
            out.append(np.sort(np.stack([ids[i], ids[j]]), 0))
        return [pa.array(v) for v in np.concatenate(out, 1)]

    return pairs


def _nth(x: np.ndarray) -> np.ndarray:
    """How often each entry's value came before it."""
    by = np.argsort(x, kind="stable")
    new = np.ones(len(x), bool)
    new[1:] = x[by[1:]] != x[by[:-1]]
    first = np.flatnonzero(new)
    out = np.empty(len(x), np.int64)
    out[by] = np.arange(len(x)) - np.repeat(first, np.diff(np.append(first, len(x))))
    return out


def deduplicated(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that are kept: of each class those with its smallest doc_id."""
    gone = _classes(docs, threshold).filter("NOT kept").select("doc_id", F.col("t").alias("__t")).distinct()
    return docs.withColumn("__t", F.xxhash64("text")).join(gone, ["doc_id", "__t"], "left_anti").select(docs.columns)
