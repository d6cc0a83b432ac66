"""Substring deduplication on a compacted De Bruijn graph of word k-mers.

Each WINDOW of consecutive words is an edge between its two runs of WINDOW - 1 words. Neighbouring edges of a document
with the same minimizer (the smallest hash of the runs of SEED words in them) form a path. A join by minimizer keeps paths
that may occur in two documents; paths with a minimizer that has no other path don't branch and stay compact, all others
fall back into edges. Both get the smallest document that has them, their source, by key, and each chunk of documents
gets those facts for its own paths and edges. Words under an edge whose source is a smaller document are removed.

Paths and edges are told apart by two 64-bit hashes, of their minimizer and of all their words; both are made from 64-bit hashes
of words, and words themselves are not compared.

Texts are dealt into chunks by one exchange that all passes share. A path or edge has one row for each chunk, so a
passage that a third of all documents share is gathered as so many rows as there are chunks, not documents.

Defined results: null texts have no words; rows with a null doc_id are left alone and are no source; repeated rows are
treated each, rows of one doc_id aren't sources for one another; an empty table stays empty; extra columns are carried
along, those named like the added ones are replaced.
"""
from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import arrow, words
from .chunks import CHUNK_BYTES, chunked

WINDOW, SEED = 13, 5
ADDED = ("n_words", "n_removed", "kept_sha256")
_U = np.uint64


@dataclass
class Graph:
    """Paths of a block of documents: edge i starts at word at[i]; path p has edges first[p] to first[p + 1]."""

    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    h: np.ndarray
    at: np.ndarray
    minimizer: np.ndarray  # of each path
    first: np.ndarray
    size: np.ndarray
    doc: np.ndarray  # row of each path


def graph(data: np.ndarray, off: np.ndarray, window: int, seed: int) -> Graph:
    start, end, row = words.spans(data, off)
    h = words.hashes(data, start, end)
    at = np.flatnonzero(row[: max(len(h) - window + 1, 0)] == row[window - 1 :]) if len(h) >= window else np.zeros(0, np.int64)
    low = words.runs(h, seed)
    need, done = window - seed + 1, 1
    while done < need:  # low[i]: the smallest of `done` hashes from i on
        by = min(done, need - done)
        low = np.minimum(low[: len(low) - by], low[by:])
        done += by
    low = low[at] if len(at) else np.zeros(0, _U)
    new = np.ones(len(at), bool)
    new[1:] = (low[1:] != low[:-1]) | (row[at[1:]] != row[at[:-1]])
    first = np.flatnonzero(new)
    return Graph(start, end, row, h, at, low[first], first, np.diff(np.append(first, len(at))), row[at[first]] if len(at) else at)


def _edges(g: Graph, window: int) -> np.ndarray:
    return words.runs(g.h, window)[g.at]


def _paths(g: Graph, edge: np.ndarray) -> np.ndarray:
    """A hash of each path's edges in order."""
    if not len(g.first):
        return edge
    power = np.cumprod(np.full(int(g.size.max()), _U(0x9E3779B97F4A7C15)), dtype=_U)[np.arange(len(g.at)) - np.repeat(g.first, g.size)]
    return words.mix(np.add.reduceat(edge * power, g.first) ^ g.size.astype(_U))


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == _U else x.astype(np.int64))


def _extent(key: list[np.ndarray], doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An index of each distinct key, and the smallest and largest document that has it."""
    by = np.lexsort([doc, *key])
    new = np.ones(len(by), bool)
    if len(by):
        new[1:] = np.logical_or.reduce([k[by[1:]] != k[by[:-1]] for k in key])
    first = np.flatnonzero(new)
    return by[first], doc[by[first]], doc[by[np.append(first[1:], len(by)) - 1]] if len(by) else doc


def deduplicated(docs: DataFrame, window: int = WINDOW, seed: int = SEED, size: int = CHUNK_BYTES, texts: bool = True) -> DataFrame:
    """docs with n_words, n_removed and kept_sha256; with texts, removed words and the white space after them go from text."""
    docs = docs.drop(*ADDED)
    dealt = chunked(docs, size, "__chunk")
    columns = [c for c in docs.columns if texts or c != "text"]

    def blocks(table: pa.Table):
        """Each block's first row, graph, bytes, offsets, document numbers and whether they count."""
        ids = table["doc_id"].combine_chunks()
        known = ids.is_valid().to_numpy(zero_copy_only=False)
        number = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        for lo, hi, data, off in words.blocks(table["text"]):
            yield lo, hi, graph(data, off, window, seed), data, off, number[lo:hi], known[lo:hi]

    def seeds(key: tuple, table: pa.Table) -> pa.Table:
        m, d = [np.zeros(0, _U)], [np.zeros(0, np.int64)]
        for _, _, g, _, _, number, known in blocks(table):
            keep = known[g.doc]
            m.append(g.minimizer[keep])
            d.append(number[g.doc[keep]])
        m, d = np.concatenate(m), np.concatenate(d)
        at, low, high = _extent([m], d)
        return pa.table([_long(np.full(len(at), key[0].as_py())), _long(m[at]), _long(low), _long(high)], names=["chunk", "m", "low", "high"])

    def wanted_paths(g: Graph, wanted: np.ndarray, known: np.ndarray) -> np.ndarray:
        if not len(g.first) or not len(wanted):
            return np.zeros(0, np.int64)
        near = np.minimum(np.searchsorted(wanted, g.minimizer), len(wanted) - 1)
        return np.flatnonzero((wanted[near] == g.minimizer) & known[g.doc])

    def extents(split: bool):
        """For each path with a wanted minimizer, or each of its edges: the smallest and the largest document of the chunk."""

        def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
            wanted = np.unique(right["m"].to_numpy().view(_U))
            parts = [(np.zeros(0, _U), np.zeros(0, _U), np.zeros(0, np.int64))]
            for _, _, g, _, _, number, known in blocks(left):
                p = wanted_paths(g, wanted, known)
                if len(p):
                    edge = _edges(g, window)
                    n = g.size[p] if split else np.ones(len(p), np.int64)
                    x = edge[np.arange(n.sum()) + np.repeat(g.first[p] - np.cumsum(n) + n, n)] if split else _paths(g, edge)[p]
                    parts.append((np.repeat(g.minimizer[p], n), x, np.repeat(number[g.doc[p]], n)))
            m, x, d = (np.concatenate(v) for v in zip(*parts))
            at, low, high = _extent([x, m], d)
            return pa.table([_long(np.full(len(at), key[0].as_py())), _long(m[at]), _long(x[at]), _long(low), _long(high)], names=["chunk", "m", "x", "low", "high"])

        return run

    def removed(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        path = right["path"].to_numpy(zero_copy_only=False).astype(bool)
        m, x, source = right["m"].to_numpy().view(_U), right["x"].to_numpy().view(_U), right["source"].to_numpy()
        facts = []
        for own in (path, ~path):
            by = np.argsort(x[own], kind="stable")
            facts.append((x[own][by], m[own][by], source[own][by]))
        out = []
        for lo, hi, g, data, off, number, known in blocks(left):
            n = len(g.start)
            gone = np.zeros(n + 1, np.int64)
            if len(g.first):
                edge = _edges(g, window)
                hit = np.repeat(_smaller(facts[0], _paths(g, edge), g.minimizer, number[g.doc]), g.size)
                hit |= _smaller(facts[1], edge, np.repeat(g.minimizer, g.size), number[g.row[g.at]])
                hit &= known[g.row[g.at]]
                np.add.at(gone, g.at[hit], 1)
                np.add.at(gone, g.at[hit] + window, -1)
            gone = np.cumsum(gone[:-1]) > 0
            size = np.where(gone, 0, g.end - g.start + 1)
            ends = np.cumsum(size)
            joined = np.full(ends[-1] if n else 0, 32, np.uint8)
            stay = np.flatnonzero(~gone)
            length = size[stay] - 1
            inner = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
            joined[inner + np.repeat(ends[stay] - size[stay], length)] = data[inner + np.repeat(g.start[stay], length)]
            total, lost = np.bincount(g.row, minlength=hi - lo), np.bincount(g.row, gone, hi - lo).astype(np.int64)
            stop = np.concatenate([[0], ends])[np.cumsum(total)] if n else np.zeros(hi - lo, np.int64)
            begin = np.concatenate([[0], stop[:-1]])
            raw = joined.tobytes()
            sha = [hashlib.sha256(raw[s : max(s, e - 1)]).hexdigest() for s, e in zip(begin, stop)]
            table = left.slice(lo, hi - lo)
            arrays = [table[c] for c in columns]
            if texts and lost.any():
                cut = np.zeros(len(data) + 1, np.int64)
                follow = np.append(g.start[1:], len(data))
                follow = np.minimum(follow, off[g.row + 1])
                np.add.at(cut, g.start[gone], 1)
                np.add.at(cut, follow[gone], -1)
                keep = np.cumsum(cut[:-1]) == 0
                kept = np.concatenate([[0], np.cumsum(keep)])[off]
                raw = data[keep].tobytes()
                old = table["text"].to_pylist()
                new = [raw[a:b].decode() if k else t for a, b, k, t in zip(kept[:-1], kept[1:], lost, old)]
                arrays[columns.index("text")] = pa.array(new, table.schema.field("text").type)
            out.append(pa.table([*arrays, _long(total), _long(lost), pa.array(sha, pa.string())], names=[*columns, "n_words", "n_removed", "kept_sha256"]))
        return pa.concat_tables(out)

    by_m = Window.partitionBy("m")
    found = arrow.over_groups(dealt, "__chunk", seeds, "chunk bigint, m bigint, low bigint, high bigint")
    found = found.select("chunk", "m", F.min("low").over(by_m).alias("low"), F.max("high").over(by_m).alias("high")).filter("low <> high").select("chunk", "m")
    kind = "chunk bigint, m bigint, x bigint, low bigint, high bigint"
    paths = arrow.over_pairs(dealt, "__chunk", found, "chunk", extents(False), kind)
    straight = F.min("x").over(by_m) == F.max("x").over(by_m)
    paths = paths.select("chunk", "m", "x", "high", F.min("low").over(by_m).alias("source"), straight.alias("path"))
    branching = paths.filter("NOT path").select("chunk", "m")
    edges = arrow.over_pairs(dealt, "__chunk", branching, "chunk", extents(True), kind)
    edges = edges.select("chunk", "m", "x", "high", F.min("low").over(Window.partitionBy("m", "x")).alias("source"), F.lit(False).alias("path"))
    facts = paths.filter("path").unionAll(edges).filter("source < high").select("chunk", "m", "x", "source", "path")
    schema = T.StructType([docs.schema[c] for c in columns])
    for name, kind in (("n_words", T.LongType()), ("n_removed", T.LongType()), ("kept_sha256", T.StringType())):
        schema = schema.add(name, kind)
    return arrow.over_pairs(dealt, "__chunk", facts, "chunk", removed, schema)


def _smaller(facts: tuple[np.ndarray, np.ndarray, np.ndarray], x: np.ndarray, y: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Whether the facts, sorted by their first half of the key, name a source below doc for each key (x, y)."""
    a, b, source = facts
    out = np.zeros(len(x), bool)
    at = np.searchsorted(a, x)
    todo = np.arange(len(x))
    while len(todo):  # more than once only where 64 bits of two keys agree
        todo = todo[at[todo] < len(a)]
        todo = todo[a[at[todo]] == x[todo]]
        same = b[at[todo]] == y[todo]
        out[todo[same]] = source[at[todo[same]]] < doc[todo[same]]
        todo = todo[~same]
        at[todo] += 1
    return out
