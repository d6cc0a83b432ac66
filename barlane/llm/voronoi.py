"""Hard-negative mining by a distributed nearest-neighbour join over Voronoi cells, exact for inner products.

Vectors are quantised to whole numbers, and a component is added so that inner products become distances: a row x becomes
(x, sqrt(M^2 - |x|^2)), M being the largest norm, an anchor a becomes (a, 0), and |a'-x'|^2 = |a|^2 + M^2 - 2<a, x>. Rows
and anchors belong to the nearest of some pivots. Cells are put into groups of anchors, neighbouring cells together; a cell
with many anchors is split among several groups. A join has two passes. At home, every row meets the anchors of the group
that holds its own cell. What they found so far bounds how far a better row may be from an anchor, so each cell knows
between which distances from its pivot such rows lie (triangle inequality); in the second pass a row goes to those other
groups alone that have a cell which it may serve. Positives are joined first, then negatives between the scores that the
positives allow. Rows of a group are dealt by hash into pieces of bounded size, so neither a cell nor a label is gathered in
a task, and what pieces find is cut to the first few of each anchor by a window.

Pivots are a bounded sample (PIVOTS rows at most, by hash of the id). Where cells tell nothing, as with vectors that are
spread evenly over many dimensions, every row goes to every group, whose number grows with the square root of the anchors.

Defined results: rows with a null id, label or vector, with null or non-finite components, or with components beyond the
range of doubles once quantised take no part; equal rows (id, label and vector) count once; rows of one id that differ
are rows of their own, and none is a positive or a negative of another; vectors meet only those of their own length; equal
scores go by id; scores beyond 2^47 count as 2^47; an empty table gives an empty result; other columns are ignored.
"""
from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import arrow
from .graphs import spread
from .store import discard, written

#: Positives of an anchor, and negatives of a positive.
POSITIVES, NEGATIVES = 5, 3
#: A negative's score is at least LEAST and at most MOST hundredths of the positive's.
LEAST, MOST = 50, 95
#: Pivots at most, and rows of one piece of a group at least.
PIVOTS, PIECE = 2048, 4096
_TOP, _BITS = 1 << 47, 12
_NONE = -(1 << 62)
_ROWS = "id bigint, label bigint, dims int, norm double, q binary"
_FOUND = "a_id bigint, a_uid bigint, k int, p_id bigint, p_score bigint, id bigint, uid bigint, score bigint"


def _quantised(rows: DataFrame, scale: float) -> DataFrame:
    """id, label, dims, norm (the squared one) and q: components as int16 where they fit, else as doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, dims, norm, raw = [], [], [], []
            for i, v in enumerate(batch.column(2)):
                x = np.asarray(v.values.to_numpy(zero_copy_only=False), float)
                with np.errstate(over="ignore", invalid="ignore"):
                    x = np.floor(scale * x)
                    n = float(x @ x)
                if np.isfinite(x).all() and math.isfinite(n):
                    at.append(i)
                    dims.append(len(x))
                    norm.append(n)
                    raw.append(x.astype("<i2" if len(x) and np.abs(x).max() < 1 << 15 else "<f8").tobytes())
            some = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(some), batch.column(1).take(some), pa.array(dims, pa.int32()), pa.array(norm, pa.float64()), pa.array(raw, pa.binary())], names=["id", "label", "dims", "norm", "q"])

    return arrow.over(rows.dropna(), run, _ROWS)


def _matrix(raw: list[bytes], dims: int) -> np.ndarray:
    """Rows of quantised components."""
    out = np.zeros((len(raw), dims))
    short = np.array([len(r) == 2 * dims for r in raw], bool)
    for own, kind in ((short, "<i2"), (~short, "<f8")):
        if dims and own.any():
            out[own] = np.frombuffer(b"".join(r for r, o in zip(raw, own) if o), kind).reshape(-1, dims)
    return out


@dataclass(frozen=True)
class Cells:
    """Pivots by the length of their vectors: their numbers and their places, with the added component; top: M^2."""

    number: int
    pivots: dict[int, tuple[np.ndarray, np.ndarray]]
    top: float

    @property
    def slack(self) -> float:
        """More than rounding may change a distance."""
        return 1e-6 * (1 + math.sqrt(self.top))

    def distances(self, x: np.ndarray, norm: np.ndarray, anchors: bool) -> tuple[np.ndarray, np.ndarray]:
        """Distances of rows (or anchors) of one length to the pivots of that length, and those pivots' numbers."""
        which, place = self.pivots.get(x.shape[1], (np.zeros(0, np.int64), np.zeros((0, x.shape[1] + 1))))
        more = 0 if anchors else np.sqrt(np.maximum(self.top - norm, 0))[:, None] * place[:, -1]
        square = norm[:, None] * anchors + (not anchors) * self.top + (place**2).sum(1) - 2 * (x @ place[:, :-1].T + more)
        return np.sqrt(np.maximum(square, 0)), which

    def nearest(self, d: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each row's cell and its distance from the pivot; rows of a length without pivots share the last cell."""
        if not len(which):
            return np.full(len(d), self.number), np.zeros(len(d))
        at = d.argmin(1)
        return which[at], d[np.arange(len(d)), at]


def _cells(rows: DataFrame, number: int, top: float) -> Cells:
    """Pivots from the rows with the smallest hashes of their ids."""
    some = rows.orderBy(F.xxhash64(F.lit(3), "id"), "id", "uid").limit(number).select("dims", "norm", "q").toArrow()
    dims, raw, norm = some["dims"].to_numpy(), some["q"].to_pylist(), some["norm"].to_numpy()
    pivots = {}
    for d in np.unique(dims):
        own = np.flatnonzero(dims == d)
        x = _matrix([raw[i] for i in own], int(d))
        pivots[int(d)] = own, np.column_stack([x, np.sqrt(np.maximum(top - norm[own], 0))])
    return Cells(len(raw), pivots, top)


@dataclass(frozen=True)
class Groups:
    """Groups of anchors: those of cell c start at g = first[c] and are parts[g] in number; pieces: of a group's rows."""

    first: np.ndarray
    parts: np.ndarray
    number: int
    pieces: int


def _groups(cells: Cells, counts: np.ndarray, most: int, pieces: int) -> Groups:
    """Cells along a path from each pivot to the nearest one left, cut where a group has its share of anchors."""
    first, parts, n, held = np.zeros(len(counts), np.int64), {}, 0, 0
    paths = []
    for which, place in cells.pivots.values():
        left, at = np.ones(len(which), bool), 0
        for _ in which:
            left[at] = False
            paths.append(int(which[at]))
            d = np.where(left, ((place - place[at]) ** 2).sum(1), np.inf)
            at = int(d.argmin())
    for c in [*paths, cells.number]:
        if counts[c] > most or held and held + counts[c] > most:  # a new group; several for a cell with many anchors
            n, held = n + bool(held), 0
        first[c] = n
        held += counts[c]
        if counts[c] > most:
            parts[n] = -(-int(counts[c]) // most)
            n, held = n + parts[n], 0
    return Groups(first, np.array([parts.get(g, 1) for g in range(n + 1)]), n + bool(held), pieces)


def _by_length(batch: pa.RecordBatch | pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indexes and components of the rows of each length."""
    dims, raw = batch["dims"].to_numpy(), batch["q"].to_pylist()
    for d in np.unique(dims):
        at = np.flatnonzero(dims == d)
        yield at, _matrix([raw[i] for i in at], int(d))


def _anchored(anchors: DataFrame, cells: Cells) -> DataFrame:
    """anchors with cell and near, the distance from its pivot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            norm = batch["norm"].to_numpy()
            cell, near = np.zeros(len(norm), np.int32), np.zeros(len(norm))
            for at, x in _by_length(batch):
                cell[at], near[at] = cells.nearest(*cells.distances(x, norm[at], True))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(near)], names=[*batch.schema.names, "cell", "near"])

    return arrow.over(anchors, run, f"{_ROWS}, uid bigint, cell int, near double")


def _ranges(low: np.ndarray, high: np.ndarray, cell: np.ndarray, number: int) -> tuple[np.ndarray, np.ndarray]:
    """Distances from and to which each cell wants rows; none where it isn't listed."""
    a, b = np.full(number + 1, np.inf), np.full(number + 1, -np.inf)
    a[cell], b[cell] = low, high
    return a, b


def _routed(rows: DataFrame, cells: Cells, groups: Groups, wants: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """rows with t, a row for each task (piece of a group) that they go to.

    Without bounds they go home; with bounds, to all other groups of which a cell wants them: the same ones of all rows
    (`wants`), or those in the columns cell, low and high.
    """
    names = rows.columns
    own_bounds = "low" in names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            norm, uid, ids, label = (batch[c].to_numpy() for c in ("norm", "uid", "id", "label"))
            piece = (uid ^ ids * 0x9E3779B1) % groups.pieces
            row, to = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for at, x in _by_length(batch):
                d, which = cells.distances(x, norm[at], False)
                home, _ = cells.nearest(d, which)
                if wants is None and not own_bounds:
                    row.append(at)
                    to.append(groups.first[home])
                    continue
                if own_bounds:  # equal for all rows of a label
                    ok = np.zeros(d.shape, bool)
                    for one in np.unique(label[at]):
                        these = np.flatnonzero(label[at] == one)
                        i = int(at[these[0]])
                        low, high = _ranges(*(batch[c][i].values.to_numpy() for c in ("low", "high", "cell")), cells.number)
                        ok[these] = (d[these] >= low[which] - cells.slack) & (d[these] <= high[which] + cells.slack)
                else:
                    ok = (d >= wants[0][which] - cells.slack) & (d <= wants[1][which] + cells.slack)
                a, b = np.nonzero(ok)
                away = groups.first[which[b]] != groups.first[home[a]]
                pair = np.unique(np.stack([a[away], groups.first[which[b[away]]]]), axis=1)
                row.append(at[pair[0]])
                to.append(pair[1])
            row, to = np.concatenate(row), np.concatenate(to)
            parts = groups.parts[to]
            part = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
            row, to = np.repeat(row, parts), np.repeat(to, parts)
            t = (to + part) * groups.pieces + piece[row]
            got = batch.select(["id", "uid", "label", "dims", "q"]).take(pa.array(row))
            yield pa.RecordBatch.from_arrays([pa.array(t), *got.columns], names=["t", *got.schema.names])

    return arrow.over(rows, run, "t bigint, id bigint, uid bigint, label bigint, dims int, q binary")


def _first(a: np.ndarray, score: np.ndarray, ids: np.ndarray, uid: np.ndarray, k: int) -> np.ndarray:
    """Indexes of the first k of each a by falling score, then id."""
    by = np.lexsort((uid, ids, -score, a))
    start = np.flatnonzero(np.append(True, a[by][1:] != a[by][:-1])) if len(by) else np.zeros(0, np.int64)
    place = np.arange(len(by)) - np.repeat(start, np.diff(np.append(start, len(by))))
    return by[place < k]


def _best(key: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and score of the k largest keys of each row."""
    k = min(k, key.shape[1])
    top = np.partition(key, key.shape[1] - k, axis=1)[:, -k:]
    row, place = np.nonzero(top > _NONE)
    top = top[row, place]
    return row, (1 << _BITS) - 1 - (top & ((1 << _BITS) - 1)), top >> _BITS


def _local(anchors: pa.Table, rows: pa.Table, k: int, positives: bool) -> pa.Table:
    """The first k rows of each anchor, or of each of its windows, among these rows."""
    a_id, a_uid, a_label = (anchors[c].to_numpy() for c in ("id", "uid", "label"))
    r_id, r_uid, r_label = (rows[c].to_numpy() for c in ("id", "uid", "label"))
    windows = [[]] * len(a_id) if positives else anchors["windows"].to_pylist()
    number = 1 if positives else max(map(len, windows), default=0)
    low, high = np.full((len(a_id), number), _TOP + 1), np.full((len(a_id), number), -_TOP - 1)
    for i, own in enumerate(windows):
        low[i, : len(own)], high[i, : len(own)] = [w["low"] for w in own], [w["high"] for w in own]
    mine = {x.shape[1]: (at, x) for at, x in _by_length(anchors)}
    out: list[list[np.ndarray]] = [[] for _ in range(4)]  # anchor, window, row, score
    for r_at, y in _by_length(rows):
        if y.shape[1] not in mine:
            continue
        a_at, x = mine[y.shape[1]]
        by = np.lexsort((r_uid[r_at], r_id[r_at]))
        r_at, y = r_at[by], y[by]
        for lo in range(0, len(r_at), 1 << _BITS):
            some = r_at[lo : lo + (1 << _BITS)]
            place = (1 << _BITS) - 1 - np.arange(len(some))
            for first in range(0, len(a_at), 256):
                these = a_at[first : first + 256]
                with np.errstate(over="ignore", invalid="ignore"):
                    s = np.nan_to_num(x[first : first + 256] @ y[lo : lo + len(some)].T, nan=0.0)
                key = (np.clip(s, -_TOP, _TOP).astype(np.int64) << _BITS) + place
                same = a_label[these][:, None] == r_label[some]
                key[(~same if positives else same) | (a_id[these][:, None] == r_id[some])] = _NONE
                for w in range(number):
                    cut = key
                    if not positives:
                        inside = (key >= (low[these, w] << _BITS)[:, None]) & (key < ((high[these, w] + 1) << _BITS)[:, None])
                        if not inside.any():
                            continue
                        cut = np.where(inside, key, _NONE)
                    i, j, score = _best(cut, k)
                    for into, v in zip(out, (these[i], np.full(len(i), w), some[j], score)):
                        into.append(v)
    a, w, r, score = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in out)
    keep = _first(a * max(number, 1) + w, score, r_id[r], r_uid[r], k)
    a, w, r, score = a[keep], w[keep], r[keep], score[keep]
    known = [windows[i][j] if not positives else {"k": 0, "id": 0, "score": 0} for i, j in zip(a, w)]
    made = [a_id[a], a_uid[a], np.array([x["k"] for x in known], np.int32), np.array([x["id"] for x in known], np.int64), np.array([x["score"] for x in known], np.int64), r_id[r], r_uid[r], score]
    return pa.table([pa.array(x) for x in made], names=["a_id", "a_uid", "k", "p_id", "p_score", "id", "uid", "score"])


def _joined(anchors: DataFrame, dealt: DataFrame, groups: Groups, k: int, positives: bool) -> DataFrame:
    """What each piece finds for the anchors of its group."""
    start = F.element_at(F.lit(groups.first.tolist()), F.col("cell") + 1).cast("int")
    group = start + F.pmod(F.xxhash64("uid", "id"), F.element_at(F.lit(groups.parts.tolist()), start + 1))
    sent = anchors.withColumn("piece", F.explode(F.sequence(F.lit(0), F.lit(groups.pieces - 1)))).withColumn("t", group * groups.pieces + F.col("piece"))
    sent = sent.select("t", "id", "uid", "label", "dims", "q", *([] if positives else ["windows"]))
    return arrow.over_pairs(sent, "t", dealt, "t", lambda _, a, b: _local(a, b, k, positives), _FOUND)


def _cut(found: DataFrame, k: int) -> DataFrame:
    """The first k of each anchor and window, with their rank."""
    by = Window.partitionBy("a_id", "a_uid", "k").orderBy(F.desc("score"), "id", "uid")
    return found.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)


def negatives(
    rows: DataFrame, anchor: Column | None = None, scale: float = 256.0, positives: int = POSITIVES, count: int = NEGATIVES, least: int = LEAST, most: int = MOST,
    pivots: int = PIVOTS, piece: int = PIECE, group: int | None = None,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for rows (vec_id, embedding, label).

    anchor: which rows are anchors, over vec_id and label (vec_id divisible by 50 where None). group: anchors of a group
    (8 times the square root of their number where None).
    """
    plain = rows.select(F.col("vec_id").cast("bigint").alias("id"), F.col("label").cast("bigint").alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    plain = plain.filter(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    table = _quantised(plain, scale).dropDuplicates(["id", "label", "q"]).withColumn("uid", F.xxhash64("label", "q"))
    table = written(table, "negatives-rows")
    chosen = F.col("vec_id") % 50 == 0 if anchor is None else anchor
    asked = table.withColumn("vec_id", F.col("id")).filter(chosen).drop("vec_id")
    n, top = table.agg(F.count("*"), F.coalesce(F.max("norm"), F.lit(0.0))).first()
    number = max(1, asked.count())
    cells = _cells(table, min(pivots, max(1, math.ceil(math.sqrt(number)))), top)
    anchors = written(_anchored(asked.select(*table.columns), cells), "negatives-anchors")
    counts = np.zeros(cells.number + 1, np.int64)
    for cell, c in anchors.groupBy("cell").count().collect():  # a row for each pivot at most
        counts[cell] = c
    share = group or math.ceil(8 * math.sqrt(number))
    groups = _groups(cells, counts, share, max(8, -(-n // max(piece, 2 * share))))
    home = _routed(table, cells, groups)

    # Positives: at home, then from where a row may be closer than the last one found.
    found = written(_joined(anchors, home, groups, positives, True), "negatives-positives")
    reach = F.sqrt(F.greatest(F.col("norm") + top - 2 * F.col("last"), F.lit(0.0)))
    here = _cut(found, positives).groupBy(F.col("a_id").alias("id"), F.col("a_uid").alias("uid")).agg(F.when(F.count("*") == positives, F.min("score")).alias("last"))
    bounds = anchors.join(here, ["id", "uid"], "left").withColumn("reach", F.coalesce(reach, F.lit(float("inf"))))
    bounds = bounds.groupBy("label", "cell").agg(F.min(F.col("near") - F.col("reach")).alias("low"), F.max(F.col("near") + F.col("reach")).alias("high"))
    bounds = bounds.groupBy("label").agg(F.collect_list(F.struct("cell", "low", "high")).alias("b")).select("label", "b.cell", "b.low", "b.high")
    tables = [table, anchors, found]
    if groups.number > 1:
        away = _routed(spread(table, bounds, "label", "id"), cells, groups)
        more = written(_joined(anchors, away, groups, positives, True), "negatives-positives")
        tables.append(more)
        found = found.unionAll(more)

    # Negatives: rows of other labels between the scores that the positives allow.
    window = F.struct(
        F.col("rank").alias("k"), F.col("id").alias("id"), F.col("score").alias("score"),
        F.ceil(F.col("score") * least / 100).alias("low"), F.floor(F.col("score") * most / 100).alias("high"),
    )
    own = _cut(found, positives).withColumn("w", window).filter("w.low <= w.high")
    own = own.groupBy(F.col("a_id").alias("id"), F.col("a_uid").alias("uid")).agg(F.sort_array(F.collect_list("w")).alias("windows"))
    seeking = written(anchors.join(own, ["id", "uid"]), "negatives-anchors")
    first = written(_joined(seeking, home, groups, count, False), "negatives-found")
    if groups.number > 1:
        here = _cut(first, count).groupBy(F.col("a_id").alias("id"), F.col("a_uid").alias("uid"), "k").agg(F.when(F.count("*") == count, F.min("score")).alias("last"))
        each = seeking.select("id", "uid", "cell", "near", "norm", F.explode("windows").alias("w")).withColumn("k", F.col("w.k"))
        each = each.join(here, ["id", "uid", "k"], "left").withColumn("last", F.coalesce("last", "w.low"))
        each = each.withColumn("near_most", F.sqrt(F.greatest(F.col("norm") + top - 2 * F.col("w.high"), F.lit(0.0)))).withColumn("reach", reach)
        low = F.greatest(F.col("near") - F.col("reach"), F.col("near_most") - F.col("near"))
        got = each.groupBy("cell").agg(F.min(low).alias("low"), F.max(F.col("near") + F.col("reach")).alias("high")).toArrow()  # a row for each pivot at most
        wants = _ranges(*(got[c].to_numpy() for c in ("low", "high", "cell")), cells.number)
        more = written(_joined(seeking, _routed(table, cells, groups, wants), groups, count, False), "negatives-found")
        first = first.unionAll(more)
    discard(*tables, seeking)
    return _cut(first, count).select(
        F.col("a_id").alias("anchor_id"), F.col("p_id").alias("positive_id"), "rank", F.col("id").alias("negative_id"), F.col("p_score").alias("positive_score"), F.col("score").alias("negative_score"),
    )
