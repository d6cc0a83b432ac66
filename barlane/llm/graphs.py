"""Connected components of link tables, and buckets cut into pairs of bounded blocks."""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrow
from .store import discard, written

#: Members of one block of a bucket, and rows that one group of block pairs holds about.
BLOCK, GROUP_ROWS = 400, 20_000
#: Links (16 bytes each) that one task may finish alone.
ALONE = 200_000


def roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest index in the component of each of n nodes, for links a[i], b[i]."""
    of = np.arange(n)
    while len(a):
        x, y = of[a], of[b]
        open_ = x != y
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(of, np.maximum(x, y), np.minimum(x, y))
        while (of[of] != of).any():
            of = of[of]
    return of


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links replaced by one from each node to the smallest that it reaches, for every ALONE links or so."""
    parts: list[tuple[np.ndarray, np.ndarray]] = []

    def done() -> pa.RecordBatch:
        a, b = (np.concatenate(x) for x in zip(*parts))
        parts.clear()
        node, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        root = node[roots(at[: len(a)], at[len(a) :], len(node))]
        keep = root != node
        return pa.RecordBatch.from_arrays([pa.array(node[keep]), pa.array(root[keep])], names=["a", "b"])

    for batch in batches:
        parts.append(tuple(batch.column(i).to_numpy() for i in (0, 1)))
        if sum(len(a) for a, _ in parts) > ALONE:
            yield done()
    if parts:
        yield done()


def components(links: DataFrame, alone: int = ALONE) -> DataFrame:
    """(node, component) of every node of links (a, b), component being its smallest node.

    Large-star and small-star steps by turns: each hangs a node's larger, then its smaller neighbours on the smallest one.
    A step is an aggregation to a minimum and a join, so a node with many neighbours is never gathered. Each round is a
    written table, and rounds end when it repeats, or when so few links are left (`alone`) that one task finishes them.
    """
    links = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b")
    now = written(arrow.over(links, _contracted, "a bigint, b bigint").distinct(), "links")
    seen = None
    while True:
        mark = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("s")).first()
        if mark == seen or not mark.n:
            break
        if mark.n <= alone:
            before, now = now, written(arrow.over(now.coalesce(1), _contracted, "a bigint, b bigint"), "links")
            discard(before)
            break
        seen = mark
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(low, both.a == low.u).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").distinct()  # each a hangs on smaller nodes b
        least = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m")
        small = large.join(least, large.a == least.u).select(F.col("b").alias("a"), F.col("m").alias("b"))
        before, now = now, written(small.unionAll(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).filter("a <> b").distinct(), "links")
        discard(before)
    own = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return own.unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def spread(rows: DataFrame, facts: DataFrame, key: str, on: str, parts: int = 8, how: str = "inner") -> DataFrame:
    """rows joined with facts, which has one row for each key: facts is repeated, so that a key's rows, dealt by the hash
    of the column `on`, go to `parts` tasks."""
    part = F.pmod(F.xxhash64(on), F.lit(parts)).cast("int").alias("_part")
    return rows.select("*", part).join(facts.select("*", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("_part")), [key, "_part"], how).drop("_part")


def block_pairs(members: DataFrame, pairs: Callable[[pa.Table, list[tuple[np.ndarray, np.ndarray, bool]]], list[pa.Array]], schema: str, names: list[str], multi: str = "n > 1") -> DataFrame:
    """`pairs` applied to all pairs of blocks of each bucket.

    members: bucket, id and what pairs needs, a row for each member of a bucket; multi: which buckets count, over n and
    the smallest and largest `tag` of their members (low, high). pairs gets a table and a list of (rows of one
    block, rows of the other, whether they are the same block); it returns the columns `names`. A block holds BLOCK members about, so
    no task gathers a bucket.
    """
    size = members.groupBy("bucket").agg(F.count("*").alias("n"), F.min("tag").alias("low"), F.max("tag").alias("high")).filter(multi)
    dealt = spread(members, size.select("bucket", F.col("n").alias("_n")), "bucket", "id")
    dealt = dealt.withColumn("_k", F.ceil(F.col("_n") / BLOCK)).withColumn("_own", F.pmod(F.xxhash64("id"), F.col("_k")))
    dealt = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_k") - 1)))
    dealt = dealt.withColumns({"_i": F.least("_own", "_other"), "_j": F.greatest("_own", "_other")}).drop("_k", "_other", "_n")
    rows = size.agg(F.sum(F.col("n") * F.ceil(F.col("n") / BLOCK))).first()[0] or 0
    dealt = dealt.withColumn("_g", F.pmod(F.xxhash64("bucket", "_i", "_j"), F.lit(max(1, -(-int(rows) // GROUP_ROWS)))))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        bucket, i, j, own = (table[c].to_numpy() for c in ("bucket", "_i", "_j", "_own"))
        by = np.lexsort((own, j, i, bucket))
        place = np.stack([bucket[by], i[by], j[by]])
        cut = np.flatnonzero((place[:, 1:] != place[:, :-1]).any(0)) + 1
        out = []
        for at in np.split(by, cut):
            if i[at[0]] == j[at[0]]:
                if len(at) > 1:
                    out.append((at, at, True))
            else:
                first = own[at] == i[at[0]]
                if first.any() and not first.all():
                    out.append((at[first], at[~first], False))
        got = pairs(table, out)
        return pa.table(got, names=names)

    return arrow.over_groups(dealt, "_g", run, schema)
