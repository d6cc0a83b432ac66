"""Hard negatives against brute force, with hot cells, ties, odd rows and groups of few anchors."""
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from barlane.llm import voronoi

SCHEMA = "vec_id bigint, embedding array<float>, label int, extra string, score double, cell int"


def brute(rows, positives=5, count=3):
    own = sorted({(i, lab, tuple(math.floor(256 * float(np.float32(x))) for x in v)) for i, v, lab in rows if None not in (i, v, lab) and all(x is not None and math.isfinite(x) for x in v)})
    out = []
    for i, lab, q in own:
        if i % 50:
            continue
        near = sorted((-sum(a * b for a, b in zip(q, r)), j, s == lab, k) for k, (j, s, r) in enumerate(own) if j != i and len(r) == len(q))
        for negative, p, _, _ in [x for x in near if x[2]][:positives]:
            fits = [x for x in near if not x[2] and 50 * -negative <= 100 * -x[0] <= 95 * -negative]
            out += [(i, p, rank, n, -negative, -s) for rank, (s, n, _, _) in enumerate(fits[:count], 1)]
    return sorted(out)


def mined(spark, rows, **options):
    table = spark.createDataFrame([(i, v, lab, "x", 0.5, 1) for i, v, lab in rows], SCHEMA).repartition(4)
    return sorted(tuple(r) for r in voronoi.negatives(table, **options).collect())


def clustered(seed, n=700, dims=6):
    rng = np.random.default_rng(seed)
    centre = rng.standard_normal((8, dims))
    rows = []
    for i in range(n):
        c = 0 if i % 3 == 0 else i % 8  # a third of the rows is in one cell
        v = (centre[c] + 0.05 * rng.standard_normal(dims)).tolist()
        rows.append((i if i % 10 else i * 5, v, int(rng.integers(0, 3)) if i % 4 else c % 3))
    return rows


@pytest.mark.parametrize("options", [{}, {"pivots": 9, "group": 4, "piece": 64}, {"pivots": 1, "group": 3}])
def test_equals_brute_force_whatever_the_cells(spark, options):
    rows = clustered(5)
    want = brute(rows)
    assert len(want) > 300
    assert mined(spark, rows, **options) == want


def test_odd_rows_ties_and_repeats(spark):
    base = [1.0, 0.5, -0.25]
    rows = [(50 * i, base, 1) for i in range(4)] + [(1000 + i, [0.7, 0.3, -0.1], 2) for i in range(30)]  # equal scores
    rows += rows[:6]  # repeated rows count once
    rows += [(50, [0.9, 0.4, 0.0], 1), (1001, [0.6, 0.6, 0.0], 1)]  # rows of one id that differ
    rows += [(None, base, 1), (3, None, 1), (4, base, None), (5, [1.0, None, 0.0], 2), (6, [1.0, math.nan, 0.0], 2), (7, [math.inf, 1.0, 1.0], 2), (8, [], 1), (100_000, [], 2)]
    rows += [(200_000, [1.0, 1.0], 1), (200_001, [1.0, 0.9], 1), (200_002, [0.6, 0.6], 2), (200_003, [300.0, 300.0], 2), (9, [0.0, 0.0, 0.0], 2)]  # other lengths; beyond int16
    want = brute(rows)
    assert want and mined(spark, rows) == want
    assert mined(spark, rows, group=1, pivots=4) == want


def test_empty_tables(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, [1.0], 1), (2, [1.0], 2)]) == []  # no anchor


def test_rows_go_only_where_they_may_serve(spark):
    rng = np.random.default_rng(1)
    centre = 4 * np.eye(8)
    rows = [(i, (centre[i % 8] + 0.01 * rng.standard_normal(8)).tolist(), (i // 8) % 2) for i in range(1600)]
    table = spark.createDataFrame([(i, lab, [float(x) for x in v]) for i, v, lab in rows], "id bigint, label bigint, v array<double>")
    table = voronoi._quantised(table, 256.0).withColumn("uid", F.xxhash64("label", "q"))
    cells = voronoi._cells(table, 16, table.agg(F.max("norm")).first()[0])
    groups = voronoi._groups(cells, np.full(cells.number + 1, 10), 20, 8)
    assert groups.number >= 8
    home = voronoi._routed(table, cells, groups)
    assert home.count() == 1600 and home.select("t").distinct().count() > 16
    near = np.zeros(cells.number + 1), np.full(cells.number + 1, 100.0)  # clusters are 1448 apart
    away = voronoi._routed(table, cells, groups, near)
    assert away.count() <= 1600 * 2
    everywhere = voronoi._routed(table, cells, groups, (near[0], np.full(cells.number + 1, math.inf)))
    assert everywhere.count() == 1600 * (len({int(groups.first[c]) for c in range(cells.number)}) - 1)
