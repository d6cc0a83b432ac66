"""A scan's tests are searched for a column at a time, not one by one in each row, with the results of the JVM's patterns."""
import re

import pyarrow as pa

from barlane.functions import searches
from barlane.functions.dialect import FOLDED, Spark
from barlane.plans import sqls
from barlane.plans.phrases import OPENERS, PHRASES


def test_no_scan_tries_its_patterns_row_by_row():
    """Before, each scan had some 300 patterns and 900 plain searches of a folded text in its SQL."""
    for name in ("scan_total", "scan_detect", "scan_split", "round_winner", "match_verdict"):
        sql = sqls.Q[name](Spark())
        layer = sql[sql.index("tested AS ("):]
        assert not re.search(r"\b(?:s|s2|low) RLIKE|contains\((?:s|s2|low), '", layer), name


def test_results_are_those_of_the_jvm(spark):
    texts = [*PHRASES, *OPENERS, " ".join(PHRASES), "one\x0btwo punch, hold\x0bon", "um... [uh] wait", "a_b", "", " ", "you broke\nyou fake \x0c you trash", None]
    tests = list(searches.searched().tests)
    plain = Spark()
    df = spark.createDataFrame([(i, t and t.lower()) for i, t in enumerate(texts)], "i int, low string").selectExpr("i", "low", "low AS s", "low AS s2").coalesce(1).cache()
    asked = [plain.has(x, what) if kind == "pattern" else plain.contains(x, what) for x, kind, what in tests]
    want = [r.a for r in df.selectExpr("i", f"array({', '.join(asked)}) AS a").orderBy("i").collect()]
    column = pa.array([t and t.lower() for t in texts], pa.string())
    got = searches.search(*[column] * len(FOLDED)).to_pylist()
    for t, a, b in zip(texts, want, got):
        assert a == b, (t, [test for test, x, y in zip(tests, a, b) if x != y])


def test_a_performance_without_text_has_no_detections(spark):
    from barlane import api

    rows = spark.createDataFrame([("m", 1, "A", None), ("m", 1, "B", PHRASES[0])], "match_id string, round int, side string, text string")
    assert {(r.side, r.n >= 0) for r in api.totals(rows).collect()} == {("A", True), ("B", True)}


def test_the_judged_path_runs_only_the_detectors_it_takes_over():
    """Before, all 35 detectors ran with their evidence, of which three were kept."""
    sql = sqls.Q["hybrid_full"](Spark())
    scanned = sql[sql.index("repeated0 AS ("):sql.index("aw1 AS (")]
    assert {s for s in re.findall(r"'skill_id', '(\w+)'", scanned)} == {"DD", "TVL", "CHK"}
    assert searches.SEARCHES not in sql
