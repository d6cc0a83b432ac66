"""Operators over a user's own performances: a DataFrame of match_id, round, side, text."""
from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.dialect import Spark
from .operators import hybrid as _hybrid
from .plans import fixtures, sqls
from .plans.queries import session
from .registry import NEGATIVE, POSITIVE


def _over(performances: DataFrame, make: Callable[[Spark], str]) -> DataFrame:
    view = f"performances_{uuid.uuid4().hex}"
    performances.select("match_id", "round", "side", "text").createGlobalTempView(view)
    sample, own = fixtures.performances(Spark()), f"perf AS (SELECT * FROM global_temp.{view})"
    # Only the sample ones are dealt out anew; these stay in the partitions that they have.
    sql = make(Spark()).replace(sample, own).replace(fixtures.dealt(Spark(), "perf"), "perf")
    return session(performances.sparkSession).sql(sql)


def apply(performances: DataFrame, query: str) -> DataFrame:
    """The named query with these performances in place of the sample ones."""
    return _over(performances, sqls.Q[query])


def scan(performances: DataFrame, threshold: float = POSITIVE, negative_threshold: float = NEGATIVE) -> DataFrame:
    """Every detection: skill, points, confidence, direction, evidence, in the order of `place`."""
    return _over(performances, lambda d: sqls.detections_of(d, threshold, negative_threshold))


def totals(performances: DataFrame) -> DataFrame:
    """Number of detections and total of each performance."""
    return apply(performances, "scan_total")


def windows(performances: DataFrame) -> DataFrame:
    """Overlapping line windows of each performance."""
    return apply(performances, "line_windows")


def legacy_matrix(performances: DataFrame) -> DataFrame:
    """The four legacy scores of each performance."""
    return apply(performances, "legacy_matrix")


def line_scores(performances: DataFrame) -> DataFrame:
    """Every line with its skills and points."""
    return apply(performances, "line_scores")


def score_rounds(performances: DataFrame) -> DataFrame:
    """A document for each performance: its lines with skills and points, total, highlights and deductions, as JSON."""
    keys = ["match_id", "round", "side"]
    lines = line_scores(performances).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("line_no", "line", "skills", "line_score"))).alias("lines"))
    item = F.struct("place", "skill_id", "skill_name", "points", "direction", "category", "confidence", "evidence")
    some = lambda s: F.array_sort(F.collect_list(F.when(F.col("direction") == s, item)))
    found = scan(performances).groupBy(*keys).agg(some("positive").alias("highlights"), some("negative").alias("deductions"))
    whole = totals(performances).join(lines, keys, "left").join(found, keys, "left")
    body = F.to_json(F.struct(F.col("round").alias("round_number"), F.col("side").alias("battler"), F.col("total").alias("total_score"), "lines", "highlights", "deductions"))
    return whole.select(*keys, "n", "total", body.alias("document"))


def match_verdicts(performances: DataFrame) -> DataFrame:
    """Winner, wins and summary of each match by the rules alone."""
    return apply(performances, "match_verdict")


#: Rules and judge over each performance, and over whole matches; see operators.hybrid.
hybrid = _hybrid.hybrid
matches = _hybrid.matches
