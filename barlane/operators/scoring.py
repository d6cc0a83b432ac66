"""Operators that no SQL of one row expresses: fuzzy repeats, greedy dedup, JSON recovery and the judge."""
from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import similarity
from ..functions.dialect import Spark
from ..plans import reconcile, sqls
from . import judge

Run = Callable[[str], DataFrame]
_KEYS = ["match_id", "round", "side"]


def dedup_greedy(dets: DataFrame) -> DataFrame:
    """Findings (match_id, round, side, n, idx, skill_id, points, quoted) after greedy dedup, a performance at a time."""
    item = F.struct("idx", "skill_id", "points", F.col("quoted").alias("lines"))
    rows = dets.groupBy(*_KEYS).agg(F.first("n").alias("n"), F.array_sort(F.collect_list(item)).alias("said"))
    alike = similarity.alike_udf(F.col("said.skill_id"), F.col("said.lines"))
    folded = rows.withColumn("a", alike).withColumn("near", F.col("a.near")).withColumn("kept", F.expr(reconcile.accepted(_D)))
    one = folded.select(*_KEYS, F.explode(F.expr(_D.each("kept", "i", _D.at("said", "i")))).alias("x"))
    return one.select(*_KEYS, "x.idx", "x.skill_id", "x.points")


def recovered(s: str) -> str:
    """The JSON in a judge's answer, or an error, as text."""
    return json.dumps(judge.read(s), sort_keys=True)


@F.pandas_udf(T.StringType())
def repaired_udf(s: pd.Series) -> pd.Series:
    return s.map(judge.repaired)


def judged(prompts: DataFrame, cache: DataFrame, ask: Callable[[pd.Series], pd.Series] | None = None) -> DataFrame:
    """prompts (cache_key, prompt, ...) with answers: from cache (cache_key, content), else from ask, asked once for each key.

    status is cached, asked or, without a judge at hand, missing; then the answer is null.
    """
    known = cache.groupBy("cache_key").agg(F.min("content").alias("content"))  # a key may have been added more than once
    hits = prompts.join(known, "cache_key", "left").withColumn("status", F.when(F.col("content").isNotNull(), "cached").otherwise("missing" if ask is None else "asked"))
    if ask is None:
        return hits
    asked = hits.filter("content IS NULL").dropDuplicates(["cache_key"]).select("cache_key", F.pandas_udf(ask, T.StringType())("prompt").alias("fresh"))
    return hits.join(asked, "cache_key", "left").withColumn("content", F.coalesce("content", "fresh")).drop("fresh")


_D = Spark()


def _dets(run: Run) -> DataFrame:
    return run(sqls._perf(_D, "SELECT * FROM dets", *sqls._dets(_D), prep=True))


def _repaired(run: Run) -> DataFrame:
    """The answers to the sample performances with their quotes mended."""
    return run(sqls.fx.with_(*sqls.judged(_D)) + "SELECT match_id, round, side, win_idx, content FROM answered WHERE content IS NOT NULL").select(*_KEYS, "win_idx", repaired_udf("content").alias("out"))


def _replay(run: Run) -> DataFrame:
    prompts = run(sqls.prompt_build(_D)).withColumn("cache_key", F.md5("prompt"))
    cache = prompts.filter("match_id % 2 = 0").select("cache_key", F.lit('{"semantic_detections": [{"skill_id": "MR"}]}').alias("content")).distinct()
    return judged(prompts, cache).select(*_KEYS, "win_idx", "content", "status")


def _round_json(run: Run) -> DataFrame:
    found = run(sqls.scan_detect(_D))
    rows = found.groupBy(*_KEYS).agg(F.sort_array(F.collect_list(F.struct("place", "skill_id", "skill_name", "points", "direction", "confidence"))).alias("detections"))
    return rows.select(*_KEYS, F.to_json(F.struct(*_KEYS, "detections")).alias("body"))


def _gate_log(run: Run) -> DataFrame:
    rows = run(sqls.hard_gates(_D)).filter("verdict <> 'accepted'").groupBy(*_KEYS)
    return rows.agg(F.to_json(F.sort_array(F.collect_list(F.struct("idx", "skill_id", "verdict")))).alias("gate_log"))


def _payload(run: Run) -> DataFrame:
    rounds = run(sqls._perf(_D, "SELECT * FROM perf")).groupBy("match_id", "round").pivot("side", ["A", "B"]).agg(F.first("text"))
    body = rounds.groupBy("match_id").agg(F.to_json(F.struct(F.lit(0.0).alias("tie_threshold"), F.sort_array(F.collect_list(F.struct("round", F.col("A").alias("a"), F.col("B").alias("b")))).alias("rounds"))).alias("body"))
    schema = "match_id STRING, battler_a STRING, battler_b STRING, tie_threshold DOUBLE, rounds ARRAY<STRUCT<a: STRING, b: STRING>>"
    p = body.select("match_id", F.from_json("body", schema).alias("p"))
    return p.select("match_id", F.coalesce(F.nullif("p.tie_threshold", F.lit(0.0)), F.lit(0.75)).alias("tie"), F.posexplode("p.rounds").alias("k", "r")).select("match_id", "tie", (F.col("k") + 1).alias("round"), F.md5("r.a").alias("a"), F.md5("r.b").alias("b"))


QUERIES: dict[str, Callable[[Run], DataFrame]] = {
    "json_repair": _repaired,
    "judge_replay": _replay,
    "round_json": _round_json,
    "gate_log": _gate_log,
    "payload_parse": _payload,
}
