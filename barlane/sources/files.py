"""Sources and sinks: transcripts as text files, match payloads as JSON, tables by JDBC, the judge's cache as Parquet."""
from __future__ import annotations

import os

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAYLOAD = "match_id STRING, battler_a STRING, battler_b STRING, tie_threshold DOUBLE, rounds ARRAY<STRUCT<a: STRING, b: STRING>>"


def transcripts(spark: SparkSession, path: str) -> DataFrame:
    """match_id, round, side, text of files <match>/<side>_round<N>[_<what>].txt, one row per whole file.

    Bytes that aren't UTF-8 become replacement characters.
    """
    name = r"([^/]+?)_round(\d+)(?:_[^/]*)?\.txt$"
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("_f"), F.make_valid_utf8(F.col("content").cast("string")).alias("value"))
    return files.select(
        F.regexp_extract("_f", r"([^/]+)/[^/]+$", 1).alias("match_id"),
        F.expr(f"try_cast(regexp_extract(_f, r'{name}', 2) AS INT)").alias("round"),
        F.regexp_extract("_f", name, 1).alias("side"),
        F.col("value").alias("text"),
    )


def inline(spark: SparkSession, text: str, opponent: str | None = None) -> DataFrame:
    """One performance given as a string."""
    return spark.createDataFrame([("inline", 1, "A", text, opponent)], "match_id STRING, round INT, side STRING, text STRING, opponent STRING")


def payloads(spark: SparkSession, path: str) -> DataFrame:
    """Match payloads of JSON files; what isn't valid JSON has nulls."""
    return spark.read.schema(PAYLOAD).json(path, multiLine=True)


def performances(payload: DataFrame) -> DataFrame:
    """match_id, round, side, text of payloads; a blank side keeps its row, for `rejects`."""
    rounds = payload.select("match_id", F.posexplode("rounds").alias("k", "r"))
    sides = F.explode(F.array(F.struct(F.lit("A").alias("side"), F.col("r.a").alias("text")), F.struct(F.lit("B").alias("side"), F.col("r.b").alias("text"))))
    return rounds.select("match_id", (F.col("k") + 1).cast("int").alias("round"), sides.alias("p")).select("match_id", "round", "p.side", "p.text")


def rejects(payload: DataFrame) -> DataFrame:
    """match_id and error of payloads that can't be scored."""
    blank = F.exists("rounds", lambda r: (F.trim(F.coalesce(r.a, F.lit(""))) == "") | (F.trim(F.coalesce(r.b, F.lit(""))) == ""))
    kind = F.when(F.col("rounds").isNull() | (F.size("rounds") == 0), "rounds must not be empty").when(blank, "a round lacks a side")
    return payload.select("match_id", kind.alias("error")).filter("error IS NOT NULL")


def jdbc(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """A table of a database; filters and columns are pushed down to it."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """The judge's answers: cache_key, content."""
    return spark.read.schema("cache_key STRING, content STRING").parquet(path)


def append_cache(answers: DataFrame, path: str) -> None:
    """Adds answers (cache_key, content) whose keys aren't there yet."""
    new = answers.select("cache_key", "content").filter("content IS NOT NULL").dropDuplicates(["cache_key"])
    try:
        new = new.join(read_cache(answers.sparkSession, path).select("cache_key"), "cache_key", "left_anti")
        new.write.mode("append").parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        answers.select("cache_key", "content").filter("content IS NOT NULL").dropDuplicates(["cache_key"]).write.mode("append").parquet(path)


def settings(*paths: str) -> dict[str, str]:
    """NAME=value lines of the first of these files that is there, below the environment: quotes go, # begins a comment line."""
    for path in paths:
        if os.path.exists(path):
            with open(path, encoding="utf-8") as f:
                pairs = [line.split("=", 1) for line in map(str.strip, f) if "=" in line and not line.startswith("#")]
            return {k.strip(): os.environ.get(k.strip(), v.strip().strip('"').strip("'")) for k, v in pairs}
    return {}


def write_verdicts(verdicts: DataFrame, matches: DataFrame, path: str, force: bool = False) -> DataFrame:
    """Writes the next state of matches (livestream_id, verdict, ...) to path and returns what was done to each verdict.

    verdicts: livestream_id, verdict, score1, score2, ai_score1, ai_score2. action is missing (no such match), refuse (more
    than one), skip (there is a verdict, and not `force`), overwrite or score. Only score and overwrite change a match; only
    score is meant to change accounts. The state is written beside the old one, never over it.
    """
    there = matches.groupBy("livestream_id").agg(F.count("*").alias("n"), F.max(F.col("verdict").isNotNull()).alias("known"))
    action = (
        F.when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "refuse").when(F.col("known"), "overwrite" if force else "skip").otherwise("score")
    )
    done = verdicts.join(there, "livestream_id", "left").withColumn("action", action).drop("n", "known")
    columns = [c for c in ("verdict", "score1", "score2", "ai_score1", "ai_score2")]
    new = done.filter("action IN ('score', 'overwrite')").select("livestream_id", *(F.col(c).alias(f"_{c}") for c in columns), F.lit(True).alias("_new"))
    state = matches.join(new, "livestream_id", "left")
    state.select(*(F.when(F.col("_new"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in matches.columns)).write.parquet(path)
    return done.select("livestream_id", "action")
