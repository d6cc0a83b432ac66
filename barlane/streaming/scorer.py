"""Matches scored as they become complete: transcripts in, verdicts out, each exactly once.

The sink scores what a micro-batch completes and writes it under the number of the micro-batch. A batch that is tried again
has the same matches, for the state goes back with it, and replaces what it wrote before; so a restart in the middle of a
batch neither loses nor repeats a verdict. With an answer store the judge isn't asked again either.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import api
from .completeness import complete_matches


def by_rules(rounds: DataFrame) -> DataFrame:
    """Verdicts of whole matches (match_id, round, a, b) by the rules alone."""
    sides = F.explode(F.array(F.struct(F.lit("A").alias("side"), F.col("a").alias("text")), F.struct(F.lit("B").alias("side"), F.col("b").alias("text"))))
    return api.match_verdicts(rounds.select("match_id", "round", sides.alias("p")).select("match_id", "round", "p.side", "p.text"))


def by_judge(ask, store: str, **options) -> Callable[[DataFrame], DataFrame]:
    """Verdicts by rules and judge, through an answer store; for `verdicts`."""
    return lambda rounds: api.matches(rounds, ask, store=store, **options)


def verdicts(stream: DataFrame, out: str, checkpoint: str, score: Callable[[DataFrame], DataFrame] = by_rules, then: Callable[[DataFrame, int], None] | None = None, **trigger) -> StreamingQuery:
    """Starts a query that scores the matches of stream (see complete_matches) and writes them to out, a folder a micro-batch.

    then(verdicts, number): called after a batch is written, for example to save them to a database; it may be called again
    for a batch that is tried again. trigger: as of DataStreamWriter.trigger.
    """

    def sink(texts: DataFrame, number: int) -> None:
        rounds = texts.groupBy("match_id", "round").agg(*(F.max(F.when(F.col("side") == s, F.col("text"))).alias(s.lower()) for s in "AB"))
        score(rounds).write.mode("overwrite").parquet(f"{out}/batch={number}")
        if then is not None:
            then(texts.sparkSession.read.parquet(f"{out}/batch={number}"), number)

    writer = complete_matches(stream).writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).outputMode("append")
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def read(spark: SparkSession, out: str) -> DataFrame:
    """All verdicts so far, with the number of their batch."""
    return spark.read.parquet(out)
