"""Multi-party chat rendering: each dialogue once for every participant, who then speaks as the assistant.

Messages of one speaker become the assistant's, all others become users with their speaker's name, `system` messages
stay. Rendered is `<|assistant|>`, `<|user:NAME|>` or `<|system|>`, a line feed, the text, `<|end|>` and a line feed; the
mask lists the code point ranges `start-end` (end not included) of the assistant's texts with their `<|end|>`.
A dialogue comes in parts of PART turns, so that no conversation, however long, is gathered into one row or task; parts
follow one another by number, and ranges count from their part's start.

Defined results: repeated rows are rendered once; a null role is the participant `unknown`; a null text is empty; ties in
turn are ordered by role and text; messages without turn make parts below 0; a null conv_id is a conversation of its own;
conversations of system messages only have no participants and give no rows; other columns are ignored.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PART = 64
_END = "<|end|>\n"


def perspectives(df: DataFrame, part_turns: int = PART) -> DataFrame:
    """conv_id, perspective, part, n_messages, rendered, mask: a row for each part of each participant's view."""
    rows = df.select(
        "conv_id",
        F.when(F.col("turn").isNull(), -1 - F.pmod(F.xxhash64("text"), F.lit(1024))).otherwise(F.floor(F.col("turn") / part_turns)).cast("long").alias("part"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("unknown")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    ).distinct()
    parts = rows.groupBy("conv_id", "part").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    speakers = rows.filter("role <> 'system'").select(F.col("conv_id").alias("conv"), F.col("role").alias("perspective")).distinct()
    seen = parts.join(speakers, F.col("conv_id").eqNullSafe(F.col("conv")))

    def head(m: Column) -> Column:
        own = F.when(m.role == F.col("perspective"), "<|assistant|>\n").when(m.role == "system", "<|system|>\n")
        return own.otherwise(F.concat(F.lit("<|user:"), m.role, F.lit("|>\n")))

    def step(acc: Column, m: Column) -> Column:
        start = acc.at + F.length(head(m))
        stop = start + F.length(m.text)
        span = F.concat(start.cast("string"), F.lit("-"), (stop + len(_END) - 1).cast("string"))
        return F.struct(
            (stop + len(_END)).alias("at"),
            F.when(m.role == F.col("perspective"), F.concat(acc.spans, F.array(span))).otherwise(acc.spans).alias("spans"),
        )

    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))
    return seen.select(
        "conv_id",
        "perspective",
        "part",
        F.size("m").cast("long").alias("n_messages"),
        F.array_join(F.transform("m", lambda m: F.concat(head(m), m.text, F.lit(_END))), "").alias("rendered"),
        F.aggregate("m", none, step, lambda acc: F.array_join(acc.spans, " ")).alias("mask"),
    )
