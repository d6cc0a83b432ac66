"""Line deduplication over overlapping windows of three lines.

Texts are cut at line feeds. Each window of three consecutive lines that holds a word is hashed to 128 bits; of windows
that are equal anywhere, the one with the smallest (doc_id, hash of text, line) stays, and the lines that the others
cover, taken together, are removed.

Defined results: texts of fewer than three lines, null texts and rows with a null doc_id are left alone and take no part;
repeated rows (same doc_id and text) count as one and have the same result; a text all of whose lines go becomes empty;
an empty table stays empty; extra columns are carried along, those named
n_lines or n_removed are replaced.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH = 3


def deduplicated(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """docs with the lines removed from text, and n_lines and n_removed (long)."""
    docs = docs.drop("n_lines", "n_removed")
    keyed = docs.withColumn("__th", F.xxhash64("text"))
    cut = keyed.filter("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "__th", F.split("text", "\n", -1).alias("__l"))
    at = F.explode(F.when(F.size("__l") >= width, F.sequence(F.lit(1), F.size("__l") - (width - 1)))).alias("__p")
    joined = F.concat_ws("\n", F.slice("__l", F.col("__p"), width))
    windows = (
        cut.select("doc_id", "__th", "__l", at)
        .select("doc_id", "__th", "__p", joined.alias("__w"))
        .filter(F.col("__w").rlike(r"[^\x20\x09-\x0D]"))
        .select("doc_id", "__th", "__p", F.xxhash64("__w").alias("__a"), F.xxhash64(F.lit(1), F.col("__w")).alias("__b"))
    )
    place = F.struct("doc_id", "__th", "__p")
    first = windows.groupBy("__a", "__b").agg(F.min(place).alias("__f"), F.max(place).alias("__z")).filter("__f <> __z").drop("__z")
    later = windows.join(first, ["__a", "__b"]).filter(place != F.col("__f"))
    gone = later.groupBy("doc_id", "__th").agg(F.collect_set("__p").alias("__g"))
    covered = F.array_distinct(F.flatten(F.transform("__g", lambda p: F.sequence(p, p + (width - 1)))))
    joined = keyed.join(gone, ["doc_id", "__th"], "left").withColumn("__l", F.split("text", "\n", -1)).withColumn("__c", covered)
    stay = F.array_except(F.sequence(F.lit(1), F.size("__l")), F.col("__c"))
    text = F.when(F.col("__c").isNull(), F.col("text")).otherwise(F.array_join(F.transform(stay, lambda i: F.element_at("__l", i)), "\n"))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size("__l")).cast("long")
    n_gone = F.when(F.col("__c").isNull(), 0).otherwise(F.size("__c")).cast("long")
    return joined.select(*(text.alias(c) if c == "text" else F.col(c) for c in docs.columns), n_lines.alias("n_lines"), n_gone.alias("n_removed"))
