"""Documents dealt into chunks of about equal size, for work that looks up corpus-wide facts chunk by chunk."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK_BYTES = 8 << 20


def chunked(docs: DataFrame, size: int = CHUNK_BYTES, name: str = "chunk") -> DataFrame:
    """docs with the column `name` (long), its chunk: the same rows get the same chunk; their number follows the bytes of text.

    What reads this by groupBy(name) more than once in one plan shares one exchange of the texts.
    """
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return docs.withColumn(name, F.pmod(F.xxhash64("doc_id", "text"), F.lit(max(1, -(-total // size)))))
