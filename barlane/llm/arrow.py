"""Arrow functions over batches bounded in bytes, with unused memory given back to the system.

An executor keeps its Python workers from one job to the next, so what a worker holds on to stays beside the JVM's heap.
"""
from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes of an Arrow batch that goes to a worker; a session's own setting comes first.
BATCH_BYTES = 8 << 20


def free() -> None:
    """Gives unused memory of Arrow and, where the C library can, of numpy back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def _freed(out):
    free()
    return out


def _bounded(df: DataFrame) -> None:
    conf = df.sparkSession.conf
    if conf.get(_KEY, None) is None:
        conf.set(_KEY, str(BATCH_BYTES))


def over(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """df.mapInArrow(run, schema)."""
    _bounded(df)

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            free()

    return df.mapInArrow(own, schema)


def over_groups(df: DataFrame, key: str, run: Callable[[tuple, pa.Table], pa.Table], schema: T.StructType | str) -> DataFrame:
    """run(key, rows) for the rows of each key."""
    _bounded(df)
    return df.groupBy(key).applyInArrow(lambda k, rows: _freed(run(k, rows)), schema)


def over_pairs(left: DataFrame, key: str, right: DataFrame, other: str, run: Callable[[tuple, pa.Table, pa.Table], pa.Table], schema: T.StructType | str) -> DataFrame:
    """run(key, rows of left, rows of right) for each key."""
    _bounded(left)
    return left.groupBy(key).cogroup(right.groupBy(other)).applyInArrow(lambda k, a, b: _freed(run(k, a, b)), schema)
