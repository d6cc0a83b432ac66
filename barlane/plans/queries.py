"""Every query by name, run by Spark over the tables of a folder, and the SQL that checks it."""
from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions.dialect import Duck, Spark
from ..functions.similarity import register
from ..operators import judge, scoring
from . import sqls


def session(spark: SparkSession) -> SparkSession:
    """A session with the settings of `spark` and our functions, in which filters aren't inferred from constraints.

    Spark keeps a constraint for each column that is computed from columns which stay, and compares them all pair by pair;
    with the hundreds of tests of a scan that takes minutes and gigabytes as soon as a join or filter stands above it.
    """
    own = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if key.startswith("spark.sql.") and own.conf.get(key, None) != value and own.conf.isModifiable(key):
            own.conf.set(key, value)
    own.conf.set("spark.sql.constraintPropagation.enabled", "false")
    own.conf.set("spark.sql.analyzer.maxIterations", "500")  # the composed paths have many layers
    # A scan takes some milliseconds of a core for each performance, so a task of one megabyte is a large one.
    own.conf.set("spark.sql.adaptive.coalescePartitions.minPartitionSize", "32k")
    own.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1m")
    register(own)
    judge.register(own)
    return own


def view(spark: SparkSession, sf_dir: str, table: str) -> str:
    """The name of a view of one table of a folder."""
    name = f"barlane_{table}_{hashlib.md5(sf_dir.encode()).hexdigest()[:8]}"
    spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(name)
    return name


def run(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    own = session(spark)
    return own.sql(re.sub(r"@(\w+)@", lambda m: view(own, sf_dir, m[1]), sql))


def _of(make: Callable[[Spark], str]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: run(spark, sf_dir, make(Spark()))


QUERIES = {name: _of(make) for name, make in sqls.Q.items()}
SQL = {name: re.sub(r"@(\w+)@", r"\1", make(Duck())).replace("WITH ", "WITH RECURSIVE ", 1) for name, make in sqls.Q.items()}
def _with(f: Callable) -> Callable[[SparkSession, str], DataFrame]:
    """A query made of several statements, in one session."""

    def go(spark: SparkSession, sf_dir: str) -> DataFrame:
        own = session(spark)
        return f(lambda sql: own.sql(re.sub(r"@(\w+)@", lambda m: view(own, sf_dir, m[1]), sql)))

    return go


QUERIES |= {name: _with(f) for name, f in scoring.QUERIES.items()}

