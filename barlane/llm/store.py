"""Written tables that cut lineage, in the folder that driver and executors share."""
from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; in local mode a temporary folder is set where it is unset."""
    where = spark.conf.get(_KEY, None) or spark.sparkContext.getConf().get(_KEY, None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{_KEY} must name a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="barlane-")
        spark.conf.set(_KEY, where)
    return where.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written once as Parquet in the shared folder and read from there: its files outlive any executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/barlane/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Deletes written tables that nothing reads any more: what was made of them is written itself."""
    for df in tables:
        spark = df.sparkSession
        for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(file)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
