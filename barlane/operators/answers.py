"""A store of a judge's answers: every distinct prompt is asked once in the whole cluster, and never again.

`fill` takes prompts, leaves out those whose answers are known, and deals the rest, each key once, into lanes. A lane is one
partition: it asks its keys one after another, at its share of the rate that the cluster may ask with, and puts answers
aside in the store's folder as they come, a few at a time. A task that is tried again begins with what its lane has put aside,
so it doesn't ask for these again. When all lanes are through, what they put aside is appended to the store in one commit.
Reading takes both, so answers survive a driver that is lost between the two.

A lane that is refused tells all others by a note in the folder until when to wait. A prompt for which the judge fails has
an error instead of an answer and is asked again the next time; it doesn't fail the others.

The folder may be in any file system that pyarrow opens by its address. Two tasks must not work on one lane at a time, so
speculative execution has to be off.
"""
from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import judge

SCHEMA = "cache_key STRING, content STRING, error STRING"
_ARROW = pa.schema([("cache_key", pa.string()), ("content", pa.string()), ("error", pa.string())])
#: Partitions that ask at once, and answers that a lane puts aside together.
LANES, FLUSH = 8, 8


def prompt_key(prompt: Column, model: str = "", system: str = "") -> Column:
    """The key of a prompt: a hash of model, system prompt and prompt, divided by zero bytes."""
    return F.md5(F.concat(F.lit(f"{model}\0{system}\0"), prompt))


class _Aside:
    """A lane's answers in the folder, and the notes by which lanes tell one another to wait."""

    def __init__(self, folder: str, lane: int):
        self.files, root = fs.FileSystem.from_uri(folder)
        self.own, self.notes = f"{root}/aside/lane={lane}", f"{root}/wait"

    def known(self) -> pa.Table:
        found = [f.path for f in self.files.get_file_info(fs.FileSelector(self.own, allow_not_found=True)) if f.base_name.startswith("part-")]
        return pa.concat_tables([pq.read_table(p, filesystem=self.files, schema=_ARROW) for p in found]) if found else _ARROW.empty_table()

    def put(self, rows: list[tuple]) -> None:
        """Adds answers; a file gets the name under which it is read once it is whole."""
        self.files.create_dir(self.own)
        name = uuid.uuid4().hex
        pq.write_table(pa.table([pa.array(c, pa.string()) for c in zip(*rows)], schema=_ARROW), f"{self.own}/new-{name}", filesystem=self.files)
        self.files.move(f"{self.own}/new-{name}", f"{self.own}/part-{name}.parquet")

    def wait_until(self) -> float:
        """The latest time that some lane told the others to wait for."""
        return max((float(f.base_name) for f in self.files.get_file_info(fs.FileSelector(self.notes, allow_not_found=True))), default=0.0)

    def tell(self, until: float) -> None:
        self.files.create_dir(self.notes)
        with self.files.open_output_stream(f"{self.notes}/{until:.3f}"):
            pass


def _lane(folder: str, ask: Callable[[pd.Series], pd.Series], every: float, flush: int, attempts: int) -> Callable:
    """Asks one partition's prompts, `every` seconds apart at least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aside, done, due = None, {}, 0.0
        new: list[tuple] = []
        for batch in batches:
            lanes, keys, prompts = (batch.column(c).to_pylist() for c in ("lane", "cache_key", "prompt"))
            for lane, key, prompt in zip(lanes, keys, prompts):
                if aside is None:
                    aside = _Aside(folder, lane)
                    done = dict.fromkeys(aside.known()["cache_key"].to_pylist())
                if key in done:
                    continue
                for k in range(attempts):
                    time.sleep(max(0.0, due - time.time(), aside.wait_until() - time.time()))
                    due = time.time() + every
                    try:
                        new.append((key, ask(pd.Series([prompt])).iloc[0], None))
                        break
                    except judge.Refused as e:
                        aside.tell(time.time() + judge.wait_for(str(e), k))
                        if k == attempts - 1:
                            new.append((key, None, f"refused {attempts} times"))
                    except judge.JudgeError as e:
                        new.append((key, None, str(e)[:500]))
                        break
                if len(new) >= flush:
                    aside.put(new)
                    new = []
        if new:
            aside.put(new)
        yield pa.RecordBatch.from_arrays([pa.array([len(done)], pa.int64())], names=["known"])

    return run


def read(spark: SparkSession, folder: str) -> DataFrame:
    """cache_key, content of all answers in the store, each key once; also those that a run that broke off put aside."""
    parts = []
    for path in (f"{folder}/answers", f"{folder}/aside/*"):
        try:
            parts.append(spark.read.schema(SCHEMA).parquet(path))
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
    known = spark.createDataFrame([], SCHEMA) if not parts else parts[0] if len(parts) == 1 else parts[0].unionAll(parts[1])
    return known.filter("content IS NOT NULL").groupBy("cache_key").agg(F.min("content").alias("content"))


def commit(spark: SparkSession, folder: str) -> None:
    """Appends what was put aside to the store, those keys that it lacks, and clears it."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    if files.exists(path(f"{folder}/aside")):
        new = spark.read.schema(SCHEMA).parquet(f"{folder}/aside/*").filter("content IS NOT NULL").dropDuplicates(["cache_key"])
        if files.exists(path(f"{folder}/answers")):
            new = new.join(spark.read.schema(SCHEMA).parquet(f"{folder}/answers").select("cache_key"), "cache_key", "left_anti")
        new.write.mode("append").parquet(f"{folder}/answers")
    for done in ("aside", "wait"):
        files.delete(path(f"{folder}/{done}"), True)


def fill(
    prompts: DataFrame, folder: str, ask: Callable[[pd.Series], pd.Series], prompt: str = "prompt", model: str = "", system: str = "",
    lanes: int = LANES, per_second: float | None = None, flush: int = FLUSH, attempts: int = judge.ATTEMPTS,
) -> DataFrame:
    """Asks for all prompts (a column of that name; null ones have no answer) that the store lacks, and returns the store.

    per_second: calls that the whole cluster may make, None for no limit; every lane keeps to its share of it.
    """
    spark = prompts.sparkSession
    commit(spark, folder)  # of a run that broke off
    asked = prompts.select(prompt_key(F.col(prompt), model, system).alias("cache_key"), F.col(prompt).alias("prompt")).filter("prompt IS NOT NULL")
    asked = asked.join(read(spark, folder).select("cache_key"), "cache_key", "left_anti").dropDuplicates(["cache_key"])
    lane = F.pmod(F.xxhash64("cache_key"), F.lit(lanes)).cast("int").alias("lane")
    # One partition for each lane, by range: a lane's keys never share a task with another lane's unless both are in it.
    dealt = asked.select(lane, "cache_key", "prompt").repartitionByRange(lanes, "lane").sortWithinPartitions("lane", "cache_key")
    run = _lane(folder, ask, lanes / per_second if per_second else 0.0, flush, attempts)
    dealt.mapInArrow(run, "known bigint").agg(F.count("*")).collect()  # one number
    commit(spark, folder)
    return read(spark, folder)
