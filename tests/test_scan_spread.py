"""A scan is the work of many tasks, also for one long match, and patterns are ruled out by all the texts that they need."""
import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from barlane import rules
from barlane.functions import literals
from barlane.functions.dialect import Spark
from barlane.plans import queries
from barlane.plans.phrases import OPENERS, PHRASES

SF = "/root/testdata/sf0.01"


def test_one_long_match_is_the_work_of_several_tasks(spark, tmp_path):
    turns = spark.read.parquet(f"{SF}/conversations.parquet").where("role IN ('user', 'assistant')")
    turns = turns.withColumn("turn", F.row_number().over(Window.orderBy("conv_id", "turn")).cast("long")).withColumn("conv_id", F.lit(8).cast("long"))
    turns.coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    rows = queries.QUERIES["scan_total"](spark, str(tmp_path)).withColumn("task", F.spark_partition_id()).collect()
    assert len(rows) == turns.count()
    assert len({r.task for r in rows}) > 1


def test_a_pattern_needs_one_of_every_set():
    assert literals.required_each(r"\byou\s+(?:said|call)\s+(?:io|me)\b") == (("call", "said"), ("you",), ("io", "me"))
    assert literals.required_each(r"(?:abc|d)ef(?:gh)?") == (("ef",),)
    assert literals.required_each(r"(?i)abc") == literals.required_each(r"\w+") == ()


def test_no_set_rules_out_a_match():
    texts = [*PHRASES, *OPENERS, " ".join(PHRASES)]
    for p in {p for groups in rules.GROUPS.values() for g in groups for p in g.patterns}:
        for t in (t for t in texts if re.search(p, t)):
            assert all(any(x in t for x in s) for s in literals.required_each(p)), (p, t)


def test_words_are_the_pieces_between_blanks(spark):
    texts = [" a  b c　", "", " \x1c\x1f\t", "x\u0085y\x1dz", "İ ΣΑΣ\n\U0001F600"]
    df = spark.createDataFrame([(t,) for t in texts], "x string")
    old = Spark().where(Spark().split("x", r"[\s\x1c-\x1f]+"), "wd", "wd <> ''")
    for new, was in df.selectExpr(Spark().words("x"), old).collect():
        assert new == was
