"""The pipeline's stages one by one on a small table."""
import pytest
from pyspark.sql import functions as F

import corpus_pipeline

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_stages_keep_the_columns(spark, docs):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "substring_dedup", "packing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.dtypes == docs.dtypes
        assert 0 < out.count() <= docs.count()


def test_near_stage_keeps_one_of_each_text(spark, docs):
    kept = corpus_pipeline.dedup_near(spark, docs, SF)
    long = kept.filter(F.size(F.split("text", " ")) > 10)
    assert long.count() == long.select("text").distinct().count()


def test_run_packs_what_is_left(spark):
    got = corpus_pipeline.run(spark, SF)
    pieces = got.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n").alias("n"), F.count("*").alias("c"), F.sum((F.col("n") < 1024).cast("int")).alias("short")).first()
    assert pieces.n <= 1024 and pieces.c > 10 and pieces.short <= 1
