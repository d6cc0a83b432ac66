"""The streaming scorer: verdicts exactly once, whatever breaks off in the middle of a batch."""
import pytest

from barlane.streaming import completeness, scorer

SCHEMA = "match_id long, round int, side string, text string, created timestamp, total_rounds int"


def put(spark, folder, k, *rows):
    plain = spark.createDataFrame([(m, r, s, t, f"2024-01-{d:02} 00:00:00", n) for m, r, s, t, d, n in rows], SCHEMA.replace("timestamp", "string"))
    plain.selectExpr("match_id", "round", "side", "text", "CAST(created AS timestamp) AS created", "total_rounds").write.parquet(f"{folder}/{k}")


def test_restart_in_the_middle_of_a_batch(spark, tmp_path):
    seen, broken = str(tmp_path / "in"), []

    def score(rounds):
        if not broken:  # breaks off after a part of the batch was written
            broken.append(rounds.count())
            rounds.limit(1).write.parquet(str(tmp_path / "out" / f"batch={broken[0] * 0}"))
            raise RuntimeError("lost")
        return scorer.by_rules(rounds)

    def run():
        stream = spark.readStream.schema(SCHEMA).parquet(f"{seen}/*")
        scorer.verdicts(stream, str(tmp_path / "out"), str(tmp_path / "state"), score).awaitTermination()

    put(spark, seen, 0, (1, 1, "A", "crossed the line and got ejected", 1, 1), (1, 1, "B", "a plain day", 1, 1), (2, 1, "A", "x", 1, 2), (2, 1, "B", "y", 1, 2), (2, 2, "A", "z", 1, 2), (3, 1, "A", "alone", 1, 1))
    with pytest.raises(Exception):
        run()
    assert broken == [1]
    run()
    assert [(r.match_id, r.winner) for r in scorer.read(spark, str(tmp_path / "out")).collect()] == [(1, "B")]
    put(spark, seen, 1, (1, 1, "A", "late", 2, 1), (2, 2, "B", "w", 2, 2), (2, 1, "A", "older than what is there", 1, 2))
    run()
    got = sorted((r.match_id, r.n_rounds, r.batch) for r in scorer.read(spark, str(tmp_path / "out")).collect())
    assert [g[:2] for g in got] == [(1, 1), (2, 2)] and got[0][2] == 0 < got[1][2]
    put(spark, seen, 2, (1, 1, "B", "again", 3, 1), (2, 1, "B", "again", 3, 2))
    run()
    assert scorer.read(spark, str(tmp_path / "out")).count() == 2


def test_old_matches_are_forgotten(spark, tmp_path):
    stream = completeness.complete_matches(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in" / "*")))

    def run():
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()
        return q

    put(spark, tmp_path / "in", 0, (1, 1, "A", "first", 1, 1))
    run()
    put(spark, tmp_path / "in", 1, (9, 1, "A", "much later", 25, 1))
    q = run()
    assert q.recentProgress[-1]["stateOperators"][0]["numRowsTotal"] > 0
    put(spark, tmp_path / "in", 2, (9, 1, "B", "answer", 26, 1))
    run()
    assert {(r.match_id, r.text) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {(9, "much later"), (9, "answer")}
