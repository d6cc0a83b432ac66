"""Detectors, text operators, windows, reconciliation and streaming on small inputs."""
import duckdb
import pytest

import __spark_entry__
from barlane import api, registry
from barlane.functions import similarity
from barlane.functions.dialect import Spark
from barlane.operators import scoring
from barlane.plans import queries, reconcile
from barlane.sources import files

SF = "/root/testdata/sf0.001"


def perf(spark, *texts):
    return spark.createDataFrame([(1, i + 1, "A", t) for i, t in enumerate(texts)], "match_id long, round int, side string, text string")


def found(spark, *texts):
    return {(r.round, r.skill_id) for r in api.scan(perf(spark, *texts)).collect()}


def test_minimal_and_just_below_marks(spark):
    got = found(
        spark,
        "um wait",  # two stumbles
        "um here",  # one
        "crossed the line and got ejected",
        "crossed the line",
        "pick one two three\nthis line comes back again now\nthis line comes back again now",
        "",
        "let's talk about you behind the mask",
    )
    assert {(1, "TVL"), (3, "BV"), (5, "DD"), (7, "PM")} <= got
    assert not {(2, "TVL"), (4, "BV"), (6, "TVL")} & got


def test_windows_cover_all_lines(spark):
    for n, count in ((0, 0), (1, 1), (10, 1), (11, 2), (17, 2), (18, 3), (150, 21)):
        rows = api.windows(perf(spark, "\n".join(f"line {i}" for i in range(n)))).collect()
        assert len(rows) == count
        assert sorted({i for r in rows for i in range(r.start, r.stop + 1)}) == list(range(n))


def test_every_detector_meets_firing_and_silent_texts(spark):
    sql = queries.QUERIES["scan_detect"](spark, "/root/testdata/sf0.01")
    seen = {r.skill_id for r in sql.select("skill_id").distinct().collect()}
    assert len(seen) >= 25
    assert sql.count() > 0


@pytest.mark.parametrize("name", ["text_norm", "lines_explode", "ogr_block", "det_steal", "det_travel", "scan_total", "match_verdict", "hard_gates", "line_ownership", "latest_transcript", "account_next_state"])
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("conversations", "events", "orders", "customer", "documents"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    mine, theirs = queries.QUERIES[name](spark, SF), con.sql(queries.SQL[name])
    columns = sorted(mine.columns)
    assert columns == sorted(theirs.columns)
    left = sorted(map(repr, mine.select(columns).collect()))
    right = theirs.select(*(duckdb.ColumnExpression(c) for c in columns)).fetchall()
    assert len(left) == len(right) > 0
    norm = lambda v: round(v, 6) if isinstance(v, float) else v
    assert sorted(repr(tuple(map(norm, r))) for r in mine.select(columns).collect()) == sorted(repr(tuple(map(norm, r))) for r in right)


def test_similarity():
    assert similarity.repeats(["one two three four five", "one two three four five"])[0] == pytest.approx(0.80)
    assert similarity.repeats(["one two three four", "one two three four"])[0] == pytest.approx(0.45)
    assert similarity.lines_similar(["Short"], ["a short line"])
    assert not similarity.lines_similar([""], ["x"])


def test_caps_grow_with_lines(spark):
    cap = lambda skill, n: spark.sql(f"SELECT {reconcile.cap(Spark(), 'skill', 'n')} AS c FROM VALUES ('{skill}', {n}) AS v(skill, n)").first().c
    assert [cap("AND1", n) for n in (30, 45, 59, 78, 113, 500)] == [2, 2, 3, 4, 6, 6]
    assert cap("FCS", 500) == 1 and cap("DD", 10) == registry.NO_CAP


def test_json_recovery():
    assert scoring.recovered('```json\n{"a": 1}\n```') == '{"a": 1}'
    assert scoring.recovered("x {“a”: “b”} y") == '{"a": "b"}'
    assert '"error"' in scoring.recovered('{"a": "bro')


def test_payloads_and_errors(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"match_id": "m", "battler_a": "x", "battler_b": "y", "rounds": [{"a": "um wait", "b": "clean here"}]}')
    payload = files.payloads(spark, str(tmp_path / "p.json"))
    assert files.rejects(payload).count() == 0
    rows = api.match_verdicts(files.performances(payload)).collect()
    assert [(r.winner, r.summary) for r in rows] == [("B", "B wins 1-0")]
    (tmp_path / "q.json").write_text('{"match_id": "m", "rounds": [{"a": "x", "b": " "}]}')
    assert files.rejects(files.payloads(spark, str(tmp_path / "q.json"))).count() == 1


def test_stream_emits_complete_matches_once(spark, tmp_path):
    from barlane.streaming.completeness import complete_matches

    schema = "match_id long, round int, side string, text string, created timestamp, total_rounds int"
    rows = [(1, 1, "A", "old", "2024-01-01 00:00:00", 1), (1, 1, "A", "new", "2024-01-01 00:01:00", 1), (1, 1, "B", "b", "2024-01-01 00:02:00", 1), (2, 1, "A", "a", "2024-01-01 00:00:00", 1)]
    spark.createDataFrame(rows, schema.replace("timestamp", "string")).selectExpr("match_id", "round", "side", "text", "CAST(created AS timestamp) AS created", "total_rounds").write.parquet(str(tmp_path / "in"))
    out = complete_matches(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    q = out.writeStream.format("memory").queryName("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.match_id, r.side, r.text) for r in spark.table("complete").collect()} == {(1, "A", "new"), (1, "B", "b")}


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
