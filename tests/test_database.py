"""Scoring from a database and back: rounds, what is saved, and two writers of one verdict."""
import argparse
import datetime
import json
import sqlite3
import threading

import pandas as pd
import pytest
from pyspark.sql import functions as F

from barlane import cli
from barlane.operators import database

T0 = datetime.datetime(2024, 1, 1)


def at(m):
    return T0 + datetime.timedelta(minutes=m)


@pytest.fixture
def tables(spark):
    said = [
        ("m", 1, "r2", "a plain day", at(1)), ("m", 1, "r1", "old text", at(0)), ("m", 1, "r1", "a crown", at(5)), ("m", 3, "r1", "nothing", at(7)), ("m", 3, "r2", "plain too", at(8)),
        ("f", 1, "r1", "x", at(0)), ("f", 1, "r2", "y", at(1)), ("one", 1, "r1", "x", at(0)), ("gap", 1, "r1", "x", at(0)), ("gap", 1, "r2", "y", at(1)), ("gap", 2, "r2", "y", at(2)), (None, 1, "r1", "x", at(0)),
    ]
    return {
        "transcripts": spark.createDataFrame(said, "livestream_id string, round int, rapper string, text string, created timestamp"),
        "livestreams": spark.createDataFrame([("m", "night", ""), ("f", "day", "r2"), ("one", None, None), ("gap", None, "nobody")], "id string, title string, first_rapper string"),
        "brufids": spark.createDataFrame([("r1", "7"), ("r2", "bob")], "id string, owner string"),
        "accounts": spark.createDataFrame([(7, "ann", "Ann the Great"), (8, "bob", "")], "id int, username string, stage_name string"),
    }


def connect(path):
    return lambda: sqlite3.connect(path, timeout=30)


@pytest.fixture
def base(tmp_path):
    path = str(tmp_path / "own.db")
    con = sqlite3.connect(path)
    con.executescript("""
      CREATE TABLE matches (livestream_id TEXT, verdict TEXT, score1 INT, score2 INT, ai_score1 REAL, ai_score2 REAL);
      CREATE TABLE brufids (id TEXT, owner TEXT);
      CREATE TABLE accounts (id INT, username TEXT, wins INT, losses INT, bp INT, hprp REAL);
      INSERT INTO matches (livestream_id, verdict) VALUES ('m', NULL), ('f', 'there'), ('two', NULL), ('two', NULL);
      INSERT INTO brufids VALUES ('r1', '7'), ('r2', 'bob');
      INSERT INTO accounts VALUES (7, 'ann', NULL, 1, 2, NULL), (8, 'bob', 3, 4, NULL, 100.5);
    """)
    con.close()
    return path


def rows(path, sql):
    with sqlite3.connect(path) as con:
        return con.execute(sql).fetchall()


def verdicts(spark, *matches):
    rounds = [(1, "A", 4.25, 0.0), (2, "tie", 1.0, 1.0)]
    own = [(m, 1.5, 0.5, rounds, json.dumps({"match_id": m}), "r1", "r2") for m in matches]
    return database.states(spark.createDataFrame(own, "match_id string, a_wins double, b_wins double, rounds array<struct<round: int, winner: string, score_a: double, score_b: double>>, document string, rapper_a string, rapper_b string"))


def test_rounds_of_livestreams(tables):
    got = {(r.match_id, r.round): r for r in database.rounds(*tables.values()).collect()}
    assert set(got) == {("m", 1), ("m", 2), ("f", 1), ("one", 1), ("gap", 1), ("gap", 2)}
    m = got["m", 1]
    assert (m.a, m.b, m.battler_a, m.battler_b, m.rapper_a, m.error) == ("a plain day", "a crown", "bob", "Ann the Great", "r2", None)
    assert (got["m", 2].a, got["m", 2].b) == ("plain too", "nothing")
    assert (got["f", 1].rapper_a, got["f", 1].a) == ("r2", "y")
    assert got["one", 1].error == "Round 1 incomplete: only 1 row(s)"
    assert got["gap", 1].error == got["gap", 2].error == "Round 2 incomplete: missing A"
    assert [r.livestream_id for r in database.listed(tables["transcripts"], tables["livestreams"]).collect()][0] == "m"


def test_save_once_with_accounts(spark, base):
    done = verdicts(spark, "m", "f", "two", "none")
    for first in (True, False):
        got = {r.match_id: r.action for r in database.save(done, connect(base), writers=2).collect()}
        assert got == {"m": "score" if first else "skip", "f": "skip", "two": "refuse", "none": "missing"}
        assert rows(base, "SELECT score1, score2, ai_score1, ai_score2, verdict FROM matches WHERE livestream_id = 'm'") == [(2, 0, 5.25, 1.0, '{"match_id": "m"}')]
        assert rows(base, "SELECT * FROM accounts ORDER BY id") == [(7, "ann", 1, 1, 4, 94.25), (8, "bob", 3, 5, 0, 96.25)]
    got = {r.match_id: r.action for r in database.save(done, connect(base), force=True, writers=2).collect()}
    assert got == {"m": "overwrite", "f": "overwrite", "two": "refuse", "none": "missing"}
    assert rows(base, "SELECT verdict FROM matches WHERE livestream_id = 'f'") == [('{"match_id": "f"}',)]
    assert rows(base, "SELECT wins, losses, bp FROM accounts ORDER BY id") == [(1, 1, 4), (3, 5, 0)]


def test_account_updates_may_be_left_out(spark, base):
    database.save(verdicts(spark, "m"), connect(base), update_accounts=False)
    assert rows(base, "SELECT wins FROM accounts ORDER BY id") == [(None,), (3,)]
    assert rows(base, "SELECT score1 FROM matches WHERE livestream_id = 'm'") == [(2,)]


def test_of_two_writers_one_wins(base):
    row = {"match_id": "m", "score1": 1, "score2": 0, "ai_score1": 1.0, "ai_score2": 0.0, "rapper_a": "r1", "rapper_b": "r2", "won_a": True, "won_b": False, "bp_a": 1, "bp_b": 0, "hprp_a": 1.0, "hprp_b": -1.0}
    start, got = threading.Barrier(6), []

    def write(k):
        con = sqlite3.connect(base, timeout=30)
        start.wait()
        got.append(database._one(con, {**row, "document": str(k)}, "?", False, True))
        con.close()

    threads = [threading.Thread(target=write, args=(k,)) for k in range(6)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(got) == ["score"] + ["skip"] * 5
    assert rows(base, "SELECT wins, bp FROM accounts WHERE id = 7") == [(1, 3)]


def test_from_transcripts_to_saved_verdicts(spark, tables, base, capsys):
    def ask(prompts: pd.Series) -> pd.Series:
        return pd.Series(['{"semantic_detections": [{"skill_id": "SD", "points": 4.25, "direction": "positive", "lines": ["crown"]}]}' if "crown" in p.split("\n\n")[-1] else "{}" for p in prompts])

    a = argparse.Namespace(tie_threshold=0.75, store=None, save=True, force=False, skip_account_updates=False, mark="?")
    assert cli.scored({k: v.filter(F.col("livestream_id").isin("m", "one")) if k == "transcripts" else v for k, v in tables.items()}, a, ask, connect(base)) == 1
    out = [json.loads(x) for x in capsys.readouterr().out.replace("}\n{", "}\x00{").split("\x00")]
    said = {d["match_id"]: d for d in out}
    assert said["one"]["status"] == "error" and said["one"]["error"] == "Round 1 incomplete: only 1 row(s)"
    m = said["m"]
    assert (m["schema_version"], m["summary"], m["battler_b"], len(m["rounds"])) == (1, "Ann the Great wins 1.5-0.5", "Ann the Great", 2)
    assert m["rounds"][0]["detail_b"]["total_score"] == 4.25 and m["rounds"][0]["detail_b"]["battler"] == "B" and m["rounds"][0]["winner"] == "B"
    assert json.loads(rows(base, "SELECT verdict FROM matches WHERE livestream_id = 'm'")[0][0]) == m
    assert rows(base, "SELECT wins, bp, hprp FROM accounts WHERE id = 7") == [(1, 4, 94.25)]
