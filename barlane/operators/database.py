"""Matches in a database: from transcripts to rounds, and verdicts with account updates written back, once each.

`rounds` is a plan over the tables, for all livestreams at once. `save` writes from the executors: verdicts are dealt by
livestream into a bounded number of partitions, each with one connection, and each verdict is one transaction. It begins
with an update that changes the match only if it has no verdict yet and is the only one of its livestream; whether a row was
changed decides, so of two writers one wins, and a task that is tried again finds its verdicts there and leaves accounts alone.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Connections that write at once.
WRITERS = 8
#: Fixed value: what an account without head-to-head points starts from.
START = 90.0
_FIELDS = ("score1", "score2", "ai_score1", "ai_score2", "verdict")


def rounds(transcripts: DataFrame, livestreams: DataFrame, brufids: DataFrame, accounts: DataFrame) -> DataFrame:
    """match_id, round (from 1), a, b, battler_a, battler_b, rapper_a, rapper_b, error: the rounds of each livestream.

    transcripts: livestream_id, round, rapper, text, created; livestreams: id, first_rapper; brufids: id, owner; accounts:
    id, username, stage_name. The newest text of a rapper in a round counts. Side A is the livestream's first rapper if
    they are in round 1, else who was first there; B is the next one. error tells why a livestream can't be scored; then all
    its rows have it.
    """
    newest = Window.partitionBy("livestream_id", "round", "rapper").orderBy(F.desc("created"), F.desc("text"))
    texts = transcripts.dropna(subset=["livestream_id", "round", "rapper"]).withColumn("_k", F.row_number().over(newest)).filter("_k = 1").drop("_k")
    opening = texts.filter("round = 1").groupBy("livestream_id").agg(F.array_sort(F.collect_list(F.struct("created", "rapper"))).alias("o"))
    first = livestreams.select(F.col("id").alias("livestream_id"), F.nullif("first_rapper", F.lit("")).alias("named"))
    sides = opening.join(first, "livestream_id", "left").withColumn("a", F.when(F.array_contains("o.rapper", F.col("named")), F.col("named")).otherwise(F.element_at("o.rapper", 1)))
    sides = sides.select("livestream_id", F.col("a").alias("rapper_a"), F.try_element_at(F.filter("o.rapper", lambda r: r != F.col("a")), F.lit(1)).alias("rapper_b"), F.size("o").alias("n_open"))
    own = texts.join(sides, "livestream_id", "left")
    mine = F.col("rapper") == F.col("rapper_a")
    per = own.groupBy("livestream_id", "round").agg(
        *(F.first(c).alias(c) for c in ("rapper_a", "rapper_b", "n_open")), F.max(F.when(mine, F.col("text"))).alias("a"),
        F.max_by(F.when(~mine, F.col("text")), F.when(~mine, F.col("created"))).alias("b"),
    )
    lacks = F.when(F.coalesce("n_open", F.lit(0)) < 2, F.concat(F.lit("Round 1 incomplete: only "), F.coalesce("n_open", F.lit(0)), F.lit(" row(s)")))
    lacks = lacks.when(F.col("a").isNull() | F.col("b").isNull(), F.concat(F.lit("Round "), "round", F.lit(" incomplete: missing "), F.when(F.col("a").isNull(), "A").otherwise("B")))
    whole = Window.partitionBy("livestream_id")
    per = per.withColumn("error", F.min_by(lacks, F.when(lacks.isNotNull(), F.col("round"))).over(whole)).withColumn("round", F.row_number().over(whole.orderBy("round")))
    kept = lambda c: F.nullif(F.col(c), F.lit(""))
    names = brufids.select(F.col("id").alias("_b"), "owner").join(accounts.select(F.col("id").cast("string").alias("owner"), "stage_name", "username"), "owner", "left")
    names = names.select("_b", F.coalesce(kept("stage_name"), kept("username"), kept("owner"), "_b").alias("_n")).groupBy("_b").agg(F.min("_n").alias("_n"))
    for s in "ab":
        per = per.join(names.withColumnsRenamed({"_b": f"rapper_{s}", "_n": f"battler_{s}"}), f"rapper_{s}", "left").withColumn(f"battler_{s}", F.coalesce(f"battler_{s}", f"rapper_{s}"))
    return per.select(F.col("livestream_id").alias("match_id"), "round", "a", "b", "battler_a", "battler_b", "rapper_a", "rapper_b", "error")


def listed(transcripts: DataFrame, livestreams: DataFrame) -> DataFrame:
    """Livestreams that have transcripts, the latest first: livestream_id, title, rows, first, last."""
    names = livestreams.select(F.col("id").alias("livestream_id"), "title")
    return transcripts.join(names, "livestream_id").groupBy("livestream_id", "title").agg(F.count("*").alias("rows"), F.min("created").alias("first"), F.max("created").alias("last")).orderBy(F.desc("last"), "livestream_id")


def states(verdicts: DataFrame) -> DataFrame:
    """What a match and its accounts get of verdicts (match_id, a_wins, b_wins, rounds: round, winner, score_a, score_b; document).

    Adds score1, score2 (rounds won, ties to A's favour), ai_score1, ai_score2, and of each side bp, won and hprp.
    """
    ahead = F.col("a_wins") >= F.col("b_wins")
    up, down = (lambda c: F.ceil(F.col(c)).cast("int")), (lambda c: F.floor(F.col(c)).cast("int"))
    sums = lambda f: F.round(F.aggregate("rounds", F.lit(0.0), lambda acc, r: acc + f(r)), 2)
    diff = lambda r: F.round(F.abs(r.score_a - r.score_b), 2)
    gain = sums(lambda r: F.when(r.winner == "A", diff(r)).when(r.winner == "B", -diff(r)).otherwise(0.0))
    got = verdicts.withColumns({"score1": F.when(ahead, up("a_wins")).otherwise(down("a_wins")), "score2": F.when(ahead, down("b_wins")).otherwise(up("b_wins"))})
    got = got.withColumns({"ai_score1": sums(lambda r: r.score_a), "ai_score2": sums(lambda r: r.score_b), "won_a": ahead, "won_b": ~ahead, "hprp_a": gain, "hprp_b": -gain})
    return got.withColumns({"bp_a": F.col("score1"), "bp_b": F.col("score2")})


def _one(conn, row: dict, mark: str, force: bool, accounts: bool) -> str:
    """One verdict in one transaction; what was done."""
    cur = conn.cursor()
    values = [row[c] for c in ("score1", "score2", "ai_score1", "ai_score2", "document")]
    put = "UPDATE matches SET " + ", ".join(f"{c} = {mark}" for c in _FIELDS) + f" WHERE livestream_id = {mark}"
    alone = f" AND (SELECT count(*) FROM matches AS m WHERE m.livestream_id = {mark}) = 1"
    match = row["match_id"]
    cur.execute(f"{put} AND (verdict IS NULL OR verdict = ''){alone}", [*values, match, match])
    action = "score" if cur.rowcount == 1 else None
    if action is None:
        cur.execute(f"SELECT count(*) FROM matches WHERE livestream_id = {mark}", [match])
        n = cur.fetchone()[0]
        action = "missing" if not n else "refuse" if n > 1 else "overwrite" if force else "skip"
        if action == "overwrite":
            cur.execute(put + alone, [*values, match, match])
    if action == "score" and accounts and row["rapper_a"] and row["rapper_b"]:
        for s in "ab":
            record = "wins" if row[f"won_{s}"] else "losses"
            cur.execute(
                f"UPDATE accounts SET {record} = COALESCE({record}, 0) + 1, bp = COALESCE(bp, 0) + {mark}, hprp = ROUND(COALESCE(hprp, {START}) + {mark}, 2) "
                f"WHERE EXISTS (SELECT 1 FROM brufids AS b WHERE b.id = {mark} AND b.owner IN (CAST(accounts.id AS TEXT), accounts.username))",
                [row[f"bp_{s}"], row[f"hprp_{s}"], row[f"rapper_{s}"]],
            )
    conn.commit()
    return action


def save(done: DataFrame, connect: Callable[[], object], force: bool = False, update_accounts: bool = True, mark: str = "?", writers: int = WRITERS) -> DataFrame:
    """Writes verdicts back and returns match_id and action of each, which it has done by then.

    done: `states` of verdicts with rapper_a and rapper_b. connect: opens a connection (Python's DB-API) in an executor;
    mark: how its driver writes a parameter. action is score, overwrite, skip, refuse (more than one match) or missing;
    accounts change with score alone.
    """
    columns = ["match_id", "document", "score1", "score2", "ai_score1", "ai_score2", "rapper_a", "rapper_b", *(f"{c}_{s}" for c in ("won", "bp", "hprp") for s in "ab")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        conn = None
        try:
            for frame in frames:
                conn = conn or connect()
                rows = frame.astype(object).where(frame.notna(), None).to_dict("records")
                yield pd.DataFrame({"match_id": frame["match_id"], "action": [_one(conn, r, mark, force, update_accounts) for r in rows]})
        finally:
            if conn is not None:
                conn.close()

    wrote = done.select(*columns).repartition(writers, "match_id").mapInPandas(run, "match_id string, action string")
    return done.sparkSession.createDataFrame(wrote.toArrow())  # two short strings a verdict; the writing has happened
