"""python -m barlane.cli: list skills, scan a transcript, score its lines, or score match payloads."""
from __future__ import annotations

import argparse
import importlib
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import api
from .operators import database
from .operators.judge import JudgeError
from .registry import NEGATIVE, POSITIVE, SKILLS, TIE
from .sources import files


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="barlane")
    p.add_argument("command", choices=["list-skills", "scan", "score-round", "windows", "hybrid", "match", "database"])
    p.add_argument("text", nargs="?", help="the transcript itself; else --file, else standard input")
    p.add_argument("-f", "--file", help="a transcript, or a JSON payload for match")
    p.add_argument("-t", "--threshold", type=float, default=POSITIVE, help="least confidence of skills")
    p.add_argument("--neg-threshold", type=float, default=NEGATIVE, help="least confidence of mistakes and fouls")
    p.add_argument("-j", "--json", action="store_true", help="JSON instead of a report")
    p.add_argument("--round-number", type=int, default=1)
    p.add_argument("--battler", default="A")
    p.add_argument("--opponent-file", help="what the opponent said before, for hybrid")
    p.add_argument("--opponent", help="the same, as text")
    p.add_argument("--cache", help="folder of the judge's answers, for hybrid and match")
    p.add_argument("--judge", help="module:function that answers a pandas Series of prompts, for hybrid, match and database")
    p.add_argument("--store", help="folder of the answer store, which keeps what the judge says")
    p.add_argument("--url", help="JDBC address of the database")
    p.add_argument("--connect", help="module:function that opens a DB-API connection, to save with")
    p.add_argument("--mark", default="%s", help="how that driver writes a parameter")
    p.add_argument("-l", "--livestream-id", help="the livestream to score; all that have transcripts without it")
    p.add_argument("--list", action="store_true", help="list livestreams with transcripts")
    p.add_argument("--save", action="store_true", help="save verdicts, and account records with them")
    p.add_argument("--force", action="store_true", help="overwrite verdicts that are there")
    p.add_argument("--skip-account-updates", action="store_true")
    p.add_argument("--tie-threshold", type=float, default=TIE)
    p.add_argument("--rules-only", action="store_true", help="score a match without the judge")
    return p


def _read(path: str) -> str:
    with open(path, encoding="utf-8", errors="replace") as f:
        return f.read()


def report(rows: list, total: float) -> str:
    """Detections as a report: highlights, then deductions, each with its first piece of evidence."""
    good, bad = ([r for r in rows if (r.direction == "positive") == up] for up in (True, False))
    out = [f"Total Score: {total:+.2f}  ({len(good)} highlights, {len(bad)} deductions)"]
    for title, some in (("HIGHLIGHTS", good), ("DEDUCTIONS", bad)):
        out += [f"\n{title}:"] if some else []
        for r in some:
            out.append(f"  [{r.skill_id}] {r.skill_name:25s} {r.points:+.2f}pts  conf={r.confidence:.0%}")
            out += [f"      -> {e[:100]}" for e in r.evidence[:1]]
    return "\n".join(out)


def envelope(error: str, match_id: str | None = None) -> str:
    """What is printed of a match that can't be scored."""
    return json.dumps({"schema_version": 1, "status": "error", "error": error, "match_id": match_id, "rounds": [], "match_winner": None, "summary": None}, indent=2)


def judge_named(name: str | None):
    """A function of prompts (pandas Series) by module:function."""
    if name is None:
        return None
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def _match(spark: SparkSession, text: str, cache: DataFrame | None, rules_only: bool, ask=None, store: str | None = None) -> int:
    """Prints the verdict of a payload, or an envelope of what is wrong with it."""
    match_id = None
    try:
        payload = json.loads(text)
        match_id = payload.get("match_id")
        rounds = [(str(match_id or ""), i + 1, r.get("a") or "", r.get("b") or "", payload.get("battler_a"), payload.get("battler_b"), payload.get("tie_threshold")) for i, r in enumerate(payload.get("rounds") or [])]
        if not rounds:
            raise ValueError("rounds must not be empty")
        for r in rounds:
            if not (r[2].strip() and r[3].strip()):
                raise ValueError(f"round {r[1]}: both sides are required")
        frame = spark.createDataFrame(rounds, "match_id string, round int, a string, b string, battler_a string, battler_b string, tie_threshold double")
        if rules_only:
            sides = F.explode(F.array(F.struct(F.lit("A").alias("side"), F.col("a").alias("text")), F.struct(F.lit("B").alias("side"), F.col("b").alias("text"))))
            row = api.match_verdicts(frame.select("match_id", "round", sides.alias("p")).select("match_id", "round", "p.*")).first()
        else:
            row = api.matches(frame, ask, cache, store=store).first()
    except json.JSONDecodeError as e:
        print(envelope(f"invalid JSON input: {e}"))
    except (ValueError, KeyError, AttributeError) as e:
        print(envelope(f"invalid payload: {e}", match_id))
    except JudgeError as e:
        print(envelope(f"LLM call failed: {e}", match_id))
    except Exception as e:  # whatever it is, the caller gets an envelope
        kind = "LLM call failed" if "JudgeError" in str(e) else f"unexpected error: {type(e).__name__}"  # of a worker
        print(envelope(f"{kind}: {e}", match_id))
    else:
        if rules_only:
            print(json.dumps({"schema_version": 1, "status": "ok", "error": None, **row.asDict(), "match_id": match_id}, indent=2))
        else:
            print(json.dumps({**json.loads(row.document), "match_id": match_id}, indent=2))
        return 0
    return 1


def _database(spark: SparkSession, a: argparse.Namespace) -> int:
    """Scores livestreams of a database, and saves their verdicts where asked to."""
    table = {t: files.jdbc(spark, a.url, t) for t in ("transcripts", "livestreams", "brufids", "accounts")}
    if a.list:
        for r in database.listed(table["transcripts"], table["livestreams"]).toLocalIterator():
            print(f"{r.livestream_id:40} {r.title or '':25} {r.rows:5} {r['first']} {r['last']}")
        return 0
    if a.livestream_id:
        table["transcripts"] = table["transcripts"].filter(F.col("livestream_id") == a.livestream_id)
    return scored(table, a, judge_named(a.judge), judge_named(a.connect))


def scored(table: dict[str, DataFrame], a: argparse.Namespace, ask, connect) -> int:
    """Prints the document, or the error, of each livestream in the tables; 1 if some couldn't be scored."""
    rounds = database.rounds(*(table[t] for t in ("transcripts", "livestreams", "brufids", "accounts"))).withColumn("tie_threshold", F.lit(a.tie_threshold))
    failed = rounds.filter("error IS NOT NULL").select("match_id", "error").distinct()
    verdicts = api.matches(rounds.filter("error IS NULL"), ask, store=a.store)
    bad = 0
    if a.save:
        sides = rounds.groupBy("match_id").agg(F.first("rapper_a").alias("rapper_a"), F.first("rapper_b").alias("rapper_b"))
        good = database.states(verdicts.filter("error IS NULL")).join(sides, "match_id")
        for r in database.save(good, connect, a.force, not a.skip_account_updates, a.mark).toLocalIterator():
            print(f"{r.match_id}: {r.action}", file=sys.stderr)
    for r in failed.unionByName(verdicts.select("match_id", "error", "document"), allowMissingColumns=True).toLocalIterator():
        print(r.document if r.error is None else envelope(r.error, r.match_id))
        bad += r.error is not None
    return int(bool(bad))


def main(args: list[str] | None = None) -> int:
    a = _parser().parse_args(args)
    if a.command == "database":
        return _database(SparkSession.builder.getOrCreate(), a)
    if a.command == "list-skills":
        for _, skill_id, name, points, category, threshold in SKILLS:
            print(f"{skill_id:5} {name:24} {points:+.2f} {category:10} {threshold:.2f}")
        return 0
    text = _read(a.file) if a.file else a.text if a.text is not None else sys.stdin.read()
    if not text.strip():
        print("no text", file=sys.stderr)
        return 1
    spark = SparkSession.builder.getOrCreate()
    cache = files.read_cache(spark, a.cache) if a.cache else None
    if a.command == "match":
        return _match(spark, text, cache, a.rules_only, judge_named(a.judge), a.store)
    opponent = _read(a.opponent_file) if a.opponent_file else a.opponent
    said = files.inline(spark, text, opponent).withColumns({"round": F.lit(a.round_number), "side": F.lit(a.battler)})
    if a.command == "hybrid":
        print(api.hybrid(said, judge_named(a.judge), cache, store=a.store).first().document)
    elif a.command == "score-round":
        print(api.score_rounds(said).first().document)
    elif a.command == "windows":
        for row in api.windows(said).toJSON().toLocalIterator():
            print(row)
    else:
        rows = api.scan(said, a.threshold, a.neg_threshold).orderBy("place").collect()  # at most one for each skill
        if a.json:
            print(json.dumps([r.asDict() for r in rows], indent=2, ensure_ascii=False))
        else:
            print(report(rows, sum(r.points for r in rows)))
    return 0


if __name__ == "__main__":
    sys.exit(main())
