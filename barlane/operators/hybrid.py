"""The hybrid scorer and whole matches: rules and a judge over windows of lines, composed into one plan."""
from __future__ import annotations

import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dialect import Spark
from ..plans import fixtures as fx
from ..plans import reconcile, sqls
from ..plans.queries import session
from ..registry import TIE, TRUSTED
from . import answers
from . import judge as judging

_D = Spark()
KEYS = ["match_id", "round", "side"]
Ask = Callable[[pd.Series], pd.Series]
#: Fixed value: of match documents.
SCHEMA_VERSION = 1

def _view(df: DataFrame) -> str:
    """A name by which any session of the application finds df."""
    name = f"barlane_{uuid.uuid4().hex}"
    df.createGlobalTempView(name)
    return f"global_temp.{name}"


def scanned(performances: DataFrame) -> DataFrame:
    """Cleaned performances (match_id, round, side, text, opponent) with lines, n, blocked and trusted rule findings.

    Cleaning is the slang table, then cutting of walls of text, then dropping of ad-libs. A finding of the rules that has
    no line of its own stands with the first line's.
    """
    own = session(performances.sparkSession)
    source = _view(performances.select(*KEYS, "text", F.col("opponent") if "opponent" in performances.columns else F.lit(None).cast("string").alias("opponent")))
    listed = ", ".join(f"'{s}'" for s in TRUSTED)
    layers = sqls.scan(_D, True, keep=("opponent", "blocked"), only=TRUSTED)
    select = f"SELECT match_id, round, side, text, opponent, blocked, lines, n, filter(dets, x -> x.skill_id IN ({listed})) AS trusted FROM scanned"
    return own.sql(fx.with_(*sqls.cleaned(_D, source), fx.prepared(_D), *layers) + select)


def windows(rounds: DataFrame, size: int = 10, overlap: int = 3) -> DataFrame:
    """A row for each window of lines, with its prompt and a short one; rounds without lines keep one row without a window."""
    stride = size - overlap
    last = F.when(F.col("n") > 0, F.when(F.col("n") <= size, 0).otherwise(F.ceil((F.col("n") - size) / stride)).cast("int"))
    w = rounds.withColumn("win_idx", F.explode_outer(F.when(last.isNotNull(), F.sequence(F.lit(0), last))))
    w = w.withColumn("start", F.col("win_idx") * stride).withColumn("stop", F.least(F.col("start") + size, "n") - 1)
    w = w.withColumn("win_text", F.array_join(F.slice("lines", F.col("start") + 1, F.col("stop") - F.col("start") + 1), "\n"))
    place = (
        F.when(F.expr(reconcile.OPENS) & ~F.col("blocked"), "These lines open the round: a strong opening is an OGR; there is no 4QP here.")
        .when(F.expr(reconcile.OPENS), "These lines open the round with a generic line: there is no OGR and no 4QP here.")
        .when(F.expr(reconcile.CLOSES), "These lines close the round: a strong finish is a 4QP; there is no OGR here.")
        .otherwise("These lines are from the middle of the round: there is no OGR and no 4QP here.")
    )
    rival = F.when(F.trim(F.coalesce("opponent", F.lit(""))) != "", F.concat(F.lit("\nWhat the opponent said before (needed for STL):\n"), F.trim("opponent"), F.lit("\n"))).otherwise("")
    told = F.transform("trusted", lambda t: F.concat(F.lit("["), t.skill_id, F.lit("] "), (t.cents / 100).cast("string"), F.lit(": "), F.array_join(F.slice(t.evidence, 1, 2), "; ")))
    rules = F.when((F.col("win_idx") == 0) & (F.size("trusted") > 0), F.concat(F.lit("\nFound by rules; confirm or reject each, and find no DD, TVL or CHK yourself:\n"), F.array_join(told, "\n"), F.lit("\n"))).otherwise("")
    lines = F.concat(F.lit("Judge lines "), F.col("start") + 1, F.lit("-"), F.col("stop") + 1, F.lit(" of "), F.col("n"), F.lit(".\n"))
    ask = F.lit("\nName the skills in these lines only, as JSON: confirmed_rule_detections, rejected_rule_detections, semantic_detections.\n\n")
    short = F.concat(F.lit('Name the skills in these lines. Answer with JSON only: {"semantic_detections": [...]}\n\n'), F.col("win_text"))
    for a, b in (("—", "--"), ("…", "..."), ("→", "->"), ("≠", "!=")):
        short = F.replace(short, F.lit(a), F.lit(b))
    prompt = F.concat(lines, place, rival, rules, ask, F.col("win_text"))
    for a, b in (("—", "--"), ("…", "..."), ("→", "->"), ("≠", "!=")):
        prompt = F.replace(prompt, F.lit(a), F.lit(b))
    return w.withColumns({"prompt": prompt, "short": short})


def _asking(ask: Ask):
    """ask as a column function: nulls stay null, and equal prompts of a batch are asked once."""

    def own(prompts: pd.Series) -> pd.Series:
        some = prompts.dropna().drop_duplicates()
        said = dict(zip(some, ask(some.reset_index(drop=True)))) if len(some) else {}
        return prompts.map(said.get).astype(object)

    return F.pandas_udf(own, T.StringType()).asNondeterministic()


def answered(asked: DataFrame, prompt: str, out: str, cache: DataFrame | None, ask: Ask | None, where=None, model: str = "", system: str = "") -> DataFrame:
    """asked with the answers `out` to its column prompt: from cache (cache_key, content), else from ask; null where there
    is neither, and where `where` doesn't hold. A task that is tried again asks again; `answers.fill` doesn't."""
    wanted = F.when(F.col(prompt).isNotNull() if where is None else where, F.col(prompt))
    if cache is None:
        return asked.withColumn(out, F.lit(None).cast("string") if ask is None else _asking(ask)(wanted))
    known = cache.groupBy("cache_key").agg(F.min("content").alias("_known"))  # a key may have been added more than once
    keyed = asked.withColumn("_key", answers.prompt_key(wanted, model, system)).join(known, F.col("_key") == F.col("cache_key"), "left")
    left = F.lit(None).cast("string") if ask is None else _asking(ask)(F.when(F.col("_known").isNull(), wanted))
    return keyed.withColumn(out, F.coalesce("_known", left)).drop("_key", "_known", "cache_key")


@F.pandas_udf(T.BooleanType())
def unread(contents: pd.Series) -> pd.Series:
    """Whether an answer holds no JSON."""
    return pd.Series([c is not None and "error" in judging.read(c) for c in contents], dtype=bool)


def reconciled(said: DataFrame, model: str = "") -> DataFrame:
    """Performances from their windows' answers: totals, findings and a document, by the rules of plans.reconcile.

    said: match_id, round, side, n, blocked, rival (whether it answers someone), trusted, win_idx, start, stop, content,
    again; rounds without lines have one row without a window.
    """
    own = session(said.sparkSession)
    source = _view(said)
    item = "x -> named_struct('skill_id', x.skill_id, 'skill_name', x.skill_name, 'points', x.points, 'direction', x.direction, 'lines', x.lines, 'reason', x.reason, 'gate_note', x.note, 'source', x.source)"
    side = lambda s: f"transform(filter(final, x -> x.direction = '{s}'), {item})"
    gated = "transform(filter(judged, x -> x.verdict <> 'accepted'), x -> named_struct('skill_id', x.skill_id, 'verdict', x.verdict, 'failed', x.failed))"
    raw = "named_struct('trusted_found', trusted.skill_id, 'confirmed_by_llm', confirmed, 'rejected_by_llm', rejected)"
    total = reconcile.total(_D)
    document = (
        f"to_json(named_struct('round_number', round, 'battler', side, 'model', {_D.lit(model)}, 'total_score', {total}, 'highlights', {side('positive')}, 'deductions', {side('negative')}, "
        f"'all_detections', transform(final, {item}), 'windows_used', windows, 'window_status', status, 'rule_engine_raw', {raw}, 'gate_log', named_struct('gated_out', {gated})))"
    )
    bad = "array_sort(array_distinct(filter(status, s -> s IN ('unanswered', 'unread'))))"
    sql = f"SELECT {reconcile.KEYS}, {total} AS total, CAST(size(final) AS INT) AS n_detections, windows, CASE WHEN size({bad}) = 0 THEN 'ok' ELSE array_join({bad}, ',') END AS status, final, {document} AS document FROM merged"
    ctes = (f"answered AS (SELECT * FROM {source})", *reconcile.layers(_D))
    return own.sql(fx.with_(*ctes) + sql)


def hybrid(
    performances: DataFrame, ask: Ask | None = None, cache: DataFrame | None = None, model: str = "", system: str = "", store: str | None = None,
    lanes: int = answers.LANES, per_second: float | None = None,
) -> DataFrame:
    """match_id, round, side, total, n_detections, windows, status, final, document of each performance.

    store: the folder of an answer store (operators.answers). What it lacks is asked first, each prompt once in the cluster
    and at most per_second of them a second, then the short prompts of answers that can't be read; all answers stay there.

    performances: match_id, round, side, text and, if there, opponent, the lines that the text answers. status tells
    where windows had no answer (unanswered) or none that could be read, also at the second try (unread).
    """
    w = windows(scanned(performances))
    if store is not None:
        w = _kept(w, store)  # else the texts would be scanned again for each pass
        cache, known = answers.read(w.sparkSession, store), {"model": model, "system": system}
        if ask is not None:
            cache = answers.fill(w, store, ask, "prompt", **known, lanes=lanes, per_second=per_second)
            first = answered(w, "prompt", "content", cache, None, **known)
            cache = answers.fill(first.filter(unread("content")), store, ask, "short", **known, lanes=lanes, per_second=per_second)
            ask = None
    first = answered(w, "prompt", "content", cache, ask, None, model, system)
    second = answered(first, "short", "again", cache, ask, unread("content"), model, system)
    rival = F.trim(F.coalesce("opponent", F.lit(""))) != ""
    return reconciled(second.select(*KEYS, "n", "blocked", rival.alias("rival"), "trusted", "win_idx", "start", "stop", "content", "again"), model)


def _kept(df: DataFrame, store: str) -> DataFrame:
    """df, written beside the answers and read from there."""
    path = f"{store}/windows/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def answering(performances: DataFrame) -> DataFrame:
    """performances with opponent: what side A answers is B's turn before, what B answers is A's turn of the round."""
    from pyspark.sql import Window

    return performances.withColumn("opponent", F.lag("text").over(Window.partitionBy("match_id").orderBy("round", "side")))


def matches(rounds: DataFrame, ask: Ask | None = None, cache: DataFrame | None = None, **options) -> DataFrame:
    """Verdicts of matches scored by rules and judge: match_id, battlers, tie threshold, winner, wins, summary, rounds, document.

    rounds: match_id, round, a, b and, if there, battler_a, battler_b, tie_threshold. Matches with a blank side have an
    error instead of a verdict. document is the match as JSON, with each side's own document in its rounds. options: those of
    `hybrid`.
    """
    name = lambda c, default: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(default)) if c in rounds.columns else F.lit(default)
    tie = F.coalesce(F.nullif(F.col("tie_threshold").cast("double"), F.lit(0.0)), F.lit(TIE)) if "tie_threshold" in rounds.columns else F.lit(TIE)
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    facts = rounds.select("match_id", F.col("round").cast("int").alias("round"), "a", "b", name("battler_a", "A").alias("battler_a"), name("battler_b", "B").alias("battler_b"), tie.alias("tie_threshold"))
    bad = facts.filter(blank("a") | blank("b")).groupBy("match_id").agg(F.min("round").alias("bad_round"))
    good = facts.join(bad, "match_id", "left_anti")
    sides = F.explode(F.array(F.struct(F.lit("A").alias("side"), F.col("a").alias("text")), F.struct(F.lit("B").alias("side"), F.col("b").alias("text"))))
    turns = answering(good.select("match_id", "round", sides.alias("p")).select("match_id", "round", "p.side", "p.text"))
    sides = [F.max(F.when(F.col("side") == s, F.col(c))).alias(f"{n}_{s.lower()}") for s in "AB" for c, n in (("total", "score"), ("document", "detail"))]
    totals = hybrid(turns, ask, cache, **options).groupBy("match_id", "round").agg(*sides, F.concat_ws(",", F.array_sort(F.collect_set("status"))).alias("status"))
    diff = F.round(F.col("score_a") - F.col("score_b"), 2)
    won = good.join(totals, ["match_id", "round"]).withColumn("winner", F.when(F.abs(diff) <= F.col("tie_threshold"), "tie").when(diff > 0, F.lit("A")).otherwise("B"))
    wins = lambda s: F.sum(F.when(F.col("winner") == s, 1.0).when(F.col("winner") == "tie", 0.5).otherwise(0.0))
    per = won.groupBy("match_id").agg(
        F.first("battler_a").alias("battler_a"), F.first("battler_b").alias("battler_b"), F.first("tie_threshold").alias("tie_threshold"), wins("A").alias("a_wins"), wins("B").alias("b_wins"),
        F.array_sort(F.collect_list(F.struct("round", "winner", "score_a", "score_b", "detail_a", "detail_b"))).alias("r"), F.concat_ws(",", F.array_sort(F.collect_set("status"))).alias("status"),
    )
    short = lambda c: F.regexp_replace(F.col(c).cast("string"), r"\.0$", "")
    summary = (
        F.when(F.col("a_wins") > F.col("b_wins"), F.concat("battler_a", F.lit(" wins "), short("a_wins"), F.lit("-"), short("b_wins")))
        .when(F.col("b_wins") > F.col("a_wins"), F.concat("battler_b", F.lit(" wins "), short("b_wins"), F.lit("-"), short("a_wins")))
        .otherwise(F.concat(F.lit("Tie "), short("a_wins"), F.lit("-"), short("b_wins")))
    )
    winner = F.when(F.col("a_wins") > F.col("b_wins"), "A").when(F.col("b_wins") > F.col("a_wins"), "B").otherwise("tie")
    done = per.withColumns({"match_winner": winner, "summary": summary, "error": F.lit(None).cast("string")})
    plain = F.transform("r", lambda x: F.struct(x.round.alias("round"), x.winner.alias("winner"), x.score_a.alias("score_a"), x.score_b.alias("score_b")))
    # The details are JSON already, so they are set in as text.
    each = F.transform("r", lambda x: F.concat(F.rtrim(F.to_json(F.struct(x.round.alias("round"), x.winner.alias("winner"), x.score_a.alias("score_a"), x.score_b.alias("score_b"))), F.lit("}")), F.lit(',"detail_a":'), x.detail_a, F.lit(',"detail_b":'), x.detail_b, F.lit("}")))
    head = F.to_json(F.struct(F.lit(SCHEMA_VERSION).alias("schema_version"), F.lit("ok").alias("status"), "match_id", "battler_a", "battler_b", F.lit(options.get("model", "")).alias("model"), "tie_threshold", "match_winner", "summary"))
    document = F.concat(F.rtrim(head, F.lit("}")), F.lit(',"rounds":['), F.array_join(each, ","), F.lit('],"error":null}'))
    done = done.withColumns({"rounds": plain, "document": document}).drop("r")
    failed = bad.select("match_id", F.concat(F.lit("round "), "bad_round", F.lit(": both sides are required")).alias("error"))
    return done.unionByName(failed, allowMissingColumns=True)
