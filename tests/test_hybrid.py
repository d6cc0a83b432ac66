"""The hybrid scorer, the judge, matches and line placement, against results worked out by hand."""
import json
import math
import random
from difflib import SequenceMatcher

import pandas as pd
import pytest
from pyspark.sql import functions as F

from barlane import api
from barlane.operators import hybrid, judge, scoring
from barlane.plans import reconcile
from barlane.sources import files


def perf(spark, *texts):
    return spark.createDataFrame([(1, i + 1, "A", t) for i, t in enumerate(texts)], "match_id long, round int, side string, text string")


def finding(skill_id, points, *lines, **more):
    return {"skill_id": skill_id, "skill_name": "", "points": points, "direction": "positive" if points > 0 else "negative", "lines": list(lines), **more}


def said(*findings, **more):
    return json.dumps({"semantic_detections": list(findings), **more})


def final(doc):
    return [(f.get("skill_id"), f["points"]) for f in doc["all_detections"]]


def window(content, start=0, stop=9, again=None):
    return content, start, stop, again


TRUSTED_TYPE = "array<struct<skill_id: string, cents: int, evidence: array<string>>>"


def documents(spark, *cases):
    """The documents of performances, each of (windows, n, blocked, rival, trusted findings)."""
    rows = [(c, 1, "A", n, blocked, rival, [(t["skill_id"], round(t["points"] * 100), t["evidence"]) for t in trusted], k, start, stop, content, again)
            for c, (windows, n, blocked, rival, trusted) in enumerate(cases) for k, (content, start, stop, again) in enumerate(windows)]
    schema = f"match_id long, round int, side string, n int, blocked boolean, rival boolean, trusted {TRUSTED_TYPE}, win_idx int, start int, stop int, content string, again string"
    got = {r.match_id: json.loads(r.document) for r in hybrid.reconciled(spark.createDataFrame(rows, schema).repartition(3)).collect()}
    return [got[c] for c in range(len(cases))]


def test_position_gates_and_blocks(spark):
    w = [window(said(finding("OGR", 2, "hey"), finding("4QP", 2, "bye"))), window(said(finding("OGR", 2, "mid"), finding("4QP", 2, "end")), 7, 12)]
    es = [finding("ES", 2.75, "a"), finding("ES", 2.75, "bcdef gh", required_checks={"pivot": False, "x": True}), finding("ES", 2.75, "zzz yyy", required_checks={"pivot": True}), finding("STL", 2.5, "own words", required_checks={"q": True})]
    open_, blocked, gates, steal = documents(spark, (w, 13, False, True, []), (w, 13, True, True, []), ([window(said(*es))], 100, False, False, []), ([window(said(es[3]))], 10, False, True, []))
    assert final(open_) == [("OGR", 2), ("4QP", 2)] and final(blocked) == [("4QP", 2)]
    assert final(gates) == [("ES", 2.75)] and final(steal) == [("STL", 2.5)]
    assert [g["verdict"] for g in gates["gate_log"]["gated_out"]] == ["rejected_by_gate: required_checks missing", "rejected_by_gate: pivot"]


def test_fixes_after_dedup_and_caps(spark):
    found = [
        finding("FB", 3.0, "only one line"), finding("FB", 3.0, "first of them\nand then second"), finding("CO", 2.25, "he is king, no wait, a fool"),
        finding("ES", 2.75, "Naked truth, Nathan has bacon"), finding("FL", -0.75, "softly"), finding("LU", 1.25, "softly"),
    ]
    again = [finding("MR", 1.35, "the same line here"), finding("MR", 2.0, "the same line here!"), finding("MR", 1.35, "quite other"), finding("MR", 1.35, "a third one")]
    odd = [finding("MR", 1.0, "x"), {"skill_id": "MR", "lines": None}, {"points": 1.0, "lines": ["no skill"], "direction": "positive"}, finding("SD", 4.25, "y", required_checks=None)]
    fixed, repeated, strange = documents(spark, *(([window(said(*x))], 45, False, True, []) for x in (found, again, odd)))
    assert final(fixed) == [("MR", 1.35), ("FB", 3.0), ("MR", 1.35), ("LU", 1.25), ("LU", 1.25)]
    assert [f.get("gate_note") for f in fixed["all_detections"]] == [reconcile.SHORT_BREAK, None, reconcile.CORRECTED, reconcile.SWAPPED, None]
    assert final(repeated) == [("MR", 2.0), ("MR", 1.35)]
    assert [f.get("skill_id") for f in strange["all_detections"]] == ["MR", "MR", None, "SD"]


def test_trusted_findings_and_second_answers(spark):
    dd = {"skill_id": "DD", "points": -2.0, "evidence": ['Near-repeat (similarity 88%): "a" ≈ "b"']}
    on_purpose = {**dd, "evidence": ['Repeated (2x): "a"', 'Near-repeat (similarity 100%): "a" ≈ "a"']}
    tvl = {"skill_id": "TVL", "points": -1.5, "evidence": ["um"]}
    none = [window(said())]
    w = [window(said(rejected_rule_detections=[{"skill_id": "TVL"}], confirmed_rule_detections=["DD"])), window("garbage", 7, 9, again=said(finding("TVL", -1.5, "x"), finding("SD", 4.25, "y"))), window(None, 7, 9)]
    both, meant, doc = documents(spark, (none, 5, False, True, [dd, tvl]), (none, 5, False, True, [on_purpose]), (w, 30, False, True, [dd, tvl]))
    assert final(both) == [("DD", -2.0), ("TVL", -1.5)] and final(meant) == []
    assert final(doc) == [("DD", -2.0), ("SD", 4.25)]
    assert doc["window_status"] == ["first", "second", "unanswered"] and doc["total_score"] == 2.25
    assert doc["rule_engine_raw"] == {"trusted_found": ["DD", "TVL"], "confirmed_by_llm": ["DD"], "rejected_by_llm": ["TVL"]}


def test_windows_close_from_the_second_to_last_line(spark):
    ends = {17: [(0, 9), (7, 16)], 18: [(0, 9), (7, 16), (14, 17)], 19: [(0, 9), (7, 16), (14, 18)], 24: [(0, 9), (7, 16), (14, 23)], 25: [(0, 9), (7, 16), (14, 23), (21, 24)], 26: [(0, 9), (7, 16), (14, 23), (21, 25)]}
    want = {n: ["opener" if a == 0 else "closer" if b >= n - 2 else "middle" for a, b in w] for n, w in ends.items()}
    assert want[18] == ["opener", "closer", "closer"] and want[19] == ["opener", "middle", "closer"]
    text = perf(spark, *("\n".join(f"verse {i} of {n}" for i in range(n)) for n in ends))
    got = {}
    for r in api.apply(text, "window_position").orderBy("round", "win_idx").collect():
        got.setdefault(list(ends)[r.round - 1], []).append(r.position)
    assert got == want
    notes = {}
    for r in hybrid.windows(hybrid.scanned(text)).orderBy("round", "win_idx").collect():
        notes.setdefault(list(ends)[r.round - 1], []).append("opener" if "open the round" in r.prompt else "closer" if "close the round" in r.prompt else "middle")
    assert notes == want


def greedy(found, n):
    """Findings in arrival order without repeats, by plain loops."""
    kept, count = [], {}
    for skill, points, lines in found:
        same = next((i for i, k in enumerate(kept) if k[0] == skill and any(a in b or b in a or SequenceMatcher(None, a, b).ratio() >= 0.6 for a in map(str.lower, lines) for b in map(str.lower, k[2]))), None)
        if same is not None:
            if points > kept[same][1]:
                kept[same] = (skill, points, lines)
        elif count.get(skill, 0) < {"MR": max(2, math.ceil(2 * min(n / 45, 3))), "SD": 1}.get(skill, 99):
            count[skill] = count.get(skill, 0) + 1
            kept.append((skill, points, lines))
    return [k[:2] for k in kept]


def test_the_fold_equals_plain_loops(spark):
    rng, words = random.Random(7), "crown king ring the a of my your burning river steel".split()
    cases = []
    for c in range(60):
        found = [(rng.choice(["MR", "SD", "TECH"]), rng.choice([1.0, 1.35, 2.0]), [" ".join(rng.choices(words, k=rng.randint(2, 5))) for _ in range(rng.randint(1, 2))]) for _ in range(rng.randint(0, 9))]
        cases.append((rng.choice([20, 45, 100]), found))
    rows = [(c, 1, "A", n, i, s, p, q) for c, (n, found) in enumerate(cases) for i, (s, p, q) in enumerate(found)]
    schema = "match_id long, round int, side string, n int, idx int, skill_id string, points double, quoted array<string>"
    got = {}
    for r in scoring.dedup_greedy(spark.createDataFrame(rows, schema).repartition(4)).collect():
        got.setdefault(r.match_id, []).append((r.skill_id, r.points))
    for c, (n, found) in enumerate(cases):
        assert got.get(c, []) == greedy(found, n), (n, found)


def test_patience():
    waits, log = [], []

    def call(prompt, key):
        log.append((prompt, key))
        return {"k1": (401, "Incorrect API key"), "k2": (200, "ok")}[key] if prompt != "slow" or len(waits) > 3 else (429, "try again in 250ms" if len(waits) < 2 else "busy")

    assert judge.patient(call, ["k1", "k2"], waits.append)(pd.Series(["a", "slow"])).tolist() == ["ok", "ok"]
    assert waits == [judge.PACE, 0.75, 4.0, 8.0]
    with pytest.raises(judge.JudgeError):
        judge.patient(lambda p, k: (429, ""), ["k"], lambda s: None)(pd.Series(["x"]))
    assert not judge.bad_key("timeout")


ROUND = "\n".join(["you set the table", "um i lost it wait", *(f"verse {i} rolls over hills" for i in range(12))])


def test_hybrid_plan(spark):
    asked = []

    def ask(prompts: pd.Series) -> pd.Series:
        out = []
        for p in prompts:
            if p.startswith("Name the skills in these lines. Answer"):
                out.append('{"semantic_detections": [{"skill_id": "MR", "skill_name": "Mid-Range", "points": 1.35, "direction": "positive", "lines": ["verse 11 rolls over hills"]}]}')
            elif "close the round" in p:
                out.append("no json at all")
            else:
                known = "[TVL]" in p and "opponent said" in p
                out.append('{"semantic_detections": [{"skill_id": "STL", "skill_name": "Steal", "points": 2.5, "direction": "positive", "lines": ["you set the table"], "required_checks": {"line": true}}]' + (', "confirmed_rule_detections": ["TVL"]}' if known else "}"))
        return pd.Series(out)

    both = perf(spark, ROUND, "", "one line").withColumn("opponent", F.when(F.col("round") == 1, "the table is set"))
    got = {r.round: r for r in api.hybrid(both, ask).collect()}
    doc = json.loads(got[1].document)
    assert (got[1].windows, got[1].status, doc["window_status"]) == (2, "ok", ["first", "second"])
    assert final(doc) == [("TVL", -1.5), ("STL", 2.5), ("MR", 1.35)] and got[1].total == 2.35
    assert doc["rule_engine_raw"]["confirmed_by_llm"] == ["TVL"]
    assert (got[2].windows, got[2].total) == (0, 0.0) and final(json.loads(got[3].document)) == []
    assert {r.status for r in api.hybrid(both).collect()} == {"ok", "unanswered"}
    del asked


def test_matches_with_a_judge(spark):
    def ask(prompts: pd.Series) -> pd.Series:
        return pd.Series(['{"semantic_detections": [{"skill_id": "SD", "points": 4.25, "direction": "positive", "lines": ["crown"]}]}' if "crown" in p.split("\n\n")[-1] else "{}" for p in prompts])

    rows = [("m", 1, "a crown", "a plain day", "Ann", "", 0.0), ("m", 2, "nothing here", "plain too", "Ann", "", 0.0), ("x", 1, "a", " ", None, None, None)]
    got = {r.match_id: r for r in api.matches(spark.createDataFrame(rows, "match_id string, round int, a string, b string, battler_a string, battler_b string, tie_threshold double"), ask).collect()}
    assert (got["m"].summary, got["m"].match_winner, got["m"].a_wins, got["m"].b_wins, got["m"].battler_b, got["m"].tie_threshold) == ("Ann wins 1.5-0.5", "A", 1.5, 0.5, "B", 0.75)
    assert got["x"].error == "round 1: both sides are required" and got["x"].summary is None


def best_line(evidence, lines):
    """Where the evidence belongs (from 1), by counting every probe in every line."""
    probes = []
    for ev in evidence:
        w = ev.lower().split()
        probes += [x for x in w if len(x) >= 5] + [" ".join(w[i : i + 2]) for i in range(len(w) - 1)]
    hits = [sum(p in line.lower() for p in probes) for line in lines]
    return hits.index(max(hits)) + 1 if hits and max(hits) else 1


def test_lines_and_evidence_by_hand(spark):
    carry = "\n".join(["first of all", "i studied the map", "i checked the sky", "we sat", "i planned a lot", "and that's all", "more and more", "the sun went down"])
    twice = "\n".join(["the moon is out tonight my friend", "a b c", "the moon is out tonight my friend"])
    text = perf(spark, "you set the table\nthe cat sat\num i lost it wait", carry, twice)
    lines = {(r.round, r.line_no): (r.skills, r.line_score) for r in api.line_scores(text).collect()}
    assert len(lines) == 3 + 8 + 3
    assert lines[1, 3] == ("TVL", -1.5) and lines[1, 1] == ("", 0.0)
    assert lines[3, 1][0] == "DD"
    scan = {(r.round, r.skill_id): r for r in api.scan(text).collect()}
    assert scan[2, "CAR"].evidence[0].startswith("first of all | i studied the map | i checked")
    assert scan[2, "CAR"].evidence[1].startswith("first of all | i studied") and "and that's all" in scan[2, "CAR"].evidence[2]
    split = {r.round: r.text.split("\n") for r in text.collect()}
    for (k, skill), r in scan.items():
        assert skill in lines[k, best_line(r.evidence, split[k])][0].split(","), (k, skill)
    assert scan[3, "DD"].evidence == ['Repeated (2x): "the moon is out tonight my friend"', 'Near-repeat (similarity 100%): "the moon is out tonight my friend" ≈ "the moon is out tonight my friend"']
    totals = {r.round: r.total for r in api.totals(text).collect()}
    assert totals[3] == round(sum(s for (k, _), (_, s) in lines.items() if k == 3), 2) == sum(r.points for (k, _), r in scan.items() if k == 3)
    doc = json.loads(api.score_rounds(text).filter("round = 1").first().document)
    assert [x["line_score"] for x in doc["lines"]] == [0.0, 0.0, -1.5] and doc["deductions"][0]["skill_id"] == "TVL"


def test_letters_beyond_ascii_bound_words(spark):
    got = {(r.round, r.skill_id) for r in api.scan(perf(spark, "éum waité", "um wait", "um um", "né nè")).collect()}
    assert got == {(2, "TVL"), (3, "TVL")}


def test_a_scan_neither_joins_nor_shuffles(spark):
    plan = api.totals(perf(spark, "x"))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan


def test_files_and_verdicts(spark, tmp_path):
    (tmp_path / "one_two").mkdir()
    (tmp_path / "one_two" / "ann_round2_raw.txt").write_bytes(b"caf\xe9\nline")
    (tmp_path / "one_two" / "bob_round1.txt").write_text("hey")
    got = {tuple(r) for r in files.transcripts(spark, str(tmp_path / "one_two")).collect()}
    assert got == {("one_two", 2, "ann", "caf�\nline"), ("one_two", 1, "bob", "hey")}
    answers = spark.createDataFrame([("k", "1"), ("k", "1"), ("n", None)], "cache_key string, content string")
    for _ in range(2):
        files.append_cache(answers, str(tmp_path / "cache"))
    assert files.read_cache(spark, str(tmp_path / "cache")).count() == 1
    (tmp_path / ".env").write_text("# x\nA_KEY = 'v'\nno\n")
    assert files.settings(str(tmp_path / "none"), str(tmp_path / ".env")) == {"A_KEY": "v"}
    matches = spark.createDataFrame([("a", None, None), ("b", "2-0", 2), ("c", None, None), ("c", None, None)], "livestream_id string, verdict string, score1 int")
    new = spark.createDataFrame([(i, "1-0", 1, 0, 5.0, 1.0) for i in "abcd"], "livestream_id string, verdict string, score1 int, score2 int, ai_score1 double, ai_score2 double")
    matches = matches.withColumns({"score2": F.lit(0), "ai_score1": F.lit(0.0), "ai_score2": F.lit(0.0)})
    done = {r.livestream_id: r.action for r in files.write_verdicts(new, matches, str(tmp_path / "m1")).collect()}
    assert done == {"a": "score", "b": "skip", "c": "refuse", "d": "missing"}
    assert sorted((r.livestream_id, r.verdict or "") for r in spark.read.parquet(str(tmp_path / "m1")).collect()) == [("a", "1-0"), ("b", "2-0"), ("c", ""), ("c", "")]
    files.write_verdicts(new, matches, str(tmp_path / "m2"), force=True)
    assert spark.read.parquet(str(tmp_path / "m2")).filter("livestream_id = 'b'").first().verdict == "1-0"


def test_stream_keeps_the_newest_text(spark, tmp_path):
    from barlane.streaming.completeness import complete_matches

    schema = "match_id long, round int, side string, text string, created timestamp, total_rounds int"
    stream = complete_matches(spark.readStream.schema(schema).parquet(str(tmp_path / "in" / "*")))
    batches = [[(1, 1, "A", "new", "2024-01-01 00:05:00", 1), (1, 2, "B", "beyond", "2024-01-01 00:00:00", 1)], [(1, 1, "A", "old", "2024-01-01 00:01:00", 1)], [(1, 1, "B", "b", "2024-01-01 00:02:00", 1)], [(1, 1, "B", "late", "2024-01-01 00:09:00", 1)]]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema.replace("timestamp", "string")).selectExpr("match_id", "round", "side", "text", "CAST(created AS timestamp) AS created", "total_rounds").write.parquet(str(tmp_path / "in" / str(k)))
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()
    assert {(r.match_id, r.round, r.side, r.text) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {(1, 1, "A", "new"), (1, 1, "B", "b")}
