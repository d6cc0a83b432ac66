"""Queries over all of their rows, against brute force in Python."""
import re
from collections import Counter, defaultdict

import pyarrow.parquet as pq

from barlane import api, rules
from barlane.operators import scoring
from barlane.plans import queries, sqls

SF = "/root/testdata/sf0.001"


def test_verdict_guard_sees_every_order(spark):
    states = defaultdict(list)
    for o in pq.read_table(f"{SF}/orders.parquet", columns=["o_orderkey", "o_orderstatus"]).to_pylist():
        states[o["o_orderkey"]] += [o["o_orderstatus"]] * (2 if o["o_orderstatus"] == "P" else 1)
    want = {(c, "refuse" if len(s) > 1 else "skip" if s == ["F"] else "score") for c, s in states.items()}
    assert {tuple(r) for r in queries.QUERIES["verdict_guard"](spark, SF).collect()} == want
    assert len({action for _, action in want}) == 3


def quotes(spark):
    """The findings of each performance: skill, points and quoted lines, by arrival."""
    out = defaultdict(dict)
    for r in scoring._dets(lambda sql: queries.run(spark, SF, sql)).collect():
        out[r.match_id, r.round, r.side][r.idx] = (r.skill_id, r.points, tuple(x.strip().lower() for x in r.quoted if x.strip()))
    return out


def test_lines_contained_compares_every_line(spark):
    within = lambda a, b: any(x in y or y in x for x in a[2] for y in b[2])
    want = {(*k, i, j) for k, f in quotes(spark).items() for i in f for j in f if i < j and within(f[i], f[j])}
    assert {tuple(r) for r in queries.QUERIES["lines_contained"](spark, SF).collect()} == want
    assert want


def test_dedup_exact_keys_on_all_lines(spark):
    want = set()
    for k, f in quotes(spark).items():
        first = {}
        for i, (skill, points, own) in sorted(f.items(), key=lambda x: (-x[1][1], x[0])):
            first.setdefault((skill, own), (*k, i, skill, points))
        want |= set(first.values())
    assert {tuple(r) for r in queries.QUERIES["dedup_exact"](spark, SF).collect()} == want


def test_dedup_exact_keeps_findings_that_share_one_line(spark):
    lines = [f"line {i}" for i in range(60)]
    lines[35] = lines[0]  # the first lines of windows 0 and 5, whose findings have one skill
    perf = spark.createDataFrame([(1, 1, "A", "\n".join(lines))], "match_id long, round int, side string, text string")
    got = {r.idx: r.skill_id for r in api.apply(perf, "dedup_exact").collect()}
    assert {0, 10} <= set(got) and got[0] == got[10]


def test_all_patterns_of_all_detectors(spark):
    run = lambda sql: queries.run(spark, SF, sql)
    prep = run(sqls._perf(scoring._D, "SELECT match_id, round, side, s FROM prep", prep=True)).collect()
    want, hits = Counter(), {}
    for r in prep:
        for key, groups in rules.GROUPS.items():
            for k, g in enumerate(groups):
                own = [i for i, p in enumerate(g.patterns) if re.search(p, r.s)]
                want.update((r.match_id, r.round, r.side, key, i) for i in own)
                hits[r.match_id, r.round, r.side, key, k] = (len(own), round(min(len(own) * g.per_hit, g.cap), 6))
    got = queries.QUERIES["evidence_snip"](spark, SF)
    assert Counter(tuple(r) for r in got.drop("snippet").collect()) == want
    assert got.filter("snippet = ''").count() == 0
    assert {tuple(r)[:5]: (r.n_hits, round(r.points, 6)) for r in queries.QUERIES["pattern_score"](spark, SF).collect()} == hits
