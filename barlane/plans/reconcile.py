"""Judge findings and rule findings of a performance brought together, in one plan of both dialects.

A rule is a function of SQL texts here, stated once; the queries of single rules and the composed path (`layers`) use the same
ones. Findings of a performance stay in one row, as an array in arrival order: positions, repeats (an ordered fold over the
array), fixes, ownership of lines, the opponent's lines, gates, merge and totals add no exchange to the one that brings a
performance's windows together.
"""
from __future__ import annotations

from .. import registry as reg
from ..functions import similarity_sql
from ..functions.dialect import Spark, strip

KEYS = "match_id, round, side"
#: The name under which a session knows judge.clean_udf.
CLEAN = "barlane_json"
NAMES = {skill_id: name for _, skill_id, name, *_ in reg.SKILLS}
POINTS = {skill_id: points for _, skill_id, _, points, *_ in reg.SKILLS}
_GATED = ", ".join(f"'{s}'" for s in reg.GATED)
_TRUSTED = ", ".join(f"'{s}'" for s in reg.TRUSTED)
# Why a finding is counted as another skill.
SHORT_BREAK = "FB downgraded to MR: fewer than 2 distinct lines"
REPEATED_BREAK = "FB rejected: near-duplicate lines (DD territory)"
CORRECTED = "CO rejected: self-correction pattern"
SWAPPED = "ES rejected: parallel swap (naked/Nathan/bacon) is not a linear chain"

# Positions of windows: start and stop count from 0, stop is included.
OPENS, CLOSES = "start = 0", "stop >= n - 2"
POSITION = f"CASE WHEN {OPENS} THEN 'opener' WHEN {CLOSES} THEN 'closer' ELSE 'middle' END"


def in_place(skill: str, opens: str = OPENS, closes: str = CLOSES, blocked: str = "blocked") -> str:
    """Whether a finding may stand in its window: openers where a round opens and isn't blocked, closers where it closes."""
    return f"((coalesce({skill}, '') <> 'OGR' OR (({opens}) AND NOT {blocked})) AND (coalesce({skill}, '') <> '4QP' OR ({closes})))"


def cap(d: Spark, skill: str, n: str) -> str:
    """How often a skill may be kept in a round of n lines."""
    fixed = " ".join(f"WHEN '{s}' THEN {c}" for s, c in reg.CAPS.items() if s in reg.STRUCTURAL)
    grown = " ".join(f"WHEN '{s}' THEN greatest({c}, CAST(ceil({c} * least({n} / {d.f(45)}, {d.f(3)})) AS INT))" for s, c in reg.CAPS.items() if s not in reg.STRUCTURAL)
    return f"CAST(CASE {skill} {fixed} {grown} ELSE {reg.NO_CAP} END AS INT)"


def segments(d: Spark, lines: str) -> str:
    """The quoted lines cut at line feeds, stripped, without blank ones."""
    cut = d.flat(d.each(lines, "ql", d.split("ql", r"\n")))
    return d.where(d.each(cut, "sg", strip(d, "sg")), "st", "st <> ''")


def short_break(d: Spark, skill: str, lines: str) -> str:
    return f"({skill} = 'FB' AND {d.size(segments(d, lines))} < 2)"


def corrected(d: Spark, skill: str, lines: str) -> str:
    whole = f"lower({d.join(lines, ' ')})"
    return f"({skill} = 'CO' AND (" + " OR ".join(d.contains(whole, d.lit(p)) for p in reg.SELF_CORRECTION) + "))"


def swapped(d: Spark, skill: str, lines: str) -> str:
    whole = f"lower({d.join(lines, ' ')})"
    return f"({skill} = 'ES' AND " + " AND ".join(d.contains(whole, d.lit(p)) for p in reg.SWAP) + ")"


def direction(skill: str, given: str) -> str:
    return f"CASE WHEN {skill} = 'FL' THEN 'positive' ELSE {given} END"


def relabelled(d: Spark, x: str, repeats: str) -> tuple[str, str]:
    """Which skill a finding x counts as instead, and why; null for its own."""
    skill, lines = f"{x}.skill_id", f"{x}.lines"
    tests = ((short_break(d, skill, lines), "MR", SHORT_BREAK), (f"({skill} = 'FB' AND {repeats})", "MR", REPEATED_BREAK), (corrected(d, skill, lines), "MR", CORRECTED), (swapped(d, skill, lines), "LU", SWAPPED))
    one = lambda k: "CASE " + " ".join(f"WHEN {t[0]} THEN {d.lit(t[k])}" for t in tests) + " END"
    return one(1), one(2)


def keys(d: Spark, lines: str) -> str:
    """What tells the quoted lines of a finding from others'."""
    return d.each(segments(d, lines), "sk", "substring(lower(sk), 1, 100)")


def owns(d: Spark, x: str, every: str) -> str:
    """Whether x isn't positive, or one of its lines belongs to it: to the most points, then to the earliest finding."""
    better = f"abs(y.points) > abs({x}.points) OR (abs(y.points) = abs({x}.points) AND y.pos < {x}.pos)"
    taken = d.any_in(every, "y", f"y.pos <> {x}.pos AND coalesce(y.direction, '') = 'positive' AND {d.has_item('y.keys', 'lk')} AND ({better})")
    return f"(coalesce({x}.direction, '') <> 'positive' OR {d.any_in(f'{x}.keys', 'lk', f'NOT {taken}')})"


def answers_someone(skill: str, rival: str) -> str:
    """A steal needs the opponent's lines."""
    return f"(coalesce({skill}, '') <> 'STL' OR {rival})"


def gate(skill: str, failed: str) -> str:
    """The verdict on a finding: `failed` has the names of the checks that failed, null where there are no checks."""
    return f"CASE WHEN coalesce({skill}, '') NOT IN ({_GATED}) THEN 'accepted' WHEN {failed} IS NULL THEN 'rejected_by_gate: required_checks missing' WHEN {failed} <> '' THEN concat('rejected_by_gate: ', {failed}) ELSE 'accepted' END"


def deliberate(d: Spark, ev: str) -> str:
    """Whether some evidence shows a likeness of 93 % or more."""
    return d.any_in(ev, "e", f"{d.has('e', r'similarity\s+(\d+)%')} AND CAST(coalesce(nullif({d.extract('e', r'similarity\s+(\d+)%', 1)}, ''), '0') AS INT) >= 93")


def stands(d: Spark, t: str, rejected: str) -> str:
    """Whether a trusted rule finding is taken over."""
    return f"(NOT {d.has_item(rejected, f'{t}.skill_id')} AND NOT ({t}.skill_id = 'DD' AND {deliberate(d, f'{t}.evidence')}))"


def clean(d: Spark, s: str) -> str:
    """The JSON object in an answer, null where none can be read."""
    if d.name == "spark":
        return f"{CLEAN}({s})"
    fenced, outer = f"regexp_extract({s}, '```(?:json)?\\s*([\\s\\S]+?)```', 1)", f"regexp_extract({s}, '\\{{[\\s\\S]+\\}}')"
    return "CASE " + " ".join(f"WHEN json_valid({x}) AND json_type({x}) = 'OBJECT' THEN {x}" for x in (s, fenced, outer, repaired(d, outer))) + " END"


def repaired(d: Spark, s: str) -> str:
    """Plain quotes for curly ones, in the checking engine's SQL."""
    return f"translate({s}, '“”‘’', '\"\"''''')"


def _parsed(d: Spark) -> str:
    """findings, confirmed and rejected of the column body, a JSON object or null."""
    if d.name == "spark":
        item = "STRUCT<skill_id: STRING, skill_name: STRING, points: DOUBLE, direction: STRING, lines: ARRAY<STRING>, reason: STRING, required_checks: MAP<STRING, STRING>>"
        j = f"from_json(body, 'semantic_detections ARRAY<{item}>, confirmed_rule_detections ARRAY<STRING>, rejected_rule_detections ARRAY<STRING>')"
        failed = "CASE WHEN size(x.required_checks) > 0 THEN array_join(map_keys(map_filter(x.required_checks, (k, v) -> coalesce(v, '') IN ('', 'false', '0', '[]', '{}'))), ', ') END"
        named = lambda a: f"transform(filter(coalesce(j.{a}, array()), r -> r IS NOT NULL), r -> CASE WHEN r LIKE '{{%' THEN get_json_object(r, '$.skill_id') ELSE r END)"
        own, empty = "filter(j.semantic_detections, x -> x IS NOT NULL)", "array()"
        source = f"SELECT *, {j} AS j FROM read"
    else:
        item = '[{"skill_id": "VARCHAR", "skill_name": "VARCHAR", "points": "DOUBLE", "direction": "VARCHAR", "lines": ["VARCHAR"], "reason": "VARCHAR", "required_checks": "JSON"}]'
        bad = "list_filter(json_keys(x.required_checks), lambda k: coalesce(json_extract_string(x.required_checks, '$.' || k), '') IN ('', 'false', '0', '[]', '{}'))"
        failed = f"CASE WHEN len(json_keys(x.required_checks)) > 0 THEN array_to_string({bad}, ', ') END"
        named = lambda a: f"list_transform(coalesce(from_json(json_extract(body, '$.{a}'), '[\"JSON\"]'), []), lambda r: CASE WHEN json_type(r) = 'OBJECT' THEN json_extract_string(r, '$.skill_id') ELSE json_extract_string(r, '$') END)"
        own, empty = f"from_json(json_extract(body, '$.semantic_detections'), '{item}')", "[]"
        source = "SELECT * FROM read"
    plain = {"skill_id": "x.skill_id", "skill_name": "x.skill_name", "points": f"coalesce(x.points, {d.f(0)})", "direction": "x.direction", "lines": d.where(f"coalesce(x.lines, {empty})", "qn", "qn IS NOT NULL"), "reason": "x.reason", "failed": failed}
    made = f"coalesce({d.each(own, 'x', d.struct(plain))}, {empty})"
    return f"SELECT *, {made} AS said, {named('confirmed_rule_detections')} AS confirmed0, {named('rejected_rule_detections')} AS rejected0 FROM ({source}) AS s"


def alike(d: Spark, found: str = "collected") -> tuple[str, ...]:
    """alike: found (with said, an array of findings) and to whom each finding is alike: `near`, earlier ones (from 1) of its
    skill for each, and `repeats`, whether its own lines resemble one another."""
    if d.name == "spark":
        return f"alike0 AS (SELECT *, {similarity_sql.ALIKE}({d.each('said', 'x', 'x.skill_id')}, {d.each('said', 'x', 'x.lines')}) AS a FROM {found})", "alike AS (SELECT *, a.near AS near, a.repeats AS repeats FROM alike0)"
    k = "match_id, round, side"
    same = lambda a, b: f"{a}.match_id = {b}.match_id AND {a}.round = {b}.round AND {a}.side = {b}.side"
    return (
        f"al_items AS (SELECT {k}, i, said[i].skill_id AS skill_id, said[i].lines AS own FROM (SELECT {k}, said, unnest(generate_series(1, len(said))) AS i FROM {found}) AS x)",
        f"al_lines AS (SELECT {k}, i, skill_id, o, low FROM (SELECT {k}, i, skill_id, o, lower({strip(d, 'own[o]')}) AS low FROM (SELECT {k}, i, skill_id, own, unnest(generate_series(1, len(own))) AS o FROM al_items) AS y) AS z WHERE low <> '')",
        f"al_met AS (SELECT a.match_id AS match_id, a.round AS round, a.side AS side, a.i AS i, b.i AS e, CASE WHEN a.i = b.i THEN 0.75 ELSE 0.6 END AS least, CASE WHEN a.i = b.i THEN b.low ELSE a.low END AS x, CASE WHEN a.i = b.i THEN a.low ELSE b.low END AS y "
        f"FROM al_lines a JOIN al_lines b ON {same('a', 'b')} AND a.skill_id IS NOT DISTINCT FROM b.skill_id AND (a.i > b.i OR (a.i = b.i AND a.o > b.o)))",
        "al_texts AS (SELECT DISTINCT x, y FROM al_met WHERE NOT contains(x, y) AND NOT contains(y, x))",
        f"al_kept AS MATERIALIZED (SELECT row_number() OVER () AS id, x, y FROM al_texts WHERE len(y) < {similarity_sql.LONG} AND {similarity_sql.possible('x', 'y', 0.6)})",
        similarity_sql.blocks("al_kept", "al_ro"),
        similarity_sql.ratios("al_kept", "al_ro", "al_ratio"),
        "al_hits AS (SELECT DISTINCT m.match_id AS match_id, m.round AS round, m.side AS side, m.i AS i, m.e AS e FROM al_met m LEFT JOIN al_kept t ON m.x = t.x AND m.y = t.y LEFT JOIN al_ratio r ON t.id = r.id WHERE contains(m.x, m.y) OR contains(m.y, m.x) OR r.r >= m.least)",
        f"al_per AS (SELECT p.match_id AS match_id, p.round AS round, p.side AS side, list(coalesce(h.near, []) ORDER BY p.i) AS near, list(coalesce(h.repeats, false) ORDER BY p.i) AS repeats FROM al_items p "
        f"LEFT JOIN (SELECT {k}, i, list(e ORDER BY e) FILTER (e <> i) AS near, bool_or(e = i) AS repeats FROM al_hits GROUP BY ALL) AS h ON {same('p', 'h')} AND p.i = h.i GROUP BY ALL)",
        f"alike AS (SELECT f.*, coalesce(p.near, []) AS near, coalesce(p.repeats, []) AS repeats FROM {found} f LEFT JOIN al_per p ON {same('f', 'p')})",
    )


def accepted(d: Spark) -> str:
    """Indexes (from 1) of the findings of `said` that stay, in arrival order: one that is alike to an accepted one of its skill
    takes its place if it has more points and goes otherwise; others are kept up to their skill's cap."""
    it = lambda i: d.at("said", i)
    same = d.where("acc", "ax", d.has_item(d.at("near", "j"), "ax"))
    first = d.at(same, "1")
    swap = f"CASE WHEN {it('j')}.points > {it(first)}.points THEN {d.each('acc', 'az', f'CASE WHEN az = {first} THEN j ELSE az END')} ELSE acc END"
    room = f"{d.size(d.where('acc', 'ay', f'{it("ay")}.skill_id IS NOT DISTINCT FROM {it("j")}.skill_id'))} < {cap(d, f'{it("j")}.skill_id', 'n')}"
    return d.gather(d.size("said"), f"CASE WHEN {d.size(same)} > 0 THEN {swap} WHEN {room} THEN {d.concat('acc', d.array(['j']))} ELSE acc END")


def layers(d: Spark) -> tuple[str, ...]:
    """merged: match_id, round, side, windows, status, trusted, confirmed, rejected, judged (findings with their verdict) and final.

    Reads `answered`: match_id, round, side, n, blocked, rival, trusted, win_idx, start, stop, content, again; a row for
    each window, rounds without lines having one without a window.
    """
    spark = d.name == "spark"
    once = lambda x: f"array_sort(array_distinct(filter({x}, r -> coalesce(r, '') <> '')))" if spark else f"list_sort(list_distinct(list_filter({x}, lambda r: coalesce(r, '') <> '')))"
    first = "first" if spark else "any_value"
    status = "CASE WHEN content IS NULL THEN 'unanswered' WHEN c1 IS NOT NULL THEN 'first' WHEN c2 IS NOT NULL THEN 'second' ELSE 'unread' END"
    skill, why = relabelled(d, d.at("said", "i"), d.at("repeats", "i"))
    own = d.each("kept", "i", d.struct({"i": "i", "becomes": skill, "note": why}))
    pick = {
        "pos": "q", "skill_id": "coalesce(o.becomes, s.skill_id)", "lines": "s.lines", "reason": "s.reason", "note": "o.note", "failed": "s.failed", "keys": keys(d, "s.lines"),
        "skill_name": f"CASE o.becomes WHEN 'MR' THEN '{NAMES['MR']}' WHEN 'LU' THEN '{NAMES['LU']}' ELSE s.skill_name END",
        "points": f"CASE o.becomes WHEN 'MR' THEN {d.f(POINTS['MR'])} WHEN 'LU' THEN {d.f(POINTS['LU'])} ELSE s.points END",
        "direction": direction("s.skill_id", "s.direction"),
    }
    o, s = d.at("owned0", "q"), d.at("said", f"{d.at('owned0', 'q')}.i")
    fixed = d.each(d.upto(d.size("owned0")), "q", d.struct({k: v.replace("o.", f"{o}.").replace("s.", f"{s}.") if k != "keys" else keys(d, f"{s}.lines") for k, v in pick.items()}))
    out = ("skill_id", "skill_name", "points", "direction", "lines", "reason", "note")
    kept = d.each(d.where("judged", "x", f"x.verdict = 'accepted' AND coalesce(x.skill_id, '') NOT IN ({_TRUSTED})"), "x", d.struct({**{k: f"x.{k}" for k in out}, "source": "'llm'"}))
    told = {
        "skill_id": "t.skill_id", "skill_name": "CASE t.skill_id " + " ".join(f"WHEN '{s}' THEN '{NAMES[s]}'" for s in reg.TRUSTED) + " END", "points": f"t.cents / {d.f(100)}",
        "direction": "CASE WHEN t.cents > 0 THEN 'positive' ELSE 'negative' END", "lines": d.part("t.evidence", "1", "2"),
        "reason": f"concat('Rule engine: ', coalesce({d.at('t.evidence', '1')}, ''))", "note": "CAST(NULL AS " + ("STRING" if spark else "VARCHAR") + ")", "source": "'rule_engine'",
    }
    rules = d.each(d.where("trusted", "t", stands(d, "t", "rejected")), "t", d.struct(told))
    return (
        f"read0 AS (SELECT *, {clean(d, 'content')} AS c1, {clean(d, 'again')} AS c2 FROM answered)",
        f"read AS (SELECT *, coalesce(c1, c2) AS body, {status} AS state FROM read0)",
        f"parsed AS ({_parsed(d)})",
        f"placed_said AS (SELECT {KEYS}, n, blocked, rival, trusted, win_idx, state, confirmed0, rejected0, {d.where('said', 'x', in_place('x.skill_id'))} AS said FROM parsed)",
        f"collected0 AS (SELECT {KEYS}, {first}(n) AS n, {first}(rival) AS rival, {first}(trusted) AS trusted, CAST(count(win_idx) AS INT) AS windows, {d.listed('said', 'win_idx')} AS said0, {d.listed('state', 'win_idx')} AS state0, {d.listed('confirmed0', 'win_idx')} AS c0, {d.listed('rejected0', 'win_idx')} AS r0 FROM placed_said GROUP BY {KEYS})",
        f"collected AS (SELECT {KEYS}, n, rival, trusted, windows, {d.flat('said0')} AS said, CASE WHEN windows > 0 THEN state0 ELSE {d.part('state0', '1', '0')} END AS status, {once(d.flat('c0'))} AS confirmed, {once(d.flat('r0'))} AS rejected FROM collected0)",
        *alike(d),
        f"folded AS (SELECT *, {accepted(d)} AS kept FROM alike)",
        f"named AS (SELECT *, {own} AS owned0 FROM folded)",
        f"fixed AS (SELECT *, {fixed} AS fixed FROM named)",
        f"owned AS (SELECT *, {d.where('fixed', 'x', owns(d, 'x', 'fixed'))} AS owned FROM fixed)",
        f"gated AS (SELECT *, {d.each(d.where('owned', 'x', answers_someone('x.skill_id', 'rival')), 'x', d.struct({**{k: f'x.{k}' for k in (*out, 'failed')}, 'verdict': gate('x.skill_id', 'x.failed')}))} AS judged FROM owned)",
        f"merged AS (SELECT {KEYS}, n, windows, status, trusted, confirmed, rejected, judged, {d.concat(rules, kept)} AS final FROM gated)",
    )


def total(d: Spark, test: str = "true") -> str:
    """The points of the findings in `final` that pass a test."""
    return f"round({d.sum(d.each(d.where('final', 'x', test), 'x', 'x.points'))}, 2)"


def summary(d: Spark) -> str:
    """The columns of a scored performance over `merged`."""
    plus = lambda test: total(d, test)
    told = lambda a, x: d.join(d.each(a, "x", x), "; ")
    number = "CAST(x.points AS DECIMAL(10, 2))"
    text = f"CAST({number} AS {'STRING' if d.name == 'spark' else 'VARCHAR'})"
    return (
        f"SELECT {KEYS}, {plus('true')} AS total, {plus("x.direction = 'positive'")} AS highlights, {plus("x.direction = 'negative'")} AS deductions, "
        f"CAST({d.size('final')} AS INT) AS n_detections, windows, {d.join('status', ',')} AS status, {d.join('confirmed', ',')} AS confirmed, {d.join('rejected', ',')} AS rejected, "
        f"{told('final', f"concat(x.source, ' ', coalesce(x.skill_id, ''), ' ', {text}, ' ', {d.join('x.lines', ' / ')})")} AS detections, "
        f"{told(d.where('judged', 'x', "x.verdict <> 'accepted'"), "concat(coalesce(x.skill_id, ''), ' ', x.verdict)")} AS gated_out FROM merged"
    )
