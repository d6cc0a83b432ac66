"""Queries that both engines can express, each as SQL of a dialect over @table@ placeholders."""
from __future__ import annotations

from collections.abc import Callable

from .. import registry as reg
from .. import rules
from ..functions import detectors, fullcourt, searches, similarity_sql, text
from ..functions.dialect import HITS, Spark, noted, strip
from . import fixtures as fx
from . import reconcile as rc

Q: dict[str, Callable[[Spark], str]] = {}


def query(f: Callable[[Spark], str]) -> Callable[[Spark], str]:
    Q[f.__name__] = f
    return f


def _perf(d: Spark, select: str, *more: str, prep: bool = False) -> str:
    return fx.with_(fx.performances(d), *([fx.prepared(d, fx.dealt(d, 'perf'))] if prep else []), *more) + select


# Text operators.


def _text(name: str, make: Callable[[Spark, str], str], out: str) -> None:
    Q[name] = lambda d: _perf(d, f"SELECT match_id, round, side, {make(d, 'text')} AS {out} FROM perf")


_text("text_norm", text.norm, "s")
_text("text_norm_legacy", text.norm_legacy, "s")
_text("slang_fix", text.slang, "fixed")
_text("adlib_strip", text.adlib_strip, "kept")
_text("ogr_block", text.ogr_block, "blocked")
_text("auto_split_bars", lambda d, x: text.auto_split(d, d.replace(x, r"\n", " ")), "split_text")
Q["auto_split"] = lambda d: f"SELECT doc_id, {text.auto_split(d, 'text')} AS split_text FROM @documents@"
Q["prompt_ascii"] = lambda d: f"SELECT doc_id, {text.prompt_ascii(d, 'concat(text, ' + d.lit(chr(0x2014) + chr(0x2026) + chr(0x2192) + chr(0x2260)) + ')')} AS prompt FROM @documents@"


@query
def lines_explode(d: Spark) -> str:
    some = f"posexplode(lines) AS (p, line)" if d.name == "spark" else "generate_subscripts(lines, 1) - 1 AS p, unnest(lines) AS line"
    return _perf(d, f"SELECT match_id, round, side, CAST(p + 1 AS INT) AS line_no, line FROM (SELECT match_id, round, side, {some} FROM prep) AS x", prep=True)


@query
def evidence_snip(d: Spark) -> str:
    items = [
        {"key": f"'{key}'", "pattern": str(i), "snippet": f"CASE WHEN {d.has('s', p)} THEN {text.snip(d, 's', 'text', p, g.pad)} END"} for key, groups in rules.GROUPS.items() for g in groups for i, p in enumerate(g.patterns)
    ]
    return _perf(d, f"SELECT match_id, round, side, x.key AS key, x.pattern AS pattern, x.snippet AS snippet FROM (SELECT match_id, round, side, {rows_of(d, items)} FROM prep) AS y WHERE x.snippet IS NOT NULL", prep=True)


@query
def pattern_score(d: Spark) -> str:
    """Hits and points of each pattern group of each detector."""
    t = noted(d)  # each pattern is tested once, in a layer of its own
    n = lambda g: "CAST(" + " + ".join(f"CAST({t.has('s', p)} AS INT)" for p in g.patterns) + " AS BIGINT)"
    items = [{"key": f"'{key}'", "grp": str(i), "n_hits": n(g), "points": detectors.hits(t, "s", g.patterns, g.per_hit, g.cap)} for key, groups in rules.GROUPS.items() for i, g in enumerate(groups)]
    return _perf(d, f"SELECT match_id, round, side, x.key AS key, x.grp AS grp, x.n_hits AS n_hits, x.points AS points FROM (SELECT match_id, round, side, {rows_of(d, items)} FROM tested) AS y", f"tested AS (SELECT *, {t.layer()} FROM prep)", prep=True)


@query
def keyword_score(d: Spark) -> str:
    return _perf(d, f"SELECT match_id, round, side, {detectors.keywords(d, 'low', rules.SLAM_DUNK_KEYWORDS, 0.12, 0.4)} AS points FROM prep", prep=True)


@query
def judge_cache_key(d: Spark) -> str:
    sep = d.char(0) if d.name == "spark" else "chr(0)"
    return _perf(d, f"SELECT match_id, round, side, md5('model' || {sep} || 'system' || {sep} || text) AS cache_key FROM perf")


# Detectors.


def _effective(key: str) -> float:
    return next(reg.threshold(p, t) for k, _, _, p, _, t in reg.SKILLS if k == key)


def _det(key: str) -> Callable[[Spark], str]:
    def make(d: Spark) -> str:
        return _perf(
            d, f"SELECT match_id, round, side, round(conf, 4) AS confidence, conf >= {d.f(_effective(key))} AS fired FROM (SELECT match_id, round, side, {detectors.confidence(d, key)} AS conf FROM prep) AS c", prep=True
        )

    return make


for _key in detectors.PLAIN:
    Q[f"det_{_key}"] = _det(_key)


def _staged(d: Spark, below: str = "prep") -> tuple[str, ...]:
    """fcs: prep with the stage columns of the full-court shot; each test of a pattern is stated once, in the layer below."""
    n = noted(d)
    stages = ", ".join(f"{e} AS {k}" for k, e in fullcourt.stages(n).items())
    return f"fcs0 AS (SELECT *, {n.layer()} FROM {below})", f"fcs AS (SELECT *, {stages} FROM fcs0)"


@query
def fcs_stages(d: Spark) -> str:
    return _perf(d, "SELECT match_id, round, side, victim, weak, creation, naming, release, vague_title, CAST(n_vague AS INT) AS n_vague FROM fcs", *_staged(d), prep=True)


@query
def det_full_court_shot(d: Spark) -> str:
    return _perf(
        d, f"SELECT match_id, round, side, round(conf, 4) AS confidence, conf >= {d.f(0.45)} AS fired FROM (SELECT match_id, round, side, {fullcourt.score(d)} AS conf FROM fcs) AS c", *_staged(d), prep=True
    )


@query
def det_dd_exact(d: Spark) -> str:
    some = "explode(lines)" if d.name == "spark" else "unnest(lines)"
    return _perf(
        d,
        f"SELECT match_id, round, side, CAST(count(*) AS BIGINT) AS n_repeated, least(count(*) * {d.f(0.45)}, {d.f(0.95)}) AS confidence FROM ("
        f"SELECT match_id, round, side, lower(line) AS line FROM (SELECT match_id, round, side, {some} AS line FROM prep) AS x WHERE {d.size(d.words('line'))} > 3 "
        "GROUP BY match_id, round, side, lower(line) HAVING count(*) > 1) AS y GROUP BY match_id, round, side",
        prep=True,
    )


@query
def det_double_dribble(d: Spark) -> str:
    return _perf(d, f"SELECT match_id, round, side, round(dd_conf, 4) AS confidence, dd_conf >= {d.f(0.5)} AS fired, {d.join('dd_evidence', ' / ')} AS evidence FROM repeated", *similarity_sql.repeated(d), prep=True)


def rows_of(d: Spark, items: list[dict[str, str]]) -> str:
    """An expression that gives one struct x for each item."""
    if d.name == "spark":
        return "explode(array(" + ", ".join("named_struct(" + ", ".join(f"'{k}', {v}" for k, v in i.items()) + ")" for i in items) + ")) AS x"
    return "unnest([" + ", ".join("{" + ", ".join(f"'{k}': {v}" for k, v in i.items()) + "}" for i in items) + "]) AS x"


#: Points are added up as whole hundredths.
_INTEGER = {"spark": "INT", "duck": "BIGINT"}


def scan(d: Spark, evidence: bool = False, keep: tuple[str, ...] = (), positive: float = reg.POSITIVE, negative: float = reg.NEGATIVE, only: tuple[str, ...] = ()) -> tuple[str, ...]:
    """scanned: prep with dets, an array of the detections that reach their thresholds, in the order of the registry.

    The work of a performance stays in its row: patterns are tested once, in one layer, and no row is joined to itself.
    With `only`, Spark runs nothing but the detectors of these skills, whose few patterns are tested in the row.
    """
    spark = d.name == "spark"
    few = only if spark else ()
    n = d if few else noted(searches.searched() if spark else d)
    wanted = [(i, *skill) for i, skill in enumerate(reg.SKILLS) if not few or skill[1] in few]
    keys = {key for _, key, *_ in wanted}
    stages = ", ".join(f"{e} AS {k}" for k, e in fullcourt.stages(n).items())
    more, beyond = detectors.extras(n), detectors._beyond(n) if evidence else {}
    conf = {k: detectors.confidence(n, k, more) for k in detectors.PLAIN if k in keys} | {"full_court_shot": fullcourt.score(n), "double_dribble": "dd_conf"}
    items = []
    for i, key, skill_id, _, points, _, threshold in wanted:
        item = {"ord": str(i), "skill_id": f"'{skill_id}'", "cents": str(round(points * 100)), "conf": conf[key], "least": d.f(max(threshold, negative if points < 0 else positive))}
        if evidence:
            item["evidence"] = "dd_evidence" if key == "double_dribble" else detectors.evidence(n, key, beyond)
        items.append(item)
    layers = () if few else (f"tested AS (SELECT *, {n.layer()} FROM repeated)", f"staged AS (SELECT *, {stages} FROM tested)")
    dets, sums = d.where(d.structs(items), "x", "x.conf >= x.least"), ""
    if spark:  # confidences first, so that a detection and its evidence are only made where it is kept
        layers += (f"rated AS (SELECT *, {', '.join(f'{item["conf"]} AS conf{i}' for i, item in enumerate(items))} FROM {'repeated' if few else 'staged'})",)
        made = [f"CASE WHEN conf{i} >= {item['least']} THEN {d.struct(item | {'conf': f'conf{i}'})} END" for i, item in enumerate(items)]
        dets = d.where(d.array(made), "x", "x IS NOT NULL")
        # Those who ask for no more than sums have no array made.
        kept = lambda what: " + ".join(f"CASE WHEN conf{i} >= {item['least']} THEN {what(item)} ELSE 0 END" for i, item in enumerate(items))
        sums = f", {kept(lambda item: item['cents'])} AS cents, {kept(lambda item: '1')} AS n_dets"
    return (
        *(similarity_sql.repeated(d, f", {searches.SEARCHES}(s, s2, low) AS {HITS}, {similarity_sql.TOP}(s) AS top", "top") if spark and not few else similarity_sql.repeated(d)),
        *layers,
        f"scanned AS (SELECT match_id, round, side, text, lines, n, {''.join(c + ', ' for c in keep)}{dets} AS dets{sums} FROM {'rated' if spark else 'staged'})",
    )


def _each_of(d: Spark, a: str) -> str:
    """An element of the array in each row, or a null for an empty one: a plain explode would have Spark test the array's
    size in a filter below, and so state all that it is made of a second time."""
    return f"explode_outer({a}) AS x" if d.name == "spark" else f"unnest({a}) AS x"


def found(d: Spark, evidence: bool = False, *thresholds: float) -> tuple[str, ...]:
    """scan, and found: a row for each detection."""
    some = _each_of(d, "dets")
    return (
        *scan(d, evidence, (), *thresholds),
        fx.skills(d),
        f"""found AS (
  SELECT match_id, round, side, ord, skill_id, skill_name, points, category, CASE WHEN points > 0 THEN 'positive' ELSE 'negative' END AS direction,
         round(conf, 4) AS confidence{', evidence' if evidence else ''}
  FROM (SELECT match_id, round, side, x.ord AS o, x.conf AS conf{', x.evidence AS evidence' if evidence else ''} FROM (SELECT match_id, round, side, {some} FROM scanned) AS y WHERE x IS NOT NULL) AS z JOIN skills ON ord = o
)""",
    )


def _cents(d: Spark, dets: str) -> str:
    """The points of an array of detections."""
    own = d.each(dets, "x", "x.cents")
    total = f"aggregate({own}, 0, (a, x) -> a + x)" if d.name == "spark" else f"coalesce(list_sum({own}), 0)"
    return f"round(CAST({total} AS DOUBLE) / 100, 2)"


def _total(d: Spark) -> str:
    """The points of a scanned performance."""
    return "round(CAST(cents AS DOUBLE) / 100, 2)" if d.name == "spark" else _cents(d, "dets")


def detections_of(d: Spark, threshold: float, negative: float) -> str:
    """Every detection with its evidence, at thresholds of one's own; the registry's hold where they are higher."""
    rank = "CAST(row_number() OVER (PARTITION BY match_id, round, side ORDER BY CASE WHEN points > 0 THEN 0 ELSE 1 END, confidence DESC, ord) AS INT) AS place"
    return _perf(d, f"SELECT match_id, round, side, skill_id, skill_name, points, category, direction, confidence, evidence, {rank} FROM found", *found(d, True, threshold, negative), prep=True)


@query
def scan_detect(d: Spark) -> str:
    rank = "CAST(row_number() OVER (PARTITION BY match_id, round, side ORDER BY CASE WHEN points > 0 THEN 0 ELSE 1 END, confidence DESC, ord) AS INT) AS place"
    return _perf(d, f"SELECT match_id, round, side, skill_id, skill_name, points, category, direction, confidence, {rank} FROM found", *found(d), prep=True)


_TOTAL = "round(CAST(sum(CAST(points AS DECIMAL(8, 2))) AS DOUBLE), 2)"


@query
def scan_total(d: Spark) -> str:
    return _perf(d, f"SELECT match_id, round, side, CAST({'n_dets' if d.name == 'spark' else d.size('dets')} AS BIGINT) AS n, {_total(d)} AS total FROM scanned", *scan(d), prep=True)


@query
def scan_split(d: Spark) -> str:
    count = lambda test: f"CAST({d.size(d.where('dets', 'x', test))} AS BIGINT)"
    return _perf(d, f"SELECT match_id, round, side, {count('x.cents > 0')} AS n_highlights, {count('x.cents < 0')} AS n_mistakes FROM scanned", *scan(d), prep=True)


def attributed(d: Spark) -> tuple[str, ...]:
    """placed: scanned with spots, an array of detections with best, the line (from 1) that holds most probes of the evidence, -1 for none."""
    words = d.words("lower(ev)")
    pairs = d.each(d.upto(f"{d.size(words)} - 1"), "i", d.join(d.part(words, "i", "2"), " "))
    both = f"concat({d.where(words, 'w', 'length(w) >= 5')}, {pairs})" if d.name == "spark" else f"list_concat({d.where(words, 'w', 'length(w) >= 5')}, {pairs})"
    probes = d.flat(d.each("x.evidence", "ev", both))
    if d.name == "spark":  # each piece's words are taken once, not for each pair anew
        pairs = d.each(d.upto("size(ws) - 1"), "i", d.join(d.part("ws", "i", "2"), " "))
        probes = d.flat(d.each(d.each("x.evidence", "ev", words), "ws", f"concat({d.where('ws', 'w', 'length(w) >= 5')}, {pairs})"))
    hits = d.each("lows", "l", d.size(d.where("x.probes", "p", d.contains("l", "p"))))
    most, where = ("array_max(x.hits)", "array_position(x.hits, array_max(x.hits))") if d.name == "spark" else ("list_max(x.hits)", "list_position(x.hits, list_max(x.hits))")
    keep = {k: f"x.{k}" for k in ("ord", "skill_id", "cents")}
    return (
        f"probed AS (SELECT match_id, round, side, lines, {d.each('lines', 'l', 'lower(l)')} AS lows, {d.each('dets', 'x', d.struct({**keep, 'probes': probes}))} AS dets FROM scanned)",
        f"counted AS (SELECT match_id, round, side, lines, {d.each('dets', 'x', d.struct({**keep, 'hits': hits}))} AS dets FROM probed)",
        f"placed AS (SELECT match_id, round, side, lines, {d.each('dets', 'x', d.struct({**keep, 'best': f'CASE WHEN {most} > 0 THEN CAST({where} AS INT) ELSE -1 END'}))} AS spots FROM counted)",
    )


@query
def line_attribution(d: Spark) -> str:
    return _perf(d, f"SELECT match_id, round, side, x.skill_id AS skill_id, x.best AS best FROM (SELECT match_id, round, side, {_each_of(d, 'spots')} FROM placed) AS y WHERE x IS NOT NULL", *scan(d, True), *attributed(d), prep=True)


@query
def line_scores(d: Spark) -> str:
    """Every line, with the detections placed on it; those without a line are on the first."""
    if d.name == "spark":
        some = "posexplode(lines) AS (p, line)"
    else:
        some = "generate_subscripts(lines, 1) - 1 AS p, unnest(lines) AS line"
    own = d.where("spots", "x", "greatest(x.best, 1) = p + 1")
    return _perf(
        d,
        f"SELECT match_id, round, side, CAST(p + 1 AS INT) AS line_no, line, CAST({d.size('own')} AS BIGINT) AS n_skills, {d.join(d.each('own', 'x', 'x.skill_id'), ',')} AS skills, {_cents(d, 'own')} AS line_score "
        f"FROM (SELECT match_id, round, side, p, line, {own} AS own FROM (SELECT match_id, round, side, spots, {some} FROM placed) AS y) AS z",
        *scan(d, True), *attributed(d), prep=True,
    )


@query
def legacy_matrix(d: Spark) -> str:
    own = f"round({detectors.confidence(d, 'slam_dunk')}, 6) AS sd, round({detectors.confidence(d, 'half_court_shot')}, 6) AS hcs, round({detectors.legacy_alley_oop(d)}, 6) AS aly"
    return _perf(d, f"SELECT match_id, round, side, round({fullcourt.score(d)}, 6) AS fcs, {own} FROM fcs", *_staged(d), prep=True)


@query
def list_skills(d: Spark) -> str:
    """The registry, with how often each skill is among the sample findings."""
    return _perf(
        d, "SELECT CAST(s.ord AS INT) AS ord, s.key AS key, s.skill_id AS skill_id, s.skill_name AS skill_name, s.points AS points, category, threshold, count(d.idx) AS n_found "
        "FROM skills s LEFT JOIN dets d ON s.skill_id = d.skill_id GROUP BY s.ord, s.key, s.skill_id, s.skill_name, s.points, category, threshold", *_dets(d), prep=True,
    )


@query
def technique_info(d: Spark) -> str:
    rows = ", ".join("(" + ", ".join(d.lit(x) for x in t) + ")" for t in reg.TECHNIQUES)
    return _perf(
        d, f"SELECT {_KEYS}, idx, key, name, value_text, description FROM dets JOIN (SELECT key, skill_id AS own FROM skills) AS k ON skill_id = own LEFT JOIN info ON technique = key",
        *_dets(d), f"info AS (SELECT * FROM (VALUES {rows}) AS v(technique, name, value_text, description))", prep=True,
    )


# Windows and the judge.


@query
def line_windows(d: Spark) -> str:
    return _perf(d, f"SELECT match_id, round, side, win_idx, start, stop, {d.join('win_lines', chr(10))} AS win_text FROM wins", fx.windows(d), prep=True)


@query
def window_position(d: Spark) -> str:
    return _perf(d, f"SELECT match_id, round, side, win_idx, {rc.POSITION} AS position FROM wins", fx.windows(d), prep=True)


def _dets(d: Spark) -> tuple[str, ...]:
    return fx.windows(d), fx.skills(d), fx.detections(d)


@query
def position_filter(d: Spark) -> str:
    blocked = f"blocks AS (SELECT match_id AS bm, round AS br, side AS bs, {text.ogr_block(d, 'text')} AS blocked FROM perf)"
    return _perf(
        d,
        f"SELECT match_id, round, side, idx, skill_id FROM dets JOIN blocks ON match_id = bm AND round = br AND side = bs WHERE {rc.in_place('skill_id')}",
        *_dets(d), blocked, prep=True,
    )


@query
def prompt_build(d: Spark) -> str:
    opener = f"CASE WHEN {rc.POSITION} = 'opener' THEN 'opening' WHEN {rc.POSITION} = 'closer' THEN 'closing' ELSE 'middle' END"
    return _perf(
        d, f"SELECT match_id, round, side, win_idx, concat('Judge lines ', start + 1, '-', stop + 1, ' of ', n, ' (', {opener}, ').', {d.lit(chr(10))}, {d.join('win_lines', chr(10))}) AS prompt FROM wins", fx.windows(d), prep=True
    )


@query
def judge_cache_split(d: Spark) -> str:
    key = f"md5({d.join('win_lines', chr(10))})"
    return _perf(
        d,
        "SELECT w.match_id, w.round, w.side, w.win_idx, w.cache_key, c.cache_key IS NOT NULL AS cached FROM keyed w LEFT JOIN (SELECT DISTINCT cache_key FROM keyed WHERE match_id % 3 = 0) c ON w.cache_key = c.cache_key",
        fx.windows(d), f"keyed AS (SELECT match_id, round, side, win_idx, {key} AS cache_key FROM wins)", prep=True,
    )


def turns(d: Spark) -> tuple[str, ...]:
    """perf, cleaned, of the sample performances, with blocked and opponent, the lines that a turn answers."""
    own = f"turns1 AS (SELECT *, lag(text) OVER (PARTITION BY match_id ORDER BY round, side) AS opponent FROM turns0)"
    return fx.performances(d, "turns0"), own, *cleaned(d, fx.dealt(d, "turns1"))


def cleaned(d: Spark, source: str) -> tuple[str, ...]:
    """perf: source with its text's slang corrected, walls of text cut and ad-libs dropped, and blocked."""
    keep = "match_id, round, side, opponent"
    return (
        f"clean1 AS (SELECT {keep}, {text.slang(d, 'text')} AS t FROM {source})",
        f"clean2 AS (SELECT {keep}, {text.auto_split(d, 't')} AS t FROM clean1)",
        f"clean3 AS (SELECT {keep}, {text.adlib_strip(d, 't')} AS text FROM clean2)",
        f"perf AS (SELECT *, {text.ogr_block(d, 'text')} AS blocked FROM clean3)",
    )


def judged(d: Spark) -> tuple[str, ...]:
    """The whole hybrid path over the sample performances and a table of answers: everything of reconcile.layers."""
    return *turns(d), fx.prepared(d), *scan(d, True, keep=("opponent", "blocked"), only=reg.TRUSTED), fx.answered(d), *rc.layers(d)


def _hybrid(name: str, select: Callable[[Spark], str]) -> None:
    Q[name] = lambda d: fx.with_(*judged(d)) + select(d)


def _rows(d: Spark, a: str, source: str, keep: str = "match_id, round, side") -> str:
    """A row for each element x of an array."""
    return f"(SELECT {keep}, x FROM (SELECT {keep}, {_each_of(d, a)} FROM {source}) AS e WHERE x IS NOT NULL) AS r"


_hybrid("hybrid_full", rc.summary)
_hybrid("json_recover", lambda d: f"SELECT match_id, round, side, win_idx, state, CAST({d.size('said')} AS INT) AS n_findings, {d.join('confirmed0', ',')} AS confirmed, {d.join('rejected0', ',')} AS rejected FROM parsed WHERE win_idx IS NOT NULL")
_hybrid("judge_flatten", lambda d: f"SELECT match_id, round, side, win_idx, x.skill_id AS skill_id, x.points AS points, x.failed AS failed, {d.join('x.lines', ' / ')} AS quoted FROM {_rows(d, 'said', 'parsed', 'match_id, round, side, win_idx')}")


# Reconciliation.
_KEYS = "match_id, round, side"


@query
def dynamic_caps(d: Spark) -> str:
    return _perf(d, f"SELECT {_KEYS}, skill_id, {rc.cap(d, 'skill_id', 'n')} AS cap FROM (SELECT DISTINCT match_id, round, side, n FROM prep) AS p CROSS JOIN skills", fx.skills(d), prep=True)


@query
def cap_enforce(d: Spark) -> str:
    return _perf(
        d, f"SELECT {_KEYS}, idx, skill_id FROM (SELECT *, row_number() OVER (PARTITION BY {_KEYS}, skill_id ORDER BY idx) AS k, {rc.cap(d, 'skill_id', 'n')} AS cap FROM dets) AS x WHERE k <= cap", *_dets(d), prep=True
    )


def _quoted(d: Spark, x: str) -> str:
    """The quoted lines, lower-case and stripped, without blank ones."""
    return d.where(d.each(x, "ql", f"lower({strip(d, 'ql')})"), "ql", "ql <> ''")


@query
def dedup_exact(d: Spark) -> str:
    lines = d.join(_quoted(d, "quoted"), "\n")
    return _perf(d, f"SELECT {_KEYS}, idx, skill_id, points FROM (SELECT *, row_number() OVER (PARTITION BY {_KEYS}, skill_id, {lines} ORDER BY points DESC, idx) AS k FROM dets) AS x WHERE k = 1", *_dets(d), prep=True)


@query
def lines_contained(d: Spark) -> str:
    test = d.any_in("a.own", "qa", d.any_in("b.own", "qb", f"{d.contains('qa', 'qb')} OR {d.contains('qb', 'qa')}"))
    return _perf(
        d,
        f"SELECT a.match_id, a.round, a.side, a.idx AS idx_a, b.idx AS idx_b FROM quotes a JOIN quotes b ON a.match_id = b.match_id AND a.round = b.round AND a.side = b.side AND a.idx < b.idx WHERE {test}",
        *_dets(d), f"quotes AS (SELECT {_KEYS}, idx, {_quoted(d, 'quoted')} AS own FROM dets)", prep=True,
    )


@query
def fix_fl(d: Spark) -> str:
    return _perf(d, f"SELECT {_KEYS}, idx, skill_id, {rc.direction('skill_id', 'direction')} AS direction FROM dets", *_dets(d), prep=True)


def _relabel(d: Spark, test: str, to: str, points: float) -> str:
    return f"CASE WHEN {test} THEN '{to}' ELSE skill_id END AS skill_id, CASE WHEN {test} THEN {d.f(points)} ELSE points END AS points"


@query
def fix_fb_lines(d: Spark) -> str:
    return _perf(d, f"SELECT {_KEYS}, idx, {_relabel(d, rc.short_break(d, 'skill_id', 'quoted'), 'MR', 1.35)} FROM dets", *_dets(d), prep=True)


@query
def fix_co(d: Spark) -> str:
    return _perf(d, f"SELECT {_KEYS}, idx, {_relabel(d, rc.corrected(d, 'skill_id', 'quoted'), 'MR', 1.35)} FROM dets", *_dets(d), prep=True)


@query
def fix_es(d: Spark) -> str:
    return _perf(d, f"SELECT {_KEYS}, idx, {_relabel(d, rc.swapped(d, 'skill_id', 'quoted'), 'LU', 1.25)} FROM dets", *_dets(d), prep=True)


def _arrays(d: Spark, skill: str = "skill_id") -> tuple[str, ...]:
    """collected: the sample findings of a performance as an array `said`, in arrival order."""
    item = d.struct({"idx": "idx", "pos": "idx", "skill_id": skill, "points": "points", "direction": "direction", "lines": "quoted", "keys": rc.keys(d, "quoted")})
    first = "first" if d.name == "spark" else "any_value"
    return *_dets(d), f"collected AS (SELECT {_KEYS}, {first}(n) AS n, {d.listed(item, 'idx')} AS said FROM dets GROUP BY {_KEYS})"


@query
def dedup_greedy(d: Spark) -> str:
    kept = d.each("kept", "i", d.at("said", "i"))
    return _perf(d, f"SELECT {_KEYS}, x.idx AS idx, x.skill_id AS skill_id, x.points AS points FROM {_rows(d, kept, 'folded')}", *_arrays(d), *rc.alike(d), f"folded AS (SELECT *, {rc.accepted(d)} AS kept FROM alike)", prep=True)


@query
def lines_similar(d: Spark) -> str:
    """Which earlier findings (other) have a line like one of a finding's, whatever their skills."""
    pairs = d.flat(d.each(d.upto(d.size("said")), "q", d.each(d.at("near", "q"), "e", d.struct({"idx": f"{d.at('said', 'q')}.idx", "other": f"{d.at('said', 'e')}.idx"}))))
    return _perf(d, f"SELECT {_KEYS}, x.idx AS idx, x.other AS other FROM {_rows(d, pairs, 'alike')}", *_arrays(d, "'any'"), *rc.alike(d), prep=True)


@query
def fix_fb_dup(d: Spark) -> str:
    each = d.each(d.upto(d.size("said")), "q", d.struct({"idx": f"{d.at('said', 'q')}.idx", "skill_id": f"{d.at('said', 'q')}.skill_id", "points": f"{d.at('said', 'q')}.points", "repeats": d.at("repeats", "q")}))
    return _perf(d, f"SELECT {_KEYS}, idx, {_relabel(d, 'repeats', 'MR', 1.35)} FROM (SELECT {_KEYS}, x.idx AS idx, x.skill_id AS skill_id, x.points AS points, x.repeats AS repeats FROM {_rows(d, each, 'alike')}) AS b WHERE skill_id = 'FB'", *_arrays(d), *rc.alike(d), prep=True)


@query
def line_ownership(d: Spark) -> str:
    return _perf(d, f"SELECT {_KEYS}, x.idx AS idx, x.skill_id AS skill_id FROM {_rows(d, d.where('said', 'x', rc.owns(d, 'x', 'said')), 'collected')}", *_arrays(d), prep=True)


@query
def stl_block(d: Spark) -> str:
    rivals = f"rivals AS (SELECT match_id AS rm, round AS rr, side AS rs, coalesce(trim(lag(text) OVER (PARTITION BY match_id ORDER BY round, side)), '') <> '' AS rival FROM perf)"
    return _perf(d, f"SELECT {_KEYS}, idx, skill_id FROM dets JOIN rivals ON match_id = rm AND round = rr AND side = rs WHERE {rc.answers_someone('skill_id', 'rival')}", *_dets(d), rivals, prep=True)


@query
def hard_gates(d: Spark) -> str:
    return _perf(d, f"SELECT {_KEYS}, idx, skill_id, {rc.gate('skill_id', 'failed')} AS verdict FROM dets", *_dets(d), prep=True)


@query
def dd_deliberate(d: Spark) -> str:
    return _perf(d, f"SELECT {_KEYS}, {d.join('dd_evidence', ' / ')} AS evidence, {rc.deliberate(d, 'dd_evidence')} AS deliberate FROM repeated WHERE {d.size('dd_evidence')} > 0", *similarity_sql.repeated(d), prep=True)


_hybrid("merge_sources", lambda d: f"SELECT {_KEYS}, x.skill_id AS skill_id, x.points AS points, x.direction AS direction, x.source AS source FROM {_rows(d, 'final', 'merged')}")
_hybrid("hybrid_total", lambda d: f"SELECT {_KEYS}, total, highlights, deductions FROM ({rc.summary(d)}) AS t")


# Match analytics.


def scores(d: Spark, below: tuple[str, ...] | None = None, scored: str | None = None) -> tuple[str, ...]:
    """rounds: both sides' totals and the round's winner, of rounds that both sides have; verdicts: each match's wins."""
    below = scan(d) if below is None else below
    scored = scored or f"SELECT match_id, round, side, {_total(d)} AS total FROM scanned"
    return (
        *below,
        f"scored AS ({scored})",
        "totals AS (SELECT match_id, round, max(CASE side WHEN 'A' THEN total END) AS a, max(CASE side WHEN 'B' THEN total END) AS b FROM scored GROUP BY match_id, round HAVING count(DISTINCT side) = 2)",
        f"rounds AS (SELECT *, CASE WHEN abs(round(a - b, 2)) <= {d.f(reg.TIE)} THEN 'tie' WHEN a > b THEN 'A' ELSE 'B' END AS winner FROM totals)",
        f"verdicts AS (SELECT match_id, CAST(count(*) AS INT) AS n_rounds, CAST(sum(CASE winner WHEN 'A' THEN 1 WHEN 'tie' THEN 0.5 ELSE 0 END) AS DOUBLE) AS a_wins, CAST(sum(CASE winner WHEN 'B' THEN 1 WHEN 'tie' THEN 0.5 ELSE 0 END) AS DOUBLE) AS b_wins FROM rounds GROUP BY match_id)",
    )


def _g(d: Spark, x: str) -> str:
    return d.replace(f"CAST({x} AS STRING)" if d.name == "spark" else f"CAST({x} AS VARCHAR)", r"\.0$", "")


def _match(name: str, make: Callable[[Spark], str]) -> None:
    Q[name] = lambda d: _perf(d, make(d), *scores(d), prep=True)


_match("round_winner", lambda d: "SELECT match_id, round, a, b, winner FROM rounds")
_match(
    "match_verdict",
    lambda d: "SELECT match_id, n_rounds, a_wins, b_wins, CASE WHEN a_wins > b_wins THEN 'A' WHEN b_wins > a_wins THEN 'B' ELSE 'tie' END AS winner, "
    f"CASE WHEN a_wins > b_wins THEN concat('A wins ', {_g(d, 'a_wins')}, '-', {_g(d, 'b_wins')}) WHEN b_wins > a_wins THEN concat('B wins ', {_g(d, 'b_wins')}, '-', {_g(d, 'a_wins')}) "
    f"ELSE concat('Tie ', {_g(d, 'a_wins')}, '-', {_g(d, 'b_wins')}) END AS summary FROM verdicts",
)
_match("hprp_delta", lambda d: "SELECT match_id, round(CAST(sum(CASE winner WHEN 'A' THEN CAST(abs(a - b) AS DECIMAL(12, 2)) WHEN 'B' THEN -CAST(abs(a - b) AS DECIMAL(12, 2)) ELSE 0 END) AS DOUBLE), 2) AS delta_a, "
       "round(CAST(sum(CASE winner WHEN 'B' THEN CAST(abs(a - b) AS DECIMAL(12, 2)) WHEN 'A' THEN -CAST(abs(a - b) AS DECIMAL(12, 2)) ELSE 0 END) AS DOUBLE), 2) AS delta_b FROM rounds GROUP BY match_id")  # fmt: skip
_SCORES = "CAST(CASE WHEN a_wins >= b_wins THEN ceil(a_wins) ELSE floor(a_wins) END AS INT) AS score1, CAST(CASE WHEN a_wins >= b_wins THEN floor(b_wins) ELSE ceil(b_wins) END AS INT) AS score2"
_match("score_columns", lambda d: f"SELECT match_id, {_SCORES} FROM verdicts")
_match("ai_score", lambda d: "SELECT match_id, round(CAST(sum(CAST(a AS DECIMAL(12, 2))) AS DOUBLE), 2) AS ai_score1, round(CAST(sum(CAST(b AS DECIMAL(12, 2))) AS DOUBLE), 2) AS ai_score2 FROM rounds GROUP BY match_id")
_match("verdict_next_state", lambda d: f"SELECT match_id, concat(CAST(score1 AS {'STRING' if d.name == 'spark' else 'VARCHAR'}), '-', score2) AS verdict, score1, score2 FROM (SELECT match_id, {_SCORES} FROM verdicts) AS v")


@query
def match_full(d: Spark) -> str:
    """Verdicts of the sample matches by rules and a table of answers."""
    winner = "CASE WHEN a_wins > b_wins THEN 'A' WHEN b_wins > a_wins THEN 'B' ELSE 'tie' END AS winner"
    return fx.with_(*scores(d, judged(d), f"SELECT {_KEYS}, total FROM ({rc.summary(d)}) AS t")) + f"SELECT match_id, n_rounds, a_wins, b_wins, {winner}, {_SCORES} FROM verdicts"


@query
def rebuttal_chain(d: Spark) -> str:
    return _perf(d, "SELECT match_id, round, side, lag(md5(text)) OVER (PARTITION BY match_id ORDER BY round, side) AS answers FROM perf")


@query
def tie_default(d: Spark) -> str:
    return f"SELECT o_orderkey, coalesce(nullif(round(o_totalprice - floor(o_totalprice), 1), 0), {d.f(reg.TIE)}) AS tie_threshold FROM @orders@"


@query
def payload_validate(d: Spark) -> str:
    return (
        "SELECT conv_id, turn, CASE WHEN turn % 5 = 0 THEN concat('Round ', turn + 1, ': missing side a') WHEN turn % 7 = 0 THEN concat('Round ', turn + 1, ': missing side b') END AS error, "
        "coalesce(nullif(CASE WHEN turn % 2 = 0 THEN '' ELSE role END, ''), 'A') AS battler_a FROM @conversations@"
    )


@query
def error_envelope(d: Spark) -> str:
    """What is wrong with a match's payload: every conversation as one, some broken on purpose."""
    t = "to_json(named_struct('a', text))" if d.name == "spark" else "CAST(to_json({'a': text}) AS VARCHAR)"
    body = f"CASE (conv_id + turn) % 5 WHEN 0 THEN '{{\"rounds\": []}}' WHEN 1 THEN concat('{{\"rounds\": [', {t}, ']}}') WHEN 2 THEN concat('{{\"rounds\": [', {t}) ELSE concat('{{\"rounds\": [{{\"a\": ', substring({t}, 6, length({t}) - 6), ', \"b\": ', CASE (conv_id + turn) % 5 WHEN 3 THEN '\" \"' ELSE '\"x\"' END, '}}]}}') END"
    if d.name == "spark":
        p = "from_json(body, 'rounds ARRAY<STRUCT<a: STRING, b: STRING>>, _corrupt_record STRING')"
        test = "CASE WHEN p._corrupt_record IS NOT NULL THEN 'invalid_json' WHEN size(p.rounds) < 1 OR exists(p.rounds, r -> trim(coalesce(r.a, '')) = '' OR trim(coalesce(r.b, '')) = '') THEN 'invalid_payload' END"
    else:
        p = "CASE WHEN json_valid(body) THEN from_json(json_extract(body, '$.rounds'), '[{\"a\": \"VARCHAR\", \"b\": \"VARCHAR\"}]') END"
        test = "CASE WHEN p IS NULL THEN 'invalid_json' WHEN len(p) < 1 OR len(list_filter(p, lambda r: trim(coalesce(r.a, '')) = '' OR trim(coalesce(r.b, '')) = '')) > 0 THEN 'invalid_payload' END"
    return f"SELECT conv_id, turn, error, error IS NULL AS ok FROM (SELECT conv_id, turn, {test} AS error FROM (SELECT conv_id, turn, {p} AS p FROM (SELECT conv_id, turn, {body} AS body FROM @conversations@) AS b) AS q) AS e"


@query
def progress_events(d: Spark) -> str:
    n = "count(*) OVER (PARTITION BY match_id)"
    pct = f"CAST(15 + floor((row_number() OVER (PARTITION BY match_id ORDER BY round, side) - 1) / greatest(CAST({n} AS DOUBLE), 1) * 70) AS INT)"
    return _perf(d, f"SELECT match_id, round, side, 'scoring' AS phase, least(greatest({pct}, 0), 100) AS percent FROM perf")


# Relational operators over the mapped tables.


@query
def list_livestreams(d: Spark) -> str:
    return "SELECT c_custkey AS id, c_name AS title, count(*) AS n, min(o_orderdate) AS first_created, max(o_orderdate) AS last_created FROM @orders@ JOIN @customer@ ON o_custkey = c_custkey GROUP BY c_custkey, c_name"


@query
def latest_transcript(d: Spark) -> str:
    return "SELECT user_id, event_type, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM @events@) AS x WHERE k = 1"


@query
def resolve_name(d: Spark) -> str:
    s = "STRING" if d.name == "spark" else "VARCHAR"
    return (
        f"SELECT o_orderkey AS id, coalesce(nullif(CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_mktsegment END, ''), nullif(c_name, ''), nullif(owner, ''), CAST(o_orderkey AS {s})) AS name "
        f"FROM (SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 5 = 0 THEN -1 ELSE o_custkey END AS {s}) AS owner FROM @orders@) AS b LEFT JOIN @customer@ ON CAST(c_custkey AS {s}) = owner"
    )


@query
def first_rapper(d: Spark) -> str:
    return "SELECT n_nationkey AS id, nullif(CASE WHEN n_nationkey % 4 = 0 THEN '' ELSE n_name END, '') AS first_rapper FROM @nation@"


@query
def assign_sides(d: Spark) -> str:
    pick = "min_by(event_type, struct(ts, event_id))" if d.name == "spark" else "arg_min(event_type, {'a': ts, 'b': event_id})"
    return (
        f"SELECT user_id, coalesce(max(CASE WHEN event_type = wanted THEN event_type END), {pick}) AS side_a, count(*) >= 2 AS complete FROM ("
        "SELECT *, CASE WHEN user_id % 2 = 0 THEN 'click' ELSE 'none' END AS wanted, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM @events@) AS x WHERE k = 1 GROUP BY user_id"
    )


@query
def pivot_rounds(d: Spark) -> str:
    return _perf(
        d, "SELECT match_id, CAST(row_number() OVER (PARTITION BY match_id ORDER BY round) AS INT) AS round, a, b FROM (SELECT match_id, round, max(CASE side WHEN 'A' THEN md5(text) END) AS a, max(CASE side WHEN 'B' THEN md5(text) END) AS b FROM perf GROUP BY match_id, round) AS p"
    )


def _accounts(d: Spark) -> str:
    s = "STRING" if d.name == "spark" else "VARCHAR"
    own = f"bruf AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_custkey AS {s}) ELSE concat('Customer#', o_custkey) END AS owner FROM @orders@)"
    acc = f"acc AS (SELECT CAST(c_custkey AS {s}) AS id, concat('Customer#', c_custkey) AS username FROM @customer@)"
    return f"{own}, {acc}"


@query
def account_lookup(d: Spark) -> str:
    return fx.with_(_accounts(d)) + "SELECT b.id AS bruf, a.id AS account FROM bruf b JOIN acc a ON a.id = b.owner UNION SELECT b.id AS bruf, a.id AS account FROM bruf b JOIN acc a ON a.username = b.owner"


_match(
    "account_next_state",
    lambda d: "SELECT match_id, side, CASE WHEN (side = 'A') = (a_wins >= b_wins) THEN 1 ELSE 0 END AS wins, CASE WHEN (side = 'A') = (a_wins >= b_wins) THEN 0 ELSE 1 END AS losses, "
    "CASE WHEN (side = 'A') = (a_wins >= b_wins) THEN score1 ELSE score2 END AS bp, CASE WHEN side = 'A' THEN score1 ELSE score2 END AS bp_by_side "
    f"FROM (SELECT match_id, a_wins, b_wins, {_SCORES} FROM verdicts) AS v CROSS JOIN (SELECT * FROM (VALUES ('A'), ('B')) AS s(side)) AS s",
)


@query
def verdict_guard(d: Spark) -> str:
    return (
        "SELECT o_orderkey, CASE WHEN count(*) > 1 THEN 'refuse' WHEN max(CASE o_orderstatus WHEN 'F' THEN 1 ELSE 0 END) = 1 THEN 'skip' ELSE 'score' END AS action "
        "FROM (SELECT o_orderkey, o_orderstatus FROM @orders@ UNION ALL SELECT o_orderkey, o_orderstatus FROM @orders@ WHERE o_orderstatus = 'P') AS o GROUP BY o_orderkey"
    )


@query
def match_complete(d: Spark) -> str:
    """Matches of which both sides of every round are there."""
    return _perf(d, "SELECT match_id, n, rounds FROM (SELECT match_id, count(*) AS n, count(DISTINCT turn_of) AS sides, max(round) AS rounds FROM (SELECT match_id, round, concat(round, side) AS turn_of FROM perf) AS p GROUP BY match_id) AS q WHERE sides = 2 * rounds")
