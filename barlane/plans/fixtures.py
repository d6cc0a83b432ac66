"""Sample relations of the domain over the tables of a folder, as common table expressions."""
from __future__ import annotations

from ..functions import text
from ..functions.detectors import repeated_word, top_word
from ..functions.dialect import Spark
from ..registry import SKILLS
from .phrases import OPENERS, PHRASES


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


#: The sides of a match.
_ROLES = "('user', 'assistant')"


def performances(d: Spark, name: str = "perf") -> str:
    """perf: match_id, round, side, text; one battler's turn in one round, with phrases added as lines of their own.

    Every turn of a battler is a performance, also one that no turn of the other side answers. Some begin with a greeting,
    some say a phrase again, exactly or nearly, and every eighth match goes on for 8 to 35 lines more.
    """
    nl, n = d.char(10), len(PHRASES)
    said = lambda i: d.at(d.array([d.lit(p) for p in PHRASES]), f"1 + ({i}) % {n}")
    opener = f"CASE conv_id % 5 WHEN 0 THEN {d.lit(OPENERS[0])} || {nl} WHEN 1 THEN {d.lit(OPENERS[1])} || {nl} ELSE '' END"
    more = d.join(d.part(d.array([d.lit(p) for p in PHRASES]), f"1 + conv_id % {n - 35}", "8 + (conv_id * 7 + turn * 3) % 28"), "\n")
    more = f"CASE conv_id % 8 WHEN 3 THEN {nl} || {more} ELSE '' END"
    again = f"CASE conv_id % 6 WHEN 0 THEN {nl} || a WHEN 1 THEN {nl} || a || ' now' WHEN 2 THEN {nl} || a || ' and once more' ELSE '' END"
    # All windows of a conversation need its rows in one place, so they are dealt out once, by the conversation.
    return f"""raw AS (SELECT /*+ REPARTITION(conv_id) */ conv_id, turn, role, text AS t FROM @conversations@ WHERE role IN {_ROLES}),
turns AS (
  SELECT conv_id, turn, t, CAST(row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS INT) AS round, CASE role WHEN 'user' THEN 'A' ELSE 'B' END AS side,
         {said('conv_id * 7 + turn')} AS a, {said('conv_id * 3 + turn * 5 + 11')} AS b
  FROM raw
),
{name} AS (SELECT conv_id AS match_id, round, side, {opener} || t || {nl} || a || {nl} || b || {more} || {again} AS text FROM turns)"""


def dealt(d: Spark, source: str) -> str:
    """source, its performances dealt out by match and round, so that a long match is the work of many tasks."""
    return f"(SELECT /*+ REPARTITION(match_id, round) */ * FROM {source})" if d.name == "spark" else source


def prepared(d: Spark, source: str = "perf") -> str:
    """prep: perf with plain (normalised), s, s2, low (folded, see dialect.FOLDED), lines, n, top and twice."""
    if d.name == "spark":  # texts of ASCII alone stand for themselves
        return f"""prep2 AS (SELECT *, lower(text) AS lowered, {text.lines(d, 'text')} AS lines FROM {source}),
prep1 AS (SELECT *, {text.norm(d, 'text', 'lowered')} AS plain, {d.folded('lowered')} AS low FROM prep2),
prep0 AS (SELECT *, {text.norm_folded(d)} AS s, {text.legacy_folded()} AS s2 FROM prep1),
prep AS (SELECT *, CAST(size(lines) AS INT) AS n, {top_word(d)} AS top, {repeated_word(d)} AS twice FROM prep0)"""
    return f"""prep1 AS (SELECT *, {text.norm(d, 'text')} AS plain, {d.fold(text.norm_legacy(d, 'text'))} AS s2, {d.fold('lower(text)')} AS low, {text.lines(d, 'text')} AS lines FROM {source}),
prep0 AS (SELECT *, {d.fold('plain')} AS s FROM prep1),
prep AS (SELECT *, CAST({d.size('lines')} AS INT) AS n, {top_word(d)} AS top, {repeated_word(d)} AS twice FROM prep0)"""


def skills(d: Spark) -> str:
    """skills: the registry."""
    rows = ", ".join(f"({i}, '{k}', '{s}', {d.lit(n)}, {d.f(p)}, '{c}', {d.f(t)})" for i, (k, s, n, p, c, t) in enumerate(SKILLS))
    return f"skills AS (SELECT * FROM (VALUES {rows}) AS v(ord, key, skill_id, skill_name, points, category, threshold))"


def windows(d: Spark, size: int = 10, overlap: int = 3) -> str:
    """wins: match_id, round, side, n, win_idx, start, stop (both from 0, stop included), win_text."""
    stride = size - overlap
    last = f"CASE WHEN n <= {size} THEN 0 ELSE CAST(ceil((n - {size}) / {d.f(stride)}) AS INT) END"
    some = f"explode(sequence(0, {last}))" if d.name == "spark" else f"unnest(generate_series(0, {last}))"
    own = f"least(win_idx * {stride} + {size}, n)"
    part = d.part("lines", f"win_idx * {stride} + 1", f"{own} - win_idx * {stride}")
    return f"""wins AS (
  SELECT match_id, round, side, n, CAST(win_idx AS INT) AS win_idx, CAST(win_idx * {stride} AS INT) AS start, CAST({own} - 1 AS INT) AS stop, {part} AS win_lines
  FROM (SELECT match_id, round, side, n, lines, {some} AS win_idx FROM prep WHERE n > 0) AS w
)"""


#: The skill (by its place in the registry) of finding det_idx of a window; some matches find the same ones in each window.
_ORD = "CAST(CASE WHEN match_id % 4 = 3 THEN (match_id * 5 + det_idx * 9) % 35 ELSE (match_id * 5 + round * 3 + win_idx * 7 + det_idx * 11) % 35 END AS INT)"


def _quotes(d: Spark, first: str, second: str) -> str:
    return f"""CASE WHEN skill_id = 'ES' AND match_id % 2 = 0 THEN {d.array([d.lit('They thought Naked was the answer'), d.lit('then Nathan ate the bacon')])}
              WHEN skill_id = 'CO' AND match_id % 2 = 0 THEN {d.array([d.lit('he is a king, no wait, a clown'), second])}
              WHEN skill_id = 'FB' AND match_id % 3 = 0 THEN {d.array([d.lit('hit after hit'), d.lit('hit after hit again')])}
              WHEN coalesce({first}, '') = '' THEN {d.array([second])} ELSE {d.array([first, second])} END"""


def answered(d: Spark) -> str:
    """answered: a sample judge's answers to the windows of scanned performances, a row for each window; some performances
    have none, some answers can't be read or come at the second try."""
    stride, size = 7, 10
    last = f"CASE WHEN n <= {size} THEN 0 ELSE CAST(ceil((n - {size}) / {d.f(stride)}) AS INT) END"
    some = f"explode_outer(CASE WHEN n > 0 THEN sequence(0, {last}) END)" if d.name == "spark" else f"unnest(CASE WHEN n > 0 THEN generate_series(0, {last}) ELSE [NULL] END)"
    stop = f"CAST(least(win_idx * {stride} + {size}, n) - 1 AS INT)"
    of = lambda k, i: d.at(d.array([d.lit(str(s[k])) for s in SKILLS]), f"{i} + 1")
    known = "SELECT match_id, round, side, n, blocked, opponent, trusted, win_idx, start, stop, win_lines"
    find = lambda i: f"""concat('{{"skill_id": "', skill{i}, '", "skill_name": "', {of(2, f'ord{i}')}, '", "points": ', {of(3, f'ord{i}')}, ', "direction": "', CASE WHEN skill{i} = 'FL' OR {of(3, f'ord{i}')} LIKE '-%' THEN 'negative' ELSE 'positive' END, '", "lines": ', {d.json(f'quoted{i}')}, ', "required_checks": ', CASE (match_id + win_idx + {i}) % 3 WHEN 0 THEN '{{}}' WHEN 1 THEN '{{"line": true, "clear": false}}' ELSE '{{"line": true}}' END, '}}')"""
    first = lambda i: d.at("win_lines", str(1 + i))
    second = d.at("win_lines", f"CASE WHEN {d.size('win_lines')} > 2 THEN {d.size('win_lines')} ELSE 1 END")
    nl = d.lit("\n")
    return f"""aw1 AS (SELECT *, CAST(win_idx0 AS INT) AS win_idx FROM (SELECT match_id, round, side, lines, n, blocked, opponent, {d.where('dets', 'x', "x.skill_id IN ('DD', 'TVL', 'CHK')")} AS trusted, {some} AS win_idx0 FROM scanned) AS w),
aw2 AS (SELECT *, CAST(win_idx * {stride} AS INT) AS start, {stop} AS stop, {d.part('lines', f'win_idx * {stride} + 1', f'{stop} - win_idx * {stride} + 1')} AS win_lines FROM aw1),
aw3 AS ({known}, {_ORD.replace('det_idx', '0')} AS ord0, {_ORD.replace('det_idx', '1')} AS ord1 FROM aw2),
aw4 AS ({known}, ord0, ord1, {of(1, 'ord0')} AS skill0, {of(1, 'ord1')} AS skill1 FROM aw3),
aw5 AS (SELECT *, {_quotes(d, first(0), second).replace('skill_id', 'skill0')} AS quoted0, {_quotes(d, first(1), second).replace('skill_id', 'skill1')} AS quoted1 FROM aw4),
aw6 AS (SELECT *, concat('{{"confirmed_rule_detections": ["DD"], "rejected_rule_detections": ', CASE (match_id + win_idx) % 4 WHEN 0 THEN '[{{"skill_id": "TVL"}}]' WHEN 1 THEN '["CHK", "DD"]' ELSE '[]' END, ', "semantic_detections": [', {find(0)}, ', ', {find(1)}, ']}}') AS body, (match_id + win_idx * 3 + round) % 9 AS v FROM aw5),
answered AS (
  SELECT match_id, round, side, n, blocked, coalesce(trim(opponent), '') <> '' AS rival, trusted, win_idx, start, stop,
         CASE v WHEN 0 THEN 'Sorry, no.' WHEN 1 THEN 'Sorry, no.' WHEN 2 THEN concat('```json', {nl}, body, {nl}, '```') WHEN 3 THEN concat('Here it is: ', body, ' Done.') WHEN 4 THEN NULL ELSE body END AS content,
         CASE v WHEN 0 THEN body WHEN 1 THEN 'Still no.' END AS again
  FROM aw6
)"""


def detections(d: Spark) -> str:
    """dets: judge findings made up from windows; two of each window, in arrival order."""
    pair = "explode(array(0, 1))" if d.name == "spark" else "unnest([0, 1])"
    first = d.at("win_lines", "1 + det_idx")
    second = d.at("win_lines", f"CASE WHEN {d.size('win_lines')} > 2 THEN {d.size('win_lines')} ELSE 1 END")
    return f"""dets0 AS (SELECT *, {pair} AS det_idx FROM wins),
dets AS (
  SELECT match_id, round, side, n, win_idx, CAST(det_idx AS INT) AS det_idx, start, stop, CAST(win_idx * 2 + det_idx AS INT) AS idx, skill_id, skill_name, points,
         CASE WHEN skill_id = 'FL' THEN 'negative' WHEN points > 0 THEN 'positive' ELSE 'negative' END AS direction,
         {_quotes(d, first, second)} AS quoted,
         CASE (match_id + win_idx + det_idx) % 3 WHEN 1 THEN 'clear' WHEN 2 THEN '' END AS failed
  FROM dets0 JOIN skills ON ord = {_ORD}
)"""
