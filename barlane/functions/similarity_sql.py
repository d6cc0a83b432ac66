"""Repeated and nearly repeated lines within plans: an Arrow function for Spark, recursive SQL for the checking engine.

The SQL states the ratio anew, from its definition: twice the characters in matching blocks over all characters, where the
first block is the longest common substring (the leftmost in the earlier text, then in the later one), and the others are
found in the same way on both sides of it. Of a later text of LONG characters or more the library leaves out the common
ones, and hardly ever finds it alike; the SQL takes such texts to be unlike.
"""
from __future__ import annotations

from .dialect import Spark

#: The name under which a session knows similarity.repeats_udf.
REPEATS = "barlane_repeats"
#: The name of similarity.top_udf.
TOP = "barlane_top"
#: The name of similarity.alike_udf.
ALIKE = "barlane_alike"
#: Characters from which the library treats a text otherwise.
LONG = 200


def blocks(pairs: str, ro: str = "ro") -> str:
    """ro: id, x, y, k: the steps of comparing the texts of `pairs` (id, x, y); k characters of each match."""
    best = "list_max(list_transform(range(len(x)), lambda i: {'k': len(list_filter(range(1, len(x) - i + 1), lambda j: contains(y, x[i + 1:i + j]))), 'at': -i}))"
    return f"""{ro} AS (
  SELECT id, x, y, 0 AS k FROM {pairs}
  UNION ALL
  SELECT id, part.x AS x, part.y AS y, part.k AS k FROM (
    SELECT id, unnest([{{'x': x[:p], 'y': y[:q], 'k': k}}, {{'x': x[p + k + 1:], 'y': y[q + k + 1:], 'k': 0}}]) AS part FROM (
      SELECT id, x, y, b.k AS k, -b.at AS p, instr(y, x[1 - b.at:b.k - b.at]) - 1 AS q FROM (
        SELECT id, x, y, {best} AS b FROM {ro} WHERE x <> '' AND y <> ''
      ) AS s1 WHERE b.k > 0
    ) AS s2
  ) AS s3
)"""


def ratios(pairs: str, ro: str = "ro", name: str = "ratio") -> str:
    """ratio: id, r of pairs (id, x, y)."""
    return f"{name} AS (SELECT p.id AS id, 2.0 * m / (len(p.x) + len(p.y)) AS r FROM {pairs} AS p JOIN (SELECT id, sum(k) AS m FROM {ro} GROUP BY id) AS t ON p.id = t.id)"


def possible(x: str, y: str, least: float) -> str:
    """Whether the ratio of two texts may reach `least`, by their lengths and then by the characters that they share."""
    count = f"list_sum(list_transform(list_distinct(string_split({x}, '')), lambda ch: least(len({x}) - len(replace({x}, ch, '')), len({y}) - len(replace({y}, ch, '')))))"
    return f"2 * least(len({x}), len({y})) >= {least} * (len({x}) + len({y})) AND 2 * {count} >= {least} * (len({x}) + len({y}))"


def repeated(d: Spark, more: str = "", but: str = "") -> tuple[str, ...]:
    """repeated: prep with dd_conf and dd_evidence, confidence and evidence of repeated lines, and more columns; but: those
    of prep that they stand for."""
    if d.name == "spark":
        return (
            f"repeated0 AS (SELECT *{but and f' EXCEPT ({but})'}, {REPEATS}(lines) AS dd{more} FROM prep)",
            "repeated AS (SELECT *, dd.confidence AS dd_conf, dd.evidence AS dd_evidence FROM repeated0)",
        )
    key = "match_id, round, side"
    return (
        f"dd_lines AS (SELECT {key}, i, lines[i] AS line, lower(lines[i]) AS low, {d.size(d.words('lines[i]'))} AS n_words FROM (SELECT {key}, lines, unnest(generate_series(1, len(lines))) AS i FROM prep) AS x)",
        f"dd_exact0 AS (SELECT {key}, low, count(*) AS c, min(i) AS i FROM dd_lines WHERE n_words > 3 GROUP BY {key}, low HAVING count(*) > 1)",
        f"dd_exact AS (SELECT {key}, count(*) AS n, list('Repeated (' || c || 'x): \"' || low[:80] || '\"' ORDER BY i)[:2] AS ev FROM dd_exact0 GROUP BY {key})",
        f"dd_pairs AS (SELECT row_number() OVER () AS id, a.match_id AS match_id, a.round AS round, a.side AS side, a.i AS i, b.i AS j, a.low AS x, b.low AS y, a.line AS la, b.line AS lb FROM dd_lines a JOIN dd_lines b "
        f"ON a.match_id = b.match_id AND a.round = b.round AND a.side = b.side AND a.i < b.i WHERE a.n_words > 4 AND b.n_words > 4 AND len(b.low) < {LONG} AND {possible('a.low', 'b.low', 0.8)})",
        "dd_kept AS MATERIALIZED (SELECT * FROM dd_pairs)",
        blocks("dd_kept"),
        ratios("dd_kept"),
        f"dd_near AS (SELECT {key}, count(*) AS n, list('Near-repeat (similarity ' || format('{{:.0f}}', r * 100) || '%): \"' || la[:50] || '\" ≈ \"' || lb[:50] || '\"' ORDER BY i, j)[:2] AS ev "
        f"FROM dd_kept JOIN ratio ON dd_kept.id = ratio.id WHERE r >= 0.8 GROUP BY {key})",
        "repeated AS (SELECT prep.*, least(CASE WHEN e.n > 0 THEN least(e.n * 0.45::DOUBLE, 0.95::DOUBLE) ELSE 0::DOUBLE END + CASE WHEN f.n > 0 THEN least(f.n * 0.35::DOUBLE, 0.6::DOUBLE) ELSE 0::DOUBLE END, 1::DOUBLE) AS dd_conf, "
        "list_concat(coalesce(e.ev, []), coalesce(f.ev, []))[:3] AS dd_evidence FROM prep "
        "LEFT JOIN dd_exact e ON prep.match_id = e.match_id AND prep.round = e.round AND prep.side = e.side LEFT JOIN dd_near f ON prep.match_id = f.match_id AND prep.round = f.round AND prep.side = f.side)",
    )
