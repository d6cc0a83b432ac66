"""The rule detectors as SQL over columns text, s (normalised), s2 (legacy normal form) and lines of a performance."""
from __future__ import annotations

from .. import rules
from ..registry import SKILLS
from .dialect import Spark, plain
from .text import snip, snip_at

# Fixed values of the detectors that look beyond pattern groups.
IMPACT = r"\b(?:dead|bodied|murdered|killed|done|over|finished|gone|erased|destroyed)\b"
OPENING = r"\b(?:dead|bodied|killed|destroyed|pressure|shook|hit|landed|punched)\b"
CLOSING = r"\b(?:dead|bodied|killed|destroyed|pressure|shook|hit|landed|punched|done|finished)\b"
EURO_SETUP = (
    r"\b(?:everyone|they|people)\s+(?:thinks?|thought|expected|assumed)\b",
    r"\b(?:normally|usually|typically|traditionally)\b",
    r"\b(?:looks?\s+like|seems?\s+like|appears?\s+to\s+be)\b",
    r"\b(?:you'?d?\s+(?:think|expect|assume))\b",
    r"\b(?:they\s+(?:said|expected|predicted))\b",
)
EURO_PIVOT = (
    r"\b(?:but\s+(?:actually|wait|no|nah|hold\s+on|then|here))\b",
    r"\b(?:plot\s+twist|surprise|wrong|nah|however)\b",
    r"\b(?:except|until|suddenly)\b",
)
ROUNDABOUT = r"\b(?:through|via|by\s+way\s+of|using|bringing\s+up)\b.{5,80}\b(?:about\s+you|talking\s+to\s+you|really\s+about\s+you)\b"
RECOVERS = (
    r"\b(?:stumbled?|choked?|forgot|messed\s+up|lost\s+(?:my\s+)?(?:place|flow))\b.{0,120}\b(?:but|still|then|yet|however)\b.{0,60}"
    r"\b(?:came\s+back|recovered?|bounced?|landed|hit|won)\b"
)
CONTRAST = r"\b(?:i|my)\s+\w+\s+(?:is|are|was|were)\s+(?:better|stronger|real|greater)\s+(?:than|compared\s+to)\s+(?:you|your|his|her)\b"
STUMBLE_MARKS = r"(?:\[(?:um+|uh+|er+|erm+)\]|\bum+\b|\buh+\b)|\.{3,}|\[(?:pause|stumble|hesitation)\]"
TOPIC_STOP = ("that", "this", "with", "your", "just", "like", "have", "been", "what", "when", "they", "then", "every", "about", "from", "make")
MID_FILLER = ("yeah", "ok", "uh", "um", "right", "now", "so", "and", "the", "a")
DRAG_FILLER = ("yeah", "ok", "uh", "um", "right", "so", "and", "like")
SETUPS = r"\b(?:i\s+(?:did|checked|found|studied|analyzed|researched|mapped|investigated|prepared|planned|built|loaded|stacked|set\s+up|constructed))\b"
ANTICLIMAX = (
    r"\b(?:and\s+(?:that'?s?\s+(?:all|it)|nothing|nothing\s+(?:else|more)))\b|\b(?:i\s+(?:couldn'?t\s+find|found\s+nothing|had\s+nothing))\b"
    r"|\b(?:still\s+couldn'?t\s+find\s+a\s+reason)\b|\b(?:and\s+forgot\s+the\s+punchline\s+existed)\b"
)
CARRY_PUNCH = r"\b(?:dead|bodied|murdered|killed|done|over|finished|erased|destroyed|demolished)\b"
FORCED = r"\b(?:you\s+broke|you\s+fake|you\s+trash|you\s+wack)\b"
FORCED_PUNCH = r"\b(?:dead|over|done|finished|bodied|murdered|destroyed|erased)\b"
STUMBLES = (
    r"(?:\[(?:um+|uh+|er+|erm+)\]|\bum+\b|\buh+\b|\berm+\b)",
    r"\[(?:pause|hesitation|stumble|trip|stutters?|stuttering)\]",
    r"\b(?:wait|hold\s+on|hold\s+up)\b",
    r"(?:\.{3,})",
)
SLAM_CONTRAST = r"\b(only|just|merely)\s+\w+\s+.*\s+(but|yet|however)"
HALF_TURN = r"\b(trauma|pain|hurt|suffering)\s+.*\s+(into|to|became)\s+(triumph|victory|success|win)"
ALLEY_ORDER = r"\b(line|set|get|put)\s+(him|them|it|you)\s+up"


def _hit(test: str) -> str:
    return f"CAST({test} AS INT)"


def hits(d: Spark, x: str, patterns, per: float, cap: float) -> str:
    """min(per * number of patterns that x has, cap)."""
    n = " + ".join(_hit(d.has(x, p)) for p in patterns)
    return f"least(({n}) * {d.f(per)}, {d.f(cap)})"


def keywords(d: Spark, x: str, words, per: float | None = None, cap: float | None = None) -> str:
    n = "(" + " + ".join(_hit(d.contains(x, d.lit(w))) for w in words) + ")"
    return n if per is None else f"least({n} * {d.f(per)}, {d.f(cap)})"


def _if(d: Spark, test: str, value: float, *more: tuple[str, float]) -> str:
    arms = "".join(f" WHEN {t} THEN {d.f(v)}" for t, v in ((test, value), *more))
    return f"CASE{arms} ELSE {d.f(0)} END"


def _any(d: Spark, x: str, patterns) -> str:
    return "(" + " OR ".join(d.has(x, p) for p in patterns) + ")"


def _where_said(d: Spark, pattern: str, value: str, none: str) -> str:
    """value, which counts words of a pattern in some of the lines, or none where the whole text has no such word."""
    return f"CASE WHEN {d.base.has('low', pattern)} THEN {value} ELSE {none} END" if d.name == "spark" else value


def _impacts(d: Spark, pattern: str, last: bool) -> str:
    """The number of impact words in the first or last quarter of the lines."""
    k = "greatest(2, CAST(floor(n / 4) AS INT))"
    own = d.part("lines", f"greatest(n - {k} + 1, 1)" if last else "1", k)
    return d.once(_where_said(d, pattern, d.count(d.folded(f"lower({d.join(own, ' ')})"), pattern), "0"))


def _edge(d: Spark, pattern: str, last: bool) -> str:
    c = _impacts(d, pattern, last)
    return _if(d, f"n >= 4 AND {c} >= 2", 0.25, (f"n >= 4 AND {c} = 1", 0.10))


def _dense(d: Spark) -> str:
    """The first lines (from 1) of all three lines in a row with two impact words or more."""
    if d.name == "spark":  # a line's words are counted once; none goes across a line's end
        each = d.each("lines", "l", f"size(regexp_extract_all({d.folded('lower(l)')}, {d.rx(IMPACT, 's')}, 0))")
        own = f"transform(array({each}), c -> {d.where(d.upto('n - 2'), 'i', 'c[i - 1] + c[i] + c[i + 1] >= 2')})[0]"
    else:
        own = d.where(d.upto("n - 2"), "i", f"{d.count(d.fold('lower(' + d.join(d.part('lines', 'i', '3'), ' ') + ')'), IMPACT)} >= 2")
    return d.once(_where_said(d, IMPACT, own, "CAST(array() AS ARRAY<INT>)"))


def top_word(d: Spark) -> str:
    """The most frequent word of four letters or more, the first of several, and its count: 'count word', or null."""
    w = d.all("s", r"\b[a-z]{4,}\b")
    if d.name == "spark":
        runs = (
            f"aggregate(array_sort({w}), named_struct('p', '', 'c', 0, 'm', 0),"
            " (a, x) -> named_struct('p', x, 'c', IF(x = a.p, a.c + 1, 1), 'm', greatest(a.m, IF(x = a.p, a.c + 1, 1))), a -> a.m)"
        )
        return f"transform(array(named_struct('w', {w}, 't', array_sort({w}), 'm', {runs})), z -> concat(z.m, ' ', try_element_at(z.w, CAST(array_min(transform(filter(sequence(1, greatest(size(z.t) - z.m + 1, 1)), i -> try_element_at(z.t, i) = try_element_at(z.t, i + z.m - 1)), i -> array_position(z.w, try_element_at(z.t, i)))) AS INT))))[0]"
    best = f"list_sort(list_transform(list_distinct({w}), lambda k: {{'c': len(list_filter({w}, lambda y: y = k)), 'p': -list_position({w}, k), 'w': k}}), 'DESC')[1]"
    return f"(SELECT b.c || ' ' || b.w FROM (SELECT {best} AS b))"


def _distinct_less(d: Spark, x: str, stop) -> str:
    """The number of distinct lower-case words of x outside stop."""
    test = "wx NOT IN (" + ", ".join(d.lit(w) for w in stop) + ")"
    return d.size(d.where(d.distinct(d.words(f"lower({x})")), "wx", test))


#: A word said twice; the other engine has no back references and looks at runs of tokens.
TWICE = r"\b(\w++)\s++\1\b"
#: Characters beyond ASCII of which folding may tell something else than whether they are letters of a word.
ODD = r"[[^\x00-\x7F]&&[\p{M}\p{Pc}\p{No}\p{So}\p{Cf}]]"


def _tokens(d: Spark) -> tuple[str, str]:
    """All tokens of the text in normal form, and where (from 1) three of them are a word, a blank and that word."""
    t = f"regexp_extract_all(plain, '[\\w\\x{{80}}-\\x{{10FFFF}}]+|\\s+|[^\\w\\s\\x{{80}}-\\x{{10FFFF}}]+')"
    return t, "list_filter(generate_series(1, len(t) - 2), lambda i: regexp_matches(t[i], '^[\\w\\x{80}-\\x{10FFFF}]') AND regexp_matches(t[i + 1], '^\\s') AND t[i + 2] = t[i])"


def repeated_word(d: Spark) -> str:
    if d.name == "spark":
        # A word said twice is one in the folded text too; Unicode classes, which cost much time, are for such texts and odd ones.
        return plain("plain", f"plain RLIKE {d.rx(TWICE, 's')}", f"((s RLIKE {d.rx(TWICE, 's')} OR plain RLIKE r'{ODD}') AND plain RLIKE {d.rx(TWICE)})")
    t, at = _tokens(d)
    return f"(SELECT len({at}) > 0 FROM (SELECT {t} AS t))"


def _repeated_word_snip(d: Spark, pad: int) -> str:
    if d.name == "spark":
        return snip(d, "plain", "text", TWICE, pad)
    t, at = _tokens(d)
    own = f"(SELECT [len(array_to_string(t[1:pos - 1], '')), len(t[pos]) * 2 + len(t[pos + 1])] FROM (SELECT t, {at}[1] AS pos FROM (SELECT {t} AS t)))"
    return snip_at(d, "text", f"{own}[1]", f"{own}[2]", pad)


def _again(d: Spark) -> str:
    """How many lines begin with three words that an earlier one begins with."""
    openings = d.each("lines", "l", f"lower({d.join(d.part(d.words('l'), '1', '3'), ' ')})")
    return d.once(f"(n - {d.size(d.distinct(openings))})", "again")


def _thin(d: Spark) -> str:
    """The number of lines of fewer than three distinct words that aren't fillers."""
    return d.once(d.size(d.where("lines", "l", f"{_distinct_less(d, 'l', DRAG_FILLER)} < 3")), "thin")


def extras(d: Spark) -> dict[str, tuple[list[str], list[str]]]:
    """By detector: parts before the pattern groups, and parts after them."""
    solid = d.once(d.size(d.where("lines", "l", f"{d.size(d.words('l'))} >= 6 AND {_distinct_less(d, 'l', MID_FILLER)} >= 4")), "solid")
    setups = d.once(d.count("s", SETUPS))
    again, thin = _again(d), _thin(d)
    tops = f"CAST({d.extract('top', '^[0-9]+')} AS INT)" if d.name == "spark" else "CAST(regexp_extract(top, '^[0-9]+') AS INT)"
    stop = ", ".join(d.lit(w) for w in TOPIC_STOP)
    stumbles = " + ".join([*(_hit(d.has("s", p)) for p in STUMBLES), _hit("twice")])
    return {
        "fast_break": ([], [_if(d, f"{d.size(_dense(d))} > 0", 0.25)]),
        "euro_step": ([_if(d, f"{_any(d, 's', EURO_SETUP)} AND {_any(d, 's', EURO_PIVOT)}", 0.50, (_any(d, "s", EURO_PIVOT), 0.20))], []),
        "hook_shot": ([], [_if(d, d.has("s", ROUNDABOUT), 0.30)]),
        "rebound": ([], [_if(d, d.has("s", RECOVERS), 0.35)]),
        "layup": ([], [_if(d, d.has("s", CONTRAST), 0.22)]),
        "midrange": ([], [_if(d, f"{solid} >= 6", 0.25, (f"{solid} >= 3", 0.12))]),
        "out_the_gate": ([], [_edge(d, OPENING, False)]),
        "fourth_quarter": ([], [_edge(d, CLOSING, True)]),
        "isolation": ([], [_if(d, f"n >= 4 AND {tops} >= 4 AND regexp_replace(top, '^[0-9]+ ', '') NOT IN ({stop})", 0.20)]),
        "breakaway": ([], [_if(d, f"n >= 8 AND NOT {d.has('s', STUMBLE_MARKS)}", 0.30)]),
        "carry": ([], [
            _if(d, f"{setups} >= 3", 0.40, (f"{setups} >= 2", 0.20)),
            _if(d, f"{setups} >= 1 AND {d.has('s', ANTICLIMAX)}", 0.30),
            _if(d, f"n >= 6 AND {setups} >= 1 AND NOT {d.has('s', CARRY_PUNCH)}", 0.20),
        ]),
        "backcourt_violation": ([], [
            _if(d, f"n >= 4 AND {again} >= 3", 0.25, (f"n >= 4 AND {again} >= 2", 0.12)),
            _if(d, f"n > 0 AND CAST({thin} AS DOUBLE) / n > {d.f(0.35)}", 0.20),
        ]),
        "forced_angle": ([], [
            _if(d, f"n >= 4 AND {d.once(d.count('s', FORCED))} >= 3", 0.30),
            _if(d, f"length(s) > 150 AND NOT {d.has('s', FORCED_PUNCH)}", 0.20),
        ]),
        "travel": ([f"least(({stumbles}) * {d.f(0.25)}, {d.f(0.60)})"], []),
        "slam_dunk": ([keywords(d, "low", rules.SLAM_DUNK_KEYWORDS, 0.12, 0.4), hits(d, "low", rules.SLAM_DUNK_PATTERNS, 0.25, 0.5), _if(d, d.has("low", SLAM_CONTRAST), 0.2)], []),
        "half_court_shot": ([keywords(d, "low", rules.HALF_COURT_KEYWORDS, 0.15, 0.4), hits(d, "low", rules.HALF_COURT_PATTERNS, 0.2, 0.4), _if(d, d.has("low", HALF_TURN), 0.2)], []),
    }


def legacy_alley_oop(d: Spark) -> str:
    parts = [
        keywords(d, "low", rules.ALLEY_OOP_KEYWORDS, 0.12, 0.3),
        hits(d, "low", rules.ALLEY_OOP_PATTERNS, 0.3, 0.5),
        _if(d, f"{d.count('text', '[' + chr(39) + chr(34) + '].*?[' + chr(39) + chr(34) + ']')} >= 2", 0.2),
        _if(d, d.has("low", ALLEY_ORDER), 0.2),
    ]
    return f"least({' + '.join(parts)}, {d.f(1)})"


#: Detectors that SQL of one row can express; the fuzzy repeat detector and the full-court shot are elsewhere.
PLAIN = [key for key, *_ in SKILLS if key not in ("double_dribble", "full_court_shot")]


def confidence(d: Spark, key: str, more: dict | None = None) -> str:
    """min(sum of parts, 1), parts added in a fixed order."""
    before, after = (more or extras(d)).get(key, ([], []))
    groups = [hits(d, "s", g.patterns, g.per_hit, g.cap) for g in rules.GROUPS.get(key, [])]
    return f"least({' + '.join([*before, *groups, *after])}, {d.f(1)})"


def _snips(d: Spark, patterns, pad: int) -> list[str]:
    """For each pattern the text around its first match, or null."""
    return [f"CASE WHEN {d.has('s', p)} THEN {snip(d, 's', 'text', p, pad)} END" for p in patterns]


def _text(d: Spark, *parts: str) -> str:
    kind = "STRING" if d.name == "spark" else "VARCHAR"
    return "concat(" + ", ".join(p if p.startswith("'") else f"CAST({p} AS {kind})" for p in parts) + ")"


def _second(d: Spark, p: str, pad: int) -> str:
    """The text around the second match of p in s; p begins and ends at word ends."""
    end = f"({d.before('s', p)} + length({d.extract('s', p)}))"
    rest = f"substring(s, {end} + 1)"
    return snip_at(d, "text", f"({end} + {d.before(rest, p)})", f"length({d.extract(rest, p)})", pad)


def _beyond(d: Spark) -> dict[str, tuple[list[str], list[str]]]:
    """By detector: evidence (or nulls) that stands before that of its pattern groups, and after it."""
    cond = lambda test, value: f"CASE WHEN {test} THEN {value} END"
    one = lambda p, pad: _snips(d, [p], pad)
    setups, again, thin = d.once(d.count("s", SETUPS)), _again(d), _thin(d)
    tops = "CAST(regexp_extract(top, '^[0-9]+', 0) AS INT)"
    word = "regexp_replace(top, '^[0-9]+ ', '')"
    stop = ", ".join(d.lit(w) for w in TOPIC_STOP)
    window = d.join(d.part("lines", d.at(_dense(d), "1"), "3"), " | ")
    share = f"CAST({'bround' if d.name == 'spark' else 'round_even'}(CAST({thin} AS DOUBLE) / n * 100, 0) AS INT)"
    stumbles = d.part(d.where(d.array([*_snips(d, STUMBLES, 20), cond("twice", _repeated_word_snip(d, 20))]), "ev", "ev IS NOT NULL"), "1", "2")
    forced = d.once(d.count("s", FORCED))
    return {
        "fast_break": ([], [cond(f"{d.size(_dense(d))} > 0", f"substring({window}, 1, 120)")]),
        "euro_step": ([cond(_any(d, "s", EURO_PIVOT), f"coalesce({', '.join(_snips(d, EURO_SETUP, 50))})")], []),
        "hook_shot": ([], one(ROUNDABOUT, 35)),
        "rebound": ([], one(RECOVERS, 10)),
        "layup": ([], one(CONTRAST, 35)),
        "out_the_gate": ([], [cond(f"n >= 4 AND {_impacts(d, OPENING, False)} >= 2", "'Strong impact density in opening lines'")]),
        "fourth_quarter": ([], [cond(f"n >= 4 AND {_impacts(d, CLOSING, True)} >= 2", "'Strong impact density in closing lines'")]),
        "isolation": ([], [cond(f"n >= 4 AND {tops} >= 4 AND {word} NOT IN ({stop})", _text(d, "'Focused angle: \"'", word, "'\" repeated '", tops, "'x'"))]),
        "breakaway": ([], [cond(f"n >= 8 AND NOT {d.has('s', STUMBLE_MARKS)}", _text(d, "n", "' lines with no stumble markers detected'"))]),
        "carry": ([], [
            cond(f"{setups} >= 3", snip(d, "s", "text", SETUPS, 35)),
            cond(f"{setups} >= 3", _second(d, SETUPS, 35)),
            cond(f"{setups} >= 1 AND {d.has('s', ANTICLIMAX)}", snip(d, "s", "text", ANTICLIMAX, 35)),
            cond(f"n >= 6 AND {setups} >= 1 AND NOT {d.has('s', CARRY_PUNCH)}", "'Extended setup without clear punchline landing'"),
        ]),
        "backcourt_violation": ([], [
            cond(f"n >= 4 AND {again} >= 3", _text(d, "'Repeated line openings: '", again, "' instances'")),
            cond(f"n > 0 AND CAST({thin} AS DOUBLE) / n > {d.f(0.35)}", _text(d, "'Filler-heavy lines: '", thin, "'/'", "n", "' ('", share, "'%)'")),
        ]),
        "forced_angle": ([], [
            cond(f"n >= 4 AND {forced} >= 3", _text(d, "'Repeated forced angle: '", forced, "'x'")),
            cond(f"length(s) > 150 AND NOT {d.has('s', FORCED_PUNCH)}", "'Long setup without a clear punch landing'"),
        ]),
        "travel": ([stumbles], []),
    }


def evidence(d: Spark, key: str, beyond: dict | None = None) -> str:
    """The detector's evidence in its order, three pieces at most, as an array."""
    before, after = (beyond or _beyond(d)).get(key, ([], []))
    listed = lambda xs: xs[0] if key == "travel" else d.where(d.array(xs), "ev", "ev IS NOT NULL")
    parts = [listed(before)] if before else []
    for g in rules.GROUPS.get(key, []):
        if g.keep:
            parts.append(d.part(d.where(d.array(_snips(d, g.patterns, g.pad)), "ev", "ev IS NOT NULL"), "1", str(g.keep)))
    if after:
        parts.append(listed(after))
    if not parts:
        return "CAST(array() AS array<string>)" if d.name == "spark" else "CAST([] AS VARCHAR[])"
    return d.part(d.flat(d.array(parts)), "1", "3")
