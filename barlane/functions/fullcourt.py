"""The full-court shot: gates on victim, pipeline and wording, then weights, in stages of columns."""
from __future__ import annotations

from .. import rules
from .detectors import _any, _if, hits, keywords
from .dialect import Spark

# Fixed values.
PENALTIES = (
    (r"\b(some\s+kind\s+of|somehow|did\s+a\s+thing|felt\s+like|was\s+off|was\s+different)", 0.3),
    (r"\b(made\s+content\s+about|noticed\s+it|saw\s+it)", 0.2),
    (r"\b(felt|reacted|moved|changed|existed|showed|needed|could\s+measure|was\s+long)", 0.15),
)
_V1 = r"\b(pulled|grabbed|captured|caught|snapped|clipped|recorded|ran|got|printed|wrote|filed|issued|opened|logged|tracked|made|created|pushed|posted|built|constructed|assembled|erected)\s+"
_V2 = r"\b(titled|named|called|labeled|tagged)\s+(it|this|that|the)\s+"
_V3 = r"\b(dropped|released|unveiled|debuted|aired|broadcast|streamed|premiered|uploaded|published|opened|launched|presented)\s+"
TRIPLE = _V1 + "[^.]*?" + _V2 + "[^.]*?" + _V3
TWO_PART = (
    r"(?:by\s+the\s+end|the\s+moment|after|mid|when|that\s+round|soon\s+as).*?your\s+\w+\s+(?:was|got|left|went|vanished|disappeared|erased|faded|gone|"
    r"got\s+(?:stolen|deleted|rerouted|repossessed|packed|shipped))[^.]*?\bi\s+"
)
VANISHED = r"\b(erased|vanished|disappeared|faded|gone)\s+(on|from|in)\s+(camera|film|tape|video|recording)"
_NAMED = r"\b(?:titled|named|called|labeled|tagged)\s+(?:it|this|that|the)\s+"
#: The naming patterns without look-ahead; the second needs one of more words after the title.
NAMING = (
    _NAMED + r"[^\s]+(?:\s+[^\s]+)*?\s+(?:and|then|so)",
    _NAMED + r"[^\s]+(?:\s+[^\s]+)*?\s+(?:and|then|so|dropped|released|opened|published|aired|premiered|streamed|uploaded|unveiled|put\s+out|broadcast)",
    _NAMED + r"\w+",
)


def _listed(d: Spark, x: str, words) -> str:
    """Whether x has a word as a substring, or a phrase at word ends."""
    return "(" + " OR ".join(d.has(x, r"\b" + w + r"\b") if " " in w else d.contains(x, d.lit(w)) for w in words) + ")"


def _titles(d: Spark) -> tuple[str, list[str]]:
    """The first title, and for each naming pattern the text after its match up to the next connector."""
    first = NAMING[0].replace("[^\\s]+(?:\\s+[^\\s]+)*?", "([^\\s]+(?:\\s+[^\\s]+)*?)", 1)
    second = NAMING[1].replace("[^\\s]+(?:\\s+[^\\s]+)*?", "([^\\s]+(?:\\s+[^\\s]+)*?)", 1)
    verb = r"\b(titled|named|called|labeled|tagged)\s+(?:it|this|that|the)\s+\w+"
    title = f"CASE WHEN {d.has('s2', NAMING[0])} THEN {d.extract('s2', first, 1)} WHEN {d.has('s2', NAMING[1])} THEN {d.extract('s2', second, 1)} ELSE {d.extract('s2', verb, 1)} END"
    after = []
    # The second pattern's own match ends before the word that bounds it.
    bare = _NAMED + r"[^\s]+(?:\s+[^\s]+)*?"
    for p, end in ((NAMING[0], ""), (NAMING[1], "keep"), (NAMING[2], "")):
        match = d.extract("s2", p) if not end else d.extract("s2", "(" + bare + ")" + NAMING[1][len(bare):], 1)
        rest = f"substring(s2, {d.before('s2', p)} + length({match}) + 1)"
        stop = r"\s+(?:and|then|so|dropped|released|opened|published|aired)"
        cut = f"CASE WHEN {d.has(rest, stop)} THEN substring({rest}, 1, {d.before(rest, stop)}) ELSE substring({rest}, 1, 50) END"
        if d.name == "spark":  # one search gives the rest, which has no line ends, and it is made once
            rest = d.extract("s2", p + "(.*)" if not end else bare + "(" + NAMING[1][len(bare):] + ".*)", 1)
            cut = f"transform(array({rest}), rest -> CASE WHEN rest RLIKE {d.rx(stop, 's2')} THEN substring(rest, 1, regexp_instr(rest, {d.rx(stop, 's2')}) - 1) ELSE substring(rest, 1, 50) END)[0]"
        # A bound may also be the end of the text, where only white space is left; stripped text has none.
        after.append(f"CASE WHEN {d.has('s2', p)} THEN {cut} ELSE '' END")
    return title, after


def stages(d: Spark) -> dict[str, str]:
    """Stage columns over s2."""
    victims = [p for p in rules.VICTIM_STATE_PATTERNS if r"was\s+(different|off|strange)" not in p]
    title, after = _titles(d.base)
    title, after = d.once(title), [d.once(a) for a in after]
    vague = rules.VAGUENESS_PENALTY_WORDS
    return {
        "victim": f"({_listed(d, 's2', rules.VICTIM_STATE_KEYWORDS)} OR {_any(d, 's2', victims)} OR {_listed(d, title, rules.FCS_TITLE_VICTIM_KEYWORDS)})",
        "weak": _any(d, "s2", rules.FCS_WEAK_EXPRESSIONS),
        "creation": _any(d, "s2", (*rules.FULL_COURT_CREATION_PATTERNS, *rules.FULL_COURT_DIRECT_CAPTURE_PATTERNS)),
        "naming": _any(d, "s2", NAMING),
        "release": _any(d, "s2", rules.FULL_COURT_RELEASE_PATTERNS),
        "vague_title": "(" + " OR ".join(f"({keywords(d, a, vague)} > 0)" for a in after) + ")",
        "n_vague": keywords(d, "s2", vague),
        "n_weak_words": keywords(d, "s2", rules.FULL_COURT_WEAK_KEYWORDS),
        "loose": f"({keywords(d, 's2', rules.FCS_WEAK_OBJECTS)} > 0 AND {keywords(d, 's2', rules.FCS_STRONG_MEDIA_OBJECTS)} = 0)",
        "words": f"{keywords(d, 's2', rules.FULL_COURT_STRONG_KEYWORDS, 0.12, 0.25)}",
        "media": f"{keywords(d, 's2', rules.FULL_COURT_MEDIUM_KEYWORDS, 0.05, 0.15)}",
        "penalty": _if(d, d.has("s2", PENALTIES[0][0]), PENALTIES[0][1], *((d.has("s2", p), v) for p, v in PENALTIES[1:])),
        "triple": _if(d, d.has("s2", TRIPLE), 0.3),
        "frame": _if(d, _any(d, "s2", rules.FCS_TIME_FRAME_PATTERNS), 0.1),
        "two_part": _if(d, d.has("s2", TWO_PART), 0.15),
        "connectors": hits(d, "s2", rules.FCS_CONNECTOR_PATTERNS, 0.05, 0.1),
        "persons": _if(d, f"{d.has('s2', r'\b(you|your)\s+')} AND {d.has('s2', r'\bi\s+')}", 0.1),
        "titling": hits(d, "s2", rules.FCS_TITLE_GRAMMAR_PATTERNS, 0.08, 0.15),
        "vanished": _if(d, d.has("s2", VANISHED), 0.1),
        "turn": _if(d, d.has("s2", r"\b(but|yet|however|though|although)\s+"), 0.05),
    }


def score(d: Spark) -> str:
    """The confidence from the stage columns."""
    base = f"(CASE WHEN release THEN {d.f(0.85)} ELSE {d.f(0.4)} END + words + media - CASE WHEN n_weak_words > 3 THEN least((n_weak_words - 3) * {d.f(0.03)}, {d.f(0.1)}) ELSE {d.f(0)} END)"
    capped = f"(CASE WHEN loose THEN least({base}, {d.f(0.5)}) ELSE {base} END)"
    vague = f"(CASE WHEN vague_title THEN {capped} - {d.f(0.6)} WHEN n_vague > 0 THEN {capped} - least(n_vague * {d.f(0.2)}, {d.f(0.4)}) ELSE {capped} END)"
    total = f"{vague} - penalty + triple + frame + two_part + connectors + persons + titling + vanished + turn"
    return (
        f"CASE WHEN NOT victim OR weak OR NOT creation OR NOT naming THEN {d.f(0)} WHEN vague_title AND {capped} - {d.f(0.6)} < {d.f(0.3)} THEN {d.f(0)} "
        f"ELSE greatest({d.f(0)}, least({total}, {d.f(1)})) END"
    )


__all__ = ["score", "stages"]
