"""Which texts a pattern can't do without, so that a plain search may rule it out before the pattern is tried."""
from __future__ import annotations

import re
from functools import cache

#: Alternatives that are worth a search each, and characters that a text to search for has at least.
MOST, LEAST = 24, 2
#: Sets of alternatives that are searched for before one pattern.
SETS = 4


def _worth(texts: frozenset[str] | None) -> tuple[int, int]:
    """How much a set of alternatives tells: by its shortest one, then by how few they are."""
    return (min(map(len, texts)), -len(texts)) if texts else (0, 0)


def _sequence(items) -> frozenset[str] | None:
    """Alternatives of which one stands in every match of the items one after another: those that tell most."""
    best = None
    for r in _each(items):
        if _worth(r) > _worth(best):
            best = r
    return best


def _each(items) -> list[frozenset[str]]:
    """Sets of alternatives; a match of the items one after another holds one of each set."""
    run = ""
    runs: list[frozenset[str]] = []
    for op, value in items:
        name = str(op)
        if name == "LITERAL":
            run += chr(value)
            continue
        if name == "AT":  # a place, no character
            continue
        if run:
            runs.append(frozenset([run]))
        run = ""
        runs.extend(_one(name, value))
    if run:
        runs.append(frozenset([run]))
    return runs


def _one(name: str, value) -> list[frozenset[str]]:
    if name == "SUBPATTERN":
        _, on, _, items = value
        return [] if on else _each(items)
    if name == "BRANCH":
        every = [_sequence(items) for items in value[1]]
        return [frozenset().union(*every)] if all(every) else []
    if name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
        least, _, items = value
        return _each(items) if least else []
    if name == "ATOMIC_GROUP":
        return _each(value)
    return []  # classes, look-arounds, back-references


def _parsed(pattern: str):
    """The pattern's items; none where the parser, which isn't public, or its flags don't let them be told."""
    try:
        parsed = re._parser.parse(pattern)
    except (AttributeError, re.error):
        return ()
    return () if parsed.state.flags & (re.IGNORECASE | re.VERBOSE) else parsed


def _tried(got: frozenset[str] | None) -> tuple[str, ...]:
    """The alternatives, shortest forms only; none where they aren't worth a search."""
    if not got or len(got) > MOST or min(map(len, got)) < LEAST:
        return ()
    return tuple(sorted(x for x in got if not any(y != x and y in x for y in got)))


@cache
def required(pattern: str) -> tuple[str, ...]:
    """Texts of which each match of the pattern holds one; none where that can't be told, or isn't worth it."""
    return _tried(_sequence(_parsed(pattern)))


@cache
def required_each(pattern: str) -> tuple[tuple[str, ...], ...]:
    """Sets of texts; each match of the pattern holds one of every set. Those that tell most come first."""
    sets = {_tried(r): None for r in sorted(_each(_parsed(pattern)), key=_worth, reverse=True)}
    return tuple(s for s in sets if s)[:SETS]
