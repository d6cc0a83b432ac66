"""All tests of a scan's patterns and words in one pass: an Arrow function that searches a batch's columns one pattern at a time.

The engine behind Arrow's `match_substring_regex` tells whether a text holds a match in time that grows with the text alone,
and over a whole column at once; it is also the one that the checking SQL uses. Texts are folded to ASCII before. A test is only made
of the rows that hold the words it can't do without, which the distinct words of a batch tell for all rows at once.
"""
from __future__ import annotations

import re
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .dialect import FOLDED, HITS, Spark
from .literals import required_each

#: Bytes of text whose words are told apart at a time, and distinct words from which their rows are found in one pass.
PIECE, MANY = 1 << 22, 256
#: The name under which a session knows searches_udf.
SEARCHES = "barlane_searches"


def ascii_blanks(pattern: str) -> str:
    r"""The pattern with \s as the JVM has it: also a vertical tab, which the other engine leaves out."""
    out, inside = "", False
    for piece in re.findall(r"\\.|.", pattern, re.S):
        if piece == r"\s":
            out += r"\s\x0b" if inside else r"[\s\x0b]"
            continue
        inside = piece == "[" or (inside and piece != "]")
        out += piece
    return out


class Searched(Spark):
    """The dialect, but tests of folded columns that are known by number are read from the array `hits`."""

    def __init__(self) -> None:
        self.tests: dict[tuple[str, str, str], int] = {}
        self.learns = True

    def _known(self, x: str, *test: str) -> str:
        """The place of a test's result; empty for other columns, and for tests that weren't learned."""
        if self.learns and x in FOLDED:
            self.tests.setdefault((x, *test), len(self.tests))
        return f"{HITS}[{self.tests[x, *test]}]" if (x, *test) in self.tests else ""

    def has(self, x: str, p: str) -> str:
        return self._known(x, "pattern", p) or super().has(x, p)

    def once(self, x: str, fact: str = "") -> str:
        return f"dd.{fact}" if fact else x

    def count(self, x: str, p: str) -> str:
        known = self._known(x, "pattern", p)
        return f"(CASE WHEN {known} THEN {self.counted(x, p)} ELSE 0 END)" if known else super().count(x, p)

    def contains(self, x: str, part: str) -> str:
        return (self._known(x, "text", part) if part.startswith("'") else "") or super().contains(x, part)


@cache
def searched() -> Searched:
    """The dialect in which a scan's tests of folded columns are places of the array `hits`, and what these tests are; facts of
    the lines come with their repeats."""
    from . import detectors, fullcourt

    d = Searched()
    more, beyond = detectors.extras(d), detectors._beyond(d)
    for key in detectors.PLAIN:
        detectors.confidence(d, key, more)
        detectors.evidence(d, key, beyond)
    fullcourt.stages(d)
    d.learns = False
    return d


@cache
def _tests() -> tuple[tuple[int, bool, str, tuple[tuple[str, ...], ...]], ...]:
    """Each test: its column's place in FOLDED, whether it is a pattern, what is searched for, and sets of texts of each of
    which a row that passes holds one."""
    out = []
    for x, kind, p in searched().tests:
        if kind == "pattern":
            out.append((FOLDED.index(x), True, ascii_blanks(p), required_each(p)))
        else:
            text = re.sub(r"\\(.)", r"\1", p[1:-1])  # of a literal
            out.append((FOLDED.index(x), False, text, ((text,),)))
    return tuple(out)


class _Words:
    """The distinct words of some columns' texts, the rows of each, and where four characters stand in them."""

    def __init__(self, columns: list[pa.Array]) -> None:
        pieces = [pc.ascii_split_whitespace(c) for c in columns]
        words = pa.concat_arrays([p.flatten() for p in pieces]).dictionary_encode()
        distinct = words.dictionary
        self.starts = np.concatenate([[0], np.cumsum(pc.binary_length(distinct).to_numpy(zero_copy_only=False) + 1)])  # of the words, each with a line end
        own = pa.concat_arrays([distinct, pa.array([""] * 4, distinct.type)])
        self.chars = np.frombuffer(pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own), "\n")[0].as_buffer(), np.uint8)
        four = self.chars[:-3].astype(np.uint32) << 24
        for k in (1, 2, 3):
            four |= self.chars[k : len(self.chars) - 3 + k].astype(np.uint32) << 8 * (3 - k)
        self.places = np.argsort(four)
        self.four = four[self.places]
        codes, self.columns, self.rows, self.found, lo = words.indices.to_numpy(zero_copy_only=False), columns, [], {}, 0
        for p in pieces:
            own, lo = codes[lo : lo + len(p.flatten())], lo + len(p.flatten())
            order = np.argsort(own, kind="stable")
            own, rows = own[order], pc.list_parent_indices(p).to_numpy(zero_copy_only=False)[order]
            self.rows.append((own, rows, np.searchsorted(own, np.arange(len(distinct) + 1))))

    def having(self, part: str) -> np.ndarray:
        """The distinct words that hold a text without blanks."""
        own = part.encode()
        least, most = (int.from_bytes(own[:4].ljust(4, fill)) for fill in (b"\0", b"\xff"))
        at = self.places[np.searchsorted(self.four, np.uint32(least)) : np.searchsorted(self.four, np.uint32(most), "right")]
        for k in range(4, len(own)):
            at = at[self.chars[np.minimum(at + k, len(self.chars) - 1)] == own[k]]
        return np.unique(np.searchsorted(self.starts, at, "right") - 1)

    def holding(self, c: int, part: str) -> np.ndarray:
        """Whether each row may hold a text; that tells for certain where the text has no blank."""
        if (c, part) not in self.found:
            n = len(self.columns[c])
            if part.split() == [part]:
                out = np.zeros(n, bool)
                if part not in self.found:
                    self.found[part] = self.having(part)
                codes, rows, starts = self.rows[c]
                if len(words := self.found[part]) > MANY:
                    own = np.zeros(len(starts) - 1, bool)
                    own[words] = True
                    out[rows[own[codes]]] = True
                else:
                    for w in words:
                        out[rows[starts[w] : starts[w + 1]]] = True
            else:
                out = np.logical_and.reduce([np.ones(n, bool), *(self.holding(c, x) for x in part.split())])
            self.found[c, part] = out
        return self.found[c, part]

    def passing(self, c: int, pattern: bool, what: str, sets: tuple[tuple[str, ...], ...]) -> np.ndarray:
        """Whether each row passes a test; false where the text is null."""
        texts = self.columns[c]
        may = texts.is_valid().to_numpy(zero_copy_only=False)
        for s in sets:
            may = may & np.logical_or.reduce([self.holding(c, x) for x in s])
        if not pattern and what.split() == [what]:
            return may
        at = np.flatnonzero(may)
        if at.size:
            texts = texts if at.size == len(may) else texts.take(pa.array(at))
            got = (pc.match_substring_regex if pattern else pc.match_substring)(texts, what).to_numpy(zero_copy_only=False)
            may = np.zeros(len(may), bool)
            may[at] = got
        return may


def search(*columns: pa.Array) -> pa.Array:
    """For each row the tests' results, null where the column is null, as an array."""
    tests = _tests()
    n = len(columns[0])
    found = np.zeros((n, len(tests)), bool)
    step = max(1, n * PIECE // max(PIECE, *(c.nbytes for c in columns)))
    for lo in range(0, n, step):
        words = _Words([c.slice(lo, step) for c in columns])
        for i, test in enumerate(tests):
            found[lo : lo + step, i] = words.passing(*test)
    known = None
    if any(c.null_count for c in columns):
        known = np.stack([c.is_valid().to_numpy(zero_copy_only=False) for c in columns], 1)[:, [c for c, *_ in tests]]
    values = pa.array(found.ravel(), mask=None if known is None else ~known.ravel())
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * len(tests)), values)


@F.arrow_udf(T.ArrayType(T.BooleanType()))
def searches_udf(s: pa.Array, s2: pa.Array, low: pa.Array) -> pa.Array:
    return search(s, s2, low)


def register(spark: SparkSession) -> None:
    """Makes the function known to a session's SQL."""
    spark.udf.register(SEARCHES, searches_udf)
