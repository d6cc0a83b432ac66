"""Sequence similarity that no built-in function gives, as Arrow UDFs over the standard library."""
from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import searches
from .detectors import DRAG_FILLER, MID_FILLER
from .similarity_sql import ALIKE, LONG, REPEATS, TOP


#: Classes that characters are counted in, texts that are compared with all later ones at a time, and texts so few that all
#: classes are.
BINS, BLOCK, FEW = 32, 256, 48
_REPEATED = T.StructType([T.StructField("confidence", T.DoubleType()), T.StructField("evidence", T.ArrayType(T.StringType())), *(T.StructField(f, T.IntegerType()) for f in ("again", "thin", "solid"))])


def ratio(a: str, b: str) -> float:
    """Ratcliff/Obershelp similarity; the earlier text comes first."""
    return SequenceMatcher(None, a, b).ratio()


def subsequence(a: str, b: str) -> int:
    """The length of the longest common subsequence: no fewer characters than in the matching blocks, which form one."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    whole = open_ = (1 << len(a)) - 1
    for c in b:
        if own := open_ & places.get(c, 0):
            open_ = (open_ + own | open_ - own) & whole
    return len(a) - open_.bit_count()


def near(a: str, b: str, least: float) -> float:
    """The ratio of two texts where it reaches `least`, else 0; upper bounds are tried first."""
    both = len(a) + len(b)
    if 2 * min(len(a), len(b)) < least * both:
        return 0.0
    if both and len(b) < LONG and (a in b or b in a):  # one block
        got = 2.0 * min(len(a), len(b)) / both
    else:
        got = ratio(a, b) if 2 * subsequence(a, b) >= least * both - 1e-9 else 0.0
    return got if got >= least else 0.0


def alike(a: str, b: str, least: float) -> bool:
    """Whether the ratio reaches `least`."""
    return near(a, b, least) >= least


def possible_pairs(texts: list[str], least: float) -> Iterator[tuple[int, int]]:
    """Pairs (i, j), i < j, in order, whose ratio may reach `least`: all that do, and few others.

    Matching blocks can't hold more of a character than both texts have, so twice the characters in common, over all, is
    never less than the ratio. Characters are counted in BINS classes, which only raises that bound, a block of texts
    against all later ones at a time.
    """
    size = np.array([len(t) for t in texts], np.int64)
    if len(texts) < 2:
        return
    counts = np.zeros((BINS, len(texts)), np.uint16)
    for lo in range(0, len(texts), BLOCK):  # a block of texts at a time
        own = size[lo : lo + BLOCK]
        points = np.frombuffer("".join(texts[lo : lo + BLOCK]).encode("utf-32-le", "surrogatepass"), np.uint32) % BINS
        counts[:, lo : lo + BLOCK] = np.minimum(np.bincount(np.repeat(np.arange(len(own)) * BINS, own) + points, minlength=len(own) * BINS), 65535).reshape(-1, BINS).T
    if len(texts) <= FEW:
        common = np.minimum(counts[:, :, None], counts[:, None]).sum(0, dtype=np.uint32)
        i, j = np.nonzero(np.triu(2 * common >= least * (size[:, None] + size) - 1e-9, 1))
        yield from zip(i.tolist(), j.tolist())
        return
    for lo in range(0, len(texts), BLOCK):
        hi = min(lo + BLOCK, len(texts))
        common = np.zeros((hi - lo, len(texts) - lo), np.uint32)
        for own in counts:
            common += np.minimum(own[lo:hi, None], own[lo:])
        both = size[lo:hi, None] + size[lo:]
        i, j = np.nonzero((2 * common >= least * both - 1e-9) & (np.arange(hi - lo)[:, None] < np.arange(len(texts) - lo)))
        yield from zip((i + lo).tolist(), (j + lo).tolist())


def lines_similar(a: list[str], b: list[str], least: float = 0.60) -> bool:
    """Whether some two non-blank lines contain one another or are alike."""
    left, right = ([x.strip().lower() for x in v if x and x.strip()] for v in (a, b))
    return any(x in y or y in x or alike(x, y, least) for x in left for y in right)


def repeats(lines: list[str]) -> tuple[float, list[str]]:
    """Confidence and evidence of repeated and nearly repeated lines."""
    counts: dict[str, int] = {}
    long, low = [], []
    for line in lines:
        if (n := len(line.split())) > 3:
            own = line.lower()
            counts[own] = counts.get(own, 0) + 1
            if n > 4:
                long.append(line)
                low.append(own)
    exact = [(line, n) for line, n in counts.items() if n > 1]
    pairs = []  # two are all that counts: they give the most confidence, and evidence is of the first two
    for i, j in possible_pairs(low, 0.80):
        if r := near(low[i], low[j], 0.80):
            pairs.append((r, long[i], long[j]))
            if len(pairs) == 2:
                break
    evidence = [f'Repeated ({n}x): "{line[:80]}"' for line, n in exact[:2]]
    evidence += [f'Near-repeat (similarity {r:.0%}): "{a[:50]}" ≈ "{b[:50]}"' for r, a, b in pairs]
    return min(min(len(exact) * 0.45, 0.95) * bool(exact) + min(len(pairs) * 0.35, 0.60), 1.0), evidence[:3]


@F.arrow_udf(_REPEATED)
def repeats_udf(lines: pa.Array) -> pa.Array:
    said = [x or [] for x in lines.to_pylist()]
    confidence, evidence = zip(*map(repeats, said)) if said else ((), ())
    counts = zip(*map(facts, said)) if said else ((), (), ())
    return pa.StructArray.from_arrays([pa.array(confidence, pa.float64()), pa.array(evidence, pa.list_(pa.string())), *(pa.array(c, pa.int32()) for c in counts)], _REPEATED.names)


def facts(lines: list[str]) -> tuple[int, int, int]:
    """How many lines begin with three words that an earlier one begins with, how many have fewer than three distinct words
    that aren't fillers, and how many have six words and four distinct ones that aren't."""
    openings, thin, solid = set(), 0, 0
    for line in lines:
        words = line.lower().split()
        openings.add(" ".join(words[:3]))
        own = set(words)
        thin += len(own.difference(DRAG_FILLER)) < 3
        solid += len(words) >= 6 and len(own.difference(MID_FILLER)) >= 4
    return len(lines) - len(openings), thin, solid


_WORD = re.compile(r"\b[a-z]{4,}\b", re.ASCII)


def top(s: str | None) -> str | None:
    """The most frequent word of four letters or more, the first of several, and its count, as detectors.top_word gives it."""
    counts = Counter(_WORD.findall(s or ""))  # in the order in which the words come
    return f"{counts[word]} {word}" if (word := max(counts, key=counts.get, default=None)) else None


@F.arrow_udf(T.StringType())
def top_udf(s: pa.Array) -> pa.Array:
    return pa.array(map(top, s.to_pylist()), pa.string())


def alike_findings(skills: list[str | None], lines: list[list[str]]) -> tuple[list[list[int]], list[bool]]:
    """For each finding the earlier ones (from 1) of its skill with a line like one of its own, and whether two of its own
    lines contain one another or have a ratio of 0.75."""
    low = [[x.strip().lower() for x in v if x and x.strip()] for v in lines]
    near = [[i + 1 for i in range(j) if skills[i] == skills[j] and lines_similar(low[j], low[i])] for j in range(len(low))]
    return near, [any(lines_similar([a], [b], 0.75) for i, a in enumerate(v) for b in v[i + 1 :]) for v in low]


@F.pandas_udf(T.StructType([T.StructField("near", T.ArrayType(T.ArrayType(T.IntegerType()))), T.StructField("repeats", T.ArrayType(T.BooleanType()))]))
def alike_udf(skills: pd.Series, lines: pd.Series) -> pd.DataFrame:
    got = [alike_findings(list(a), [list(x) for x in b]) for a, b in zip(skills, lines)]
    return pd.DataFrame({"near": [n for n, _ in got], "repeats": [r for _, r in got]})


def register(spark: SparkSession) -> None:
    """Makes the functions known to a session's SQL."""
    spark.udf.register(REPEATS, repeats_udf)
    spark.udf.register(ALIKE, alike_udf)
    spark.udf.register(TOP, top_udf)
    searches.register(spark)
