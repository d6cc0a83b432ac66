"""Quality rules as a short-circuit cascade, in built-in functions only.

Words are `[^\\x20\\x09-\\x0D]+`. `signals` adds the counts that every row gets. A rule is a condition that rejects a row, and
the cost of testing it: the characters that its own scans of the text read, 1 where it only compares counts. On a sample
spread over all rows `estimated` counts which rules hold together and adds up each rule's cost; `order` then takes, again
and again, the rule that rejects most per cost among the sampled rows that no earlier rule rejects. Rows pass the rules
in that order in one CASE, so a rule's scans run only for rows that all earlier rules let through. The order changes the
time only, never a verdict; equal ratios keep the order in which the rules are stated.

Defined results: a null text has no words; a text without words is judged with all counts at 0; repeated rows are judged
each; an empty table gives an empty result (rules then keep their order); extra columns are carried along, those named
like a signal or rejected_by are replaced.
"""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_WS = r"[\x20\x09-\x0D]+"
#: Rows about that the sample takes from which the order of rules is estimated; it is aggregated where it lies.
SAMPLE_ROWS = 2_000

SIGNALS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    """`rejects` is SQL over the columns of `signals` and `__t`, the text; so is `cost`, of testing the rule on a row."""

    name: str
    rejects: str
    cost: str = "1"


def _scan(name: str, rejects: str, passes: int = 1) -> Rule:
    """A rule that reads the text so many times."""
    return Rule(name, rejects, f"1 + {passes} * length(__t)")


BASE = (
    Rule("few_words", "n_words < 50"),
    Rule("repeated_words", "100 * n_repeat_words > 50 * n_words"),
)
MORE = (
    Rule("symbols", "n_symbols > 0.1 * n_words"),
    Rule("repeated_lines", "n_dup_lines > 0.5 * n_lines AND n_lines >= 4"),
    Rule("word_length", "word_chars < 2 * n_words OR word_chars > 20 * n_words"),
    _scan("few_letters", r"regexp_count(__t, r'[A-Za-z\x{80}-\x{10FFFF}][^\x20\x09-\x0D]*') < 0.8 * n_words"),
    _scan("digits", "length(__t) - length(translate(__t, '0123456789', '')) > 0.2 * length(__t)", 2),
    _scan("ellipses", r"regexp_count(__t, r'(?:\.{3}|\x{2026})(?:\n|\z)') > 0.3 * n_lines AND n_lines >= 4"),
    _scan("bullets", r"regexp_count(__t, r'(?:\A|\n)[ \t]*[-*\x{2022}]') > 0.9 * n_lines AND n_lines >= 4"),
    _scan("links", "regexp_count(__t, r'https?://') > 0.2 * n_words"),
)


def signals(df: DataFrame, text: str = "text", keep: Sequence[str] | None = None, with_text: bool = False) -> DataFrame:
    """df (or its columns `keep`), with_text the text as `__t`, and n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words as long.

    Each step of arrays is a projection of its own that later ones read more than once, so none is computed again.
    n_repeat_words: windows of three words are hashed, sorted with their places, and places of neighbours with equal
    hashes are kept, so the work in a text of n words is n log n.
    """
    keep = [c for c in (df.columns if keep is None else keep) if c not in SIGNALS]
    t = F.coalesce(F.col(text), F.lit(""))
    a = df.select(*keep, t.alias("__t"), F.array_remove(F.split(t, _WS), "").alias("__w"))
    lines = F.filter(F.split("__t", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    grams = F.transform(F.arrays_zip("__w", F.slice("__w", 2, 1 << 30), F.slice("__w", 3, 1 << 30)), lambda g: F.xxhash64(g))
    keep = [*keep, "__t"] if with_text else keep
    b = a.select(
        *keep,
        F.size("__w").alias("__n"),
        F.length(F.array_join("__w", "")).alias("__c"),
        (F.length("__t") - F.length(F.regexp_replace("__t", r"[#*$%&|<>]+", ""))).alias("__s"),
        lines.alias("__l"),
        F.slice(grams, 1, F.greatest(F.size("__w") - 2, F.lit(0))).alias("__g"),
    )
    last = F.greatest(F.size("__g") - 1, F.lit(0))
    sorted_ = F.when(
        F.size(F.array_distinct("__g")) < F.size("__g"),
        F.sort_array(F.arrays_zip(F.col("__g").alias("h"), F.sequence(F.lit(0), last).alias("i"))),
    )
    c = b.select(*keep, "__n", "__c", "__s", F.size("__l").alias("__k"), (F.size("__l") - F.size(F.array_distinct("__l"))).alias("__d"), sorted_.alias("__z"))
    twice = F.filter(F.arrays_zip(F.col("__z").alias("a"), F.slice("__z", 2, 1 << 30).alias("b")), lambda p: p.a.h == p.b.h)
    covered = F.flatten(F.transform(twice, lambda p: F.array(p.a.i, p.a.i + 1, p.a.i + 2, p.b.i, p.b.i + 1, p.b.i + 2)))
    repeated = F.when(F.col("__z").isNull(), 0).otherwise(F.size(F.array_distinct(covered)))
    named = {"n_words": F.col("__n"), "word_chars": F.col("__c"), "n_symbols": F.col("__s"), "n_lines": F.col("__k"), "n_dup_lines": F.col("__d"), "n_repeat_words": repeated}
    return c.select(*keep, *(v.cast("long").alias(k) for k, v in named.items()))


@dataclass(frozen=True)
class Seen:
    """Sampled rows that fail the same rules (bit k: rule k): how many, and the sum of each rule's cost over them."""

    fails: int
    n: int
    cost: tuple[float, ...]


def estimated(df: DataFrame, rules: Sequence[Rule], text: str = "text", sample_rows: int = SAMPLE_ROWS) -> list[Seen]:
    """Counts and costs of about sample_rows rows of df, spread over its partitions."""
    every = F.lit(max(1, df.count() // sample_rows))
    some = signals(df.filter(F.pmod(F.xxhash64(F.monotonically_increasing_id()), every) == 0), text, [], with_text=True)
    bits = sum((F.coalesce(F.expr(r.rejects), F.lit(False)).cast("long") * (1 << k) for k, r in enumerate(rules)), F.lit(0).cast("long"))
    costs = [F.sum(F.expr(r.cost).cast("double")).alias(f"c{k}") for k, r in enumerate(rules)]
    rows = some.groupBy(bits.alias("fails")).agg(F.count("*").alias("n"), *costs).collect()  # one for each set of rules that fail together
    return [Seen(r.fails, r.n, tuple(r[f"c{k}"] for k in range(len(rules)))) for r in rows]


def order(rules: Sequence[Rule], seen: Sequence[Seen]) -> list[Rule]:
    """Rules by rejections per cost among the rows that those before them let through."""
    left, out = list(range(len(rules))), []
    seen = list(seen)
    while left:
        def worth(k: int) -> float:
            return sum(s.n for s in seen if s.fails >> k & 1) / max(sum(s.cost[k] for s in seen), 1e-9)

        best = max(left, key=lambda k: (worth(k), -k))
        left.remove(best)
        out.append(rules[best])
        seen = [s for s in seen if not s.fails >> best & 1]
    return out


def first_failed(rules: Sequence[Rule]) -> Column:
    """The name of the first rule that rejects the row, else null; rules after it aren't tested."""
    verdict: Column = F
    for r in rules:
        verdict = verdict.when(F.expr(r.rejects), r.name)
    return verdict if rules else F.lit(None).cast("string")


def cascade(df: DataFrame, rules: Sequence[Rule] = (*BASE, *MORE), text: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """df with its signals, and rejected_by: the first rule, in the estimated order, that rejects the row, else null."""
    keep = [c for c in df.columns if c not in (*SIGNALS, "rejected_by")]
    ordered = order(rules, estimated(df, rules, text, sample_rows))
    return signals(df, text, keep, with_text=True).select(*keep, *SIGNALS, first_failed(ordered).alias("rejected_by"))


def verdicts(docs: DataFrame) -> DataFrame:
    """Counts and verdict of each document; base_failed: a rule of BASE rejects it."""
    judged = cascade(docs.select("doc_id", "text"))
    failed = F.lit(False)
    for rule in BASE:
        failed = failed | F.expr(rule.rejects)
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), F.col("rejected_by").isNull().alias("kept"),
    )
