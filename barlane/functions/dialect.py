"""The few spellings in which Spark SQL and the SQL of the checking engine differ, so a rule is stated once."""
from __future__ import annotations

import re

from .literals import required_each

BLANK = r"[\s\x1c-\x1f]"
#: Those of ASCII one by one, which the JVM looks up in a table, and all of them, most characters ruled out at once.
ASCII_BLANKS = r"\t\n\x0b\f\r\x1c\x1d\x1e\x1f "
BLANKS = ASCII_BLANKS + r"\x85\xA0[\x{1680}-\x{3000}&&[\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]]"
#: All of them as a literal of Spark.
_SPARK_BLANKS = "'" + "".join(f"\\u{c:04x}" for c in (*range(9, 14), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)) + "'"
#: Columns that are folded, so that patterns meet ASCII only.
FOLDED = ("s", "s2", "low")
#: The column of the results of a scan's searches in folded columns, see searches.py.
HITS = "hits"


class Spark:
    """Spark SQL. Patterns use Unicode classes and are literals, so each compiles once."""

    name = "spark"

    def lit(self, s: str) -> str:
        return "'" + s.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"

    def rx(self, p: str, x: str = "") -> str:
        """A pattern as a literal; for a folded column x without Unicode classes, which cost much time."""
        return ("r'(?d)" if x in FOLDED else "r'(?U)") + p.replace("'", r"\x27") + "'"

    def fold(self, x: str) -> str:
        """x with a character of ASCII for each other one: a blank, `_` for letters and digits, `~` for the rest."""
        # A character of ASCII is ruled out at once.
        x = f"regexp_replace({x}, r'[[^\\x00-\\x7F]&&[\\x{{85}}\\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]]', ' ')"
        return f"regexp_replace(regexp_replace({x}, r'[[^\\x00-\\x7F]&&[\\p{{L}}\\p{{N}}]]', '_'), r'[^\\x00-\\x7F]', '~')"

    def f(self, x: float) -> str:
        return f"{float(x)!r}D"

    @property
    def base(self) -> Spark:
        """The dialect without notes."""
        return self

    def once(self, x: str, fact: str = "") -> str:
        """x, or the name of a column for it that a layer below gives; fact is the name of a fact of the lines."""
        return x

    def folded(self, x: str) -> str:
        """fold, but for texts of ASCII alone, which stand for themselves."""
        return plain(x, x, self.fold(x))

    def may(self, x: str, p: str) -> str:
        """Whether a folded text holds the texts that a pattern can't do without; empty where that tells nothing."""
        sets = required_each(p) if x in FOLDED else ()
        return "(" + " AND ".join("(" + " OR ".join(self.contains(x, self.lit(t)) for t in s) + ")" for s in sets) + ")" if sets else ""

    def has(self, x: str, p: str) -> str:
        may = self.may(x, p)
        return f"({may} AND {x} RLIKE {self.rx(p, x)})" if may else f"({x} RLIKE {self.rx(p, x)})"

    def count(self, x: str, p: str) -> str:
        may, own = self.may(x, p), self.counted(x, p)
        return f"(CASE WHEN {may} THEN {own} ELSE 0 END)" if may else own

    def counted(self, x: str, p: str) -> str:
        """The number of matches, without a look at what they can't do without."""
        return f"size(regexp_extract_all({x}, {self.rx(p, x)}, 0))"

    def all(self, x: str, p: str) -> str:
        return f"regexp_extract_all({x}, {self.rx(p, x)}, 0)"

    def extract(self, x: str, p: str, group: int = 0) -> str:
        return f"regexp_extract({x}, {self.rx(p, x)}, {group})"

    def replace(self, x: str, p: str, by: str) -> str:
        return f"regexp_replace({x}, {self.rx(p)}, r'{by}')"

    def before(self, x: str, p: str) -> str:
        """Characters before the first match."""
        return f"(regexp_instr({x}, {self.rx(p, x)}) - 1)"

    def split(self, x: str, p: str) -> str:
        return f"split({x}, {self.rx(p)})"

    def contains(self, x: str, part: str) -> str:
        return f"contains({x}, {part})"

    def where(self, a: str, v: str, test: str) -> str:
        return f"filter({a}, {v} -> {test})"

    def each(self, a: str, v: str, body: str) -> str:
        return f"transform({a}, {v} -> {body})"

    def size(self, a: str) -> str:
        return f"size({a})"

    def part(self, a: str, start: str, n: str) -> str:
        return f"slice({a}, {start}, {n})"

    def join(self, a: str, sep: str) -> str:
        return f"array_join({a}, {self.lit(sep)})"

    def distinct(self, a: str) -> str:
        return f"array_distinct({a})"

    def upto(self, n: str) -> str:
        """1 to n; empty where n < 1."""
        return f"filter(sequence(1, greatest({n}, 1)), q -> q <= {n})"

    def at(self, a: str, i: str) -> str:
        return f"try_element_at({a}, CAST({i} AS INT))"

    def array(self, items: list[str]) -> str:
        return f"array({', '.join(items)})"

    def struct(self, fields: dict[str, str]) -> str:
        return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + ")"

    def structs(self, items: list[dict[str, str]]) -> str:
        return self.array([self.struct(i) for i in items])

    def flat(self, a: str) -> str:
        return f"flatten({a})"

    def words(self, x: str) -> str:
        """Pieces between white space, none of them empty; `split` would compile its pattern for each text."""
        return plain(x, f"regexp_extract_all({x}, r'(?d)[^{ASCII_BLANKS}]+', 0)", self.all(x, "[^" + BLANK[1:] + "+"))

    def char(self, n: int) -> str:
        return f"char({n})"

    def any_in(self, a: str, v: str, test: str) -> str:
        return f"exists({a}, {v} -> {test})"

    def has_item(self, a: str, x: str) -> str:
        return f"array_contains({a}, {x})"

    def concat(self, *arrays: str) -> str:
        return f"concat({', '.join(arrays)})"

    def sum(self, a: str) -> str:
        """The sum of an array of doubles, in its order; 0 where it is empty."""
        return f"aggregate({a}, 0D, (acc, av) -> acc + av)"

    def gather(self, n: str, body: str) -> str:
        """An ordered fold over j = 1 to n: body gives the array of ints acc after j from acc before it."""
        return f"aggregate({self.upto(n)}, CAST(array() AS ARRAY<INT>), (acc, j) -> {body})"

    def json(self, a: str) -> str:
        return f"to_json({a})"

    def listed(self, x: str, order: str) -> str:
        """An aggregate: the values of x as an array, by order."""
        return f"transform(array_sort(collect_list(named_struct('o', {order}, 'v', {x}))), lo -> lo.v)"


class Duck(Spark):
    """The SQL of the engine that results are checked with."""

    name = "duck"

    def lit(self, s: str) -> str:
        if "\n" in s:
            return "(" + " || chr(10) || ".join("'" + p.replace("'", "''") + "'" for p in s.split("\n")) + ")"
        return "'" + s.replace("'", "''") + "'"

    def rx(self, p: str, x: str = "") -> str:
        return "'" + p.replace("'", r"\x27") + "'"

    def fold(self, x: str) -> str:
        """As Spark's where all characters beyond ASCII are letters or digits; this engine's patterns can't say which are."""
        return f"regexp_replace({x}, '[^\\x00-\\x7F]', '_', 'g')"

    def folded(self, x: str) -> str:
        return self.fold(x)

    def f(self, x: float) -> str:
        return f"{float(x)!r}::DOUBLE"

    def has(self, x: str, p: str) -> str:
        return f"regexp_matches({x}, {self.rx(p)})"

    def count(self, x: str, p: str) -> str:
        return f"len(regexp_extract_all({x}, {self.rx(p)}))"

    def all(self, x: str, p: str) -> str:
        return f"regexp_extract_all({x}, {self.rx(p)})"

    def replace(self, x: str, p: str, by: str) -> str:
        by = by.replace("$1", r"\1").replace("$2", r"\2")
        return f"regexp_replace({x}, {self.rx(p)}, '{by}', 'g')"

    def words(self, x: str) -> str:
        return self.where(self.split(x, BLANK + "+"), "wd", "wd <> ''")

    def before(self, x: str, p: str) -> str:
        return f"length(regexp_extract({x}, {self.rx('(?s)^(.*?)(?:' + p + ')')}, 1))"

    def split(self, x: str, p: str) -> str:
        return f"regexp_split_to_array({x}, {self.rx(p)})"

    def where(self, a: str, v: str, test: str) -> str:
        return f"list_filter({a}, lambda {v}: {test})"

    def each(self, a: str, v: str, body: str) -> str:
        return f"list_transform({a}, lambda {v}: {body})"

    def size(self, a: str) -> str:
        return f"len({a})"

    def part(self, a: str, start: str, n: str) -> str:
        return f"({a})[{start}:({start}) + ({n}) - 1]"

    def join(self, a: str, sep: str) -> str:
        return f"array_to_string({a}, {self.lit(sep)})"

    def distinct(self, a: str) -> str:
        return f"list_distinct({a})"

    def upto(self, n: str) -> str:
        return f"generate_series(1, {n})"

    def at(self, a: str, i: str) -> str:
        return f"({a})[{i}]"

    def array(self, items: list[str]) -> str:
        return f"[{', '.join(items)}]"

    def struct(self, fields: dict[str, str]) -> str:
        return "{" + ", ".join(f"'{k}': {v}" for k, v in fields.items()) + "}"

    def char(self, n: int) -> str:
        return f"chr({n})"

    def any_in(self, a: str, v: str, test: str) -> str:
        return f"(len(list_filter({a}, lambda {v}: {test})) > 0)"

    def has_item(self, a: str, x: str) -> str:
        return f"list_contains({a}, {x})"

    def concat(self, *arrays: str) -> str:
        return f"list_concat({', '.join(arrays)})"

    def sum(self, a: str) -> str:
        return f"coalesce(list_sum({a}), 0::DOUBLE)"

    def gather(self, n: str, body: str) -> str:
        one = re.sub(r"\bj\b", "jl[1]", body)
        return f"list_reduce(list_prepend([]::INT[], list_transform(generate_series(1, {n}), lambda jq: [jq::INT])), lambda acc, jl: {one})"

    def json(self, a: str) -> str:
        return f"CAST(to_json({a}) AS VARCHAR)"

    def listed(self, x: str, order: str) -> str:
        return f"list({x} ORDER BY {order})"


def plain(x: str, ascii_: str, other: str) -> str:
    """Spark's choice by whether a text is of ASCII alone, for which patterns are simpler."""
    return f"(CASE WHEN octet_length({x}) = length({x}) THEN {ascii_} ELSE {other} END)"


def noted(d: Spark) -> Spark:
    """d, but tests of folded columns, and what is given to `once`, become names; `layer` defines them, each once."""

    class Noted(type(d)):
        def __init__(self) -> None:
            self.__dict__.update(vars(d))
            self.notes: dict[str, str] = {}

        @property
        def base(self) -> Spark:
            return d

        def once(self, x: str, fact: str = "") -> str:
            own = super().once(x, fact)
            return self.notes.setdefault(x, f"h{len(self.notes)}") if own == x else own

        def has(self, x: str, p: str) -> str:
            test = super().has(x, p)
            return self.once(test) if x in FOLDED and not test.startswith(HITS) else test

        def layer(self) -> str:
            return ", ".join(f"{test} AS {name}" for test, name in self.notes.items())

    return Noted()


def strip(d: Spark, x: str) -> str:
    return f"trim(BOTH {_SPARK_BLANKS} FROM {x})" if d.name == "spark" else d.replace(x, f"^{BLANK}+|{BLANK}+$", "")
