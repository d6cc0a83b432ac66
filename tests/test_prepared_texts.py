"""What a scan prepares of a text, in few passes, is what the plain definitions give, and sums of it make no arrays."""
import random
import sys

from barlane.functions import detectors, text
from barlane.functions.dialect import ASCII_BLANKS, BLANKS, Spark, strip
from barlane.plans import fixtures, queries, sqls

D = Spark()
PIECES = [
    "the", "The", "naïve", "été", "à", "é", "Σας", "İ", "K", "中文", "中文", "x²", "x2", "é", "e", "a‿b", "a", "Ⓐ", "ⓐ", "a‍b", "\U0001d49c", "😀", "_", "well-known", "É-a-b", "-", "don't", "“so”", "‘tis’", '"', "?", "—",
    " ", " ", " ", " ", "  ", "\t", "\n", "\n", "\r\n", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x1f", "\u0085", " ", " ", " ", " ", " ", " ", " ", "　", "​", "\x00", " \n ", "\x1f\n",
]


def _texts(n=1500):
    rng = random.Random(11)
    made = ["".join(rng.choices(PIECES, k=rng.randint(0, 14))) for _ in range(n)]
    made += [f"{a} {b}{c}{a}{d}" for a in PIECES for b in ("", " ") for c, d in (("", ""), (" ", "z"), ("\n", "́"), (" ", " "))]
    return [*made, "", " ", None]


def _prepared(spark):
    own = queries.session(spark)
    own.createDataFrame([(i, 1, "A", t) for i, t in enumerate(_texts())], "match_id int, round int, side string, text string").createOrReplaceTempView("perf")
    own.sql(fixtures.with_(fixtures.prepared(D)) + "SELECT text, s, s2, low, plain, lines, twice FROM prep").createOrReplaceTempView("got")
    return own


def _fold(x):
    x = f"regexp_replace({x}, r'[\\x{{85}}\\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]', ' ')"
    return f"regexp_replace(regexp_replace({x}, r'[\\p{{L}}\\p{{N}}&&[^\\x00-\\x7F]]', '_'), r'[^\\x00-\\x7F]', '~')"


def test_columns_are_those_of_the_plain_definitions(spark):
    quotes = f"translate(lower(text), {D.lit('‘’‚‛“”„‟')}, {D.lit(chr(39) * 4 + chr(34) * 4)})"
    norm = f"trim(regexp_replace({quotes}, r'(?d)[{BLANKS}]+', ' '))"
    apart = "regexp_replace(lower(text), r'(?d)(?<![a-z])([a-z]++)-([a-z]++)', r'$1 $2')"
    legacy = f"trim(translate(regexp_replace({apart}, r'(?d)[{BLANKS}]+', ' '), '\"\\'', ''))"
    ends = r"\n\r\x0b\x0c\x1c\x1d\x1e\x85\x{2028}-\x{2029}"
    lines = D.where(D.each(f"regexp_extract_all(text, r'(?d)[^{ends}]+', 0)", "ln", strip(D, "ln")), "ln", "ln <> ''")
    want = {"plain": norm, "s": _fold(norm), "s2": _fold(legacy), "low": _fold("lower(text)"), "lines": lines, "twice": f"{norm} RLIKE {D.rx(detectors.TWICE)}"}
    rows = _prepared(spark).sql("SELECT text, " + ", ".join(f"{k}, {e} AS want_{k}" for k, e in want.items()) + " FROM got").collect()
    assert len(rows) > 1500 and {r.twice for r in rows} == {True, False, None}
    for r in rows:
        for k in want:
            assert r[k] == r[f"want_{k}"], (k, r.text)


def test_folding_tells_words_but_for_odd_characters(spark):
    """A text is searched with Unicode classes only where its folded form, or such a character, asks for it."""
    points = spark.createDataFrame([(c,) for n in range(128, sys.maxunicode + 1) if not 0xD800 <= n < 0xE000 for c in (chr(n),)], "c string")
    other = points.where(f"(c RLIKE r'(?U)\\w') <> ({D.fold('c')} = '_') AND NOT c RLIKE r'{detectors.ODD}'")
    assert other.count() == 0
    blanks = points.where(f"(c RLIKE r'(?U)\\s') <> ({D.fold('c')} = ' ')")
    assert blanks.count() == 0


def test_a_single_space_is_no_match():
    """Before, each space between words was taken out and put in again."""
    assert "[" + ASCII_BLANKS + "]+'" not in text.norm(D, "text") + text.legacy_folded()


def test_sums_make_no_arrays_of_detections(spark):
    """Before, up to 35 structs were made of each performance, filtered, and their points added up one by one."""
    for name in ("score_columns", "account_next_state", "verdict_next_state", "ai_score", "match_verdict", "round_winner", "hprp_delta", "scan_total"):
        df = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
        assert "named_struct(ord" not in df._jdf.queryExecution().optimizedPlan().toString(), name
    assert "named_struct" in sqls.Q["scan_detect"](D)
