"""Spark's spellings of blanks, lines and words give what the patterns over Unicode classes give, and a scan has none of those."""
from barlane.functions import detectors, similarity, text
from barlane.functions.dialect import BLANK, Spark, strip
from barlane.plans import sqls

D = Spark()
ODD = [
    "", " ", "\n", "\x1c\x1f", "\xa0 x 　", "a-b-c one-on-one A-b ab- -ab x--y a-1-b é-a", "“Q” ‘q’ \"r\"  'it' \" '", "a\u0085b c d\x0be\x0cf\x1cg\x1dh\x1ei\x1fj\r\nk\n\nl",
    "ΟΔΟΣ ΣΑΣ\nΣ ΣΑΣ x", "İstanbul​x﻿y᠎z", "😀 漢字 the the", "é é", "a  \t b\t\tc   d", "like um\nlike um\nyeah so and the word\nsix words are in this line here\nsix words are in other lines too",
    "heavy heavy word word wordy_x heavy9 abcd", "ß ﬁ ǅ \x00 dead\nover\nx done\nkilled and gone", "dead dead\n\n", " led    ",
]


def _rows(spark, x):
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*ODD, " \n".join(ODD), None])], "i int, text string")
    df = df.selectExpr("*", f"{text.norm(D, 'text')} AS plain", f"{text.lines(D, 'text')} AS lines").selectExpr("*", f"{D.folded('plain')} AS s", f"{D.folded('lower(text)')} AS low", "size(lines) AS n")
    return [r[0] for r in df.orderBy("i").selectExpr(f"{x} AS x").collect()]


def test_blanks_lines_and_words_as_by_unicode_classes(spark):
    old_strip = lambda x: D.replace(x, f"^{BLANK}+|{BLANK}+$", "")
    quotes = "".join(map(chr, range(0x2018, 0x2020)))
    pairs = [
        (strip(D, "text"), old_strip("text")),
        (D.words("text"), D.all("text", "[^" + BLANK[1:] + "+")),
        (text.norm(D, "text"), old_strip(D.replace(f"translate(lower(text), '{quotes}', {D.lit(chr(39) * 4 + chr(34) * 4)})", BLANK + "+", " "))),
        (text.norm_legacy(D, "text"), old_strip(f"translate({D.replace(D.replace('lower(text)', '([a-z]+)-([a-z]+)', '$1 $2'), BLANK + '+', ' ')}, {D.lit(chr(34) + chr(39))}, '')")),
        (text.lines(D, "text"), D.where(D.each(D.split("text", text.EOL), "ln", old_strip("ln")), "ln", "ln <> ''")),
        (detectors.repeated_word(D), "plain RLIKE r'(?U)\\b(\\w+)\\s+\\1\\b'"),
    ]
    for new, old in pairs:
        assert _rows(spark, new) == _rows(spark, old), new


def test_facts_of_lines_as_sql_gives_them(spark):
    solid = D.size(D.where("lines", "l", f"{D.size(D.words('l'))} >= 6 AND {detectors._distinct_less(D, 'l', detectors.MID_FILLER)} >= 4"))
    want = _rows(spark, f"array({detectors._again(D)}, {detectors._thin(D)}, {solid})")[:-1]
    assert [list(similarity.facts(x)) for x in _rows(spark, "lines")[:-1]] == want
    assert [similarity.top(s) for s in _rows(spark, "s")] == _rows(spark, detectors.top_word(D))
    dense = "filter(filter(sequence(1, greatest(n - 2, 1)), q -> q <= n - 2), i -> {} >= 2)".format(D.counted(D.fold("lower(array_join(slice(lines, i, 3), ' '))"), detectors.IMPACT))
    assert [x or [] for x in _rows(spark, detectors._dense(D))] == [x or [] for x in _rows(spark, dense)]


def test_a_scan_looks_for_no_words_of_lines_in_patterns():
    """Before, it took the words of each line four times, and sorted those of the text."""
    for name in ("scan_total", "scan_detect", "round_winner", "match_verdict"):
        sql = sqls.Q[name](D)
        layers = sql[sql.index("repeated0 AS ("):]
        assert "EXCEPT (top)" in layers and "array_sort" not in layers and D.words("l") not in layers, name
