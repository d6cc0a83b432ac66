"""Text operators: normalisation, line splitting, transcript cleaning. Each gives SQL for a dialect."""
from __future__ import annotations

from .dialect import ASCII_BLANKS, BLANK, BLANKS, Spark, plain, strip

EOL = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\u0085\u2028\u2029]"
_EOL_ASCII = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e]"
#: BLANKS without a class in a class.
_FLAT_BLANKS = ASCII_BLANKS + r"\x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"

# Transcription errors and what they stand for; a trailing group is given back.
SLANG = (
    (r"\btech knives\b", "tech nines"),
    (r"\bblip jam\b", "blick jam"),
    (r"\bblip( pop| spray| boom)", "blick$1"),
    (r"\bglock 40\b", "Glock 40"),
    (r"\bglissies\b", "glizzies"),
    (r"\bglissys\b", "glizzies"),
    (r"\bchris(?:t)? on biases\b", "christened biases"),
    (r"\bchurch bands\b", "church vans"),
    (r"\bchurch vets\b", "church vans"),
    (r"\blet'?s love\b( I'?ll send| I send)", "let fly$1"),
    (r"\bain'?t a cracker cuz in your heart you ain'?t got no hate for my (?:car|con)\b", r"ain\x27t a cracker cuz in your heart you ain\x27t got no hate for my kind"),
)
# Lines that hold nothing but a call to the crowd.
ADLIBS = (
    r"^(yo|yeah|uh-?huh|okay|alright|aight|check it( out)?)\b[\s,.\-]*$",
    r"^(you know( what)?( i)?[\']?m sayin[\'g]?|feel me|ya feel me)\b[\s,.\-]*$",
    r"^(yeah\s+)+yeah\b[\s,.\-]*$",
    r"^(let'?s go|let'?s get it|come on)\b[\s,.\-!]*$",
)
# What makes an opening more than generic, and generic openings.
CRAFT = r"\b(like (?:a|an|the|that|those|you|this)\b|as if\b|as a\b|than (?:a|an|the)\b|more \w+ than\b|less \w+ than\b)"
OPENERS = r"\b(welcome to (hell|the show)|let'?s go|yo what'?s up|what'?s up|aye yo|this is the )\b"


#: The quotes that norm makes plain, as a pattern of Spark.
_QUOTES = r"r'[\x{2018}-\x{201F}]'"


def eol(d: Spark) -> str:
    return EOL if d.name == "spark" else _EOL_ASCII


def _spaced(x: str, blanks: str) -> str:
    """A blank for each run of blanks; a run of one blank that is a space is no match, as it stays."""
    return f"regexp_replace({x}, r'(?d)[{blanks}](?:[{blanks}]+|(?<! ))', ' ')"


def norm(d: Spark, x: str, lowered: str = "") -> str:
    """Lower case, plain quotes, single spaces; lowered: a column of x in lower case."""
    y = low = lowered or f"lower({x})"
    quoted = f"translate({y}, {d.lit(chr(0x2018) + chr(0x2019) + chr(0x201A) + chr(0x201B) + chr(0x201C) + chr(0x201D) + chr(0x201E) + chr(0x201F))}, {d.lit(chr(39) * 4 + chr(34) * 4)})"
    if d.name == "spark":  # those quotes are beyond ASCII, and few texts have one
        y = f"(CASE WHEN {low} RLIKE {_QUOTES} THEN {quoted} ELSE {low} END)"
        return f"trim({plain(x, _spaced(low, ASCII_BLANKS), _spaced(y, BLANKS))})"
    return strip(d, d.replace(quoted, BLANK + "+", " "))


def _apart(x: str, lowered: str) -> str:
    return f"(CASE WHEN contains({x}, '-') THEN regexp_replace({lowered}, r'(?d)(?<![a-z])([a-z]++)-([a-z]++)', r'$1 $2') ELSE {lowered} END)"


def norm_folded(d: Spark) -> str:
    """norm, folded, from columns text, lowered, low (lowered, folded) and plain: a character is folded by itself, so only quotes, which norm makes plain, have to go first."""
    return f"(CASE WHEN octet_length(text) = length(text) THEN plain WHEN lowered RLIKE {_QUOTES} THEN {d.fold('plain')} ELSE trim({_spaced('low', ASCII_BLANKS)}) END)"


def legacy_folded() -> str:
    """norm_legacy, folded, from low."""
    own = _spaced(_apart("low", "low"), ASCII_BLANKS)
    return f"trim(replace(replace({own}, '\"', ''), '\\'', ''))"


def norm_legacy(d: Spark, x: str) -> str:
    """Lower case, hyphenated words apart, single spaces, no quotes."""
    if d.name == "spark":  # a word is looked at from its beginning alone
        y = _apart(x, f"lower({x})")
        y = plain(x, _spaced(y, ASCII_BLANKS), _spaced(y, BLANKS))
        return f"trim(replace(replace({y}, '\"', ''), '\\'', ''))"
    y = d.replace(d.replace(f"lower({x})", "([a-z]+)-([a-z]+)", "$1 $2"), BLANK + "+", " ")
    return strip(d, f"translate({y}, {d.lit(chr(34) + chr(39))}, '')")


def lines(d: Spark, x: str) -> str:
    """Stripped lines that aren't blank."""
    if d.name == "spark":  # a line's end is a blank too, so a line is what goes from a character that is none to the last such one before an end
        ends = r"\n\r\x0b\x0c\x1c\x1d\x1e"
        return plain(x, *(f"regexp_extract_all({x}, r'(?d)[^{b}](?:[^{e}]*[^{b}])?', 0)" for b, e in ((ASCII_BLANKS, ends), (_FLAT_BLANKS, ends + r"\x85\x{2028}-\x{2029}"))))
    return d.where(d.each(d.split(x, eol(d)), "ln", strip(d, "ln")), "ln", "ln <> ''")


def slang(d: Spark, x: str) -> str:
    for pattern, by in SLANG:
        by = by.replace(r"\x27", "\\'" if d.name == "spark" else "''")
        x = f"regexp_replace({x}, {d.rx('(?i)' + pattern)}, '{by}')" if d.name == "spark" else d.replace(x, "(?i)" + pattern, by)
    return x


def auto_split(d: Spark, x: str) -> str:
    """Text of more than 15 words a line cut at sentences, and sentences of more than 18 words at commas."""
    own = d.where(d.each(d.split(d.replace(strip(d, x), r"([.!?])\s+", "$1\x01"), "\x01"), "sn", strip(d, "sn")), "sn", "sn <> ''")
    cut = d.each(own, "se", f"CASE WHEN {d.size(d.words('se'))} > 18 THEN {d.where(d.each(d.split('se', ',' + BLANK + '+'), 'pt', strip(d, 'pt')), 'pt', 'pt <> ' + chr(39) * 2)} ELSE {d.array(['se'])} END")
    n = d.size(lines(d, x))
    return f"CASE WHEN {n} = 0 OR {d.size(d.words(x))} <= 15 * {n} THEN {x} ELSE {d.join(d.flat(cut), chr(10))} END"


def adlib_strip(d: Spark, x: str) -> str:
    """Text without lines that are ad-libs; blank lines stay."""
    test = " OR ".join(d.has(strip(d, "ln"), "(?i)" + p) for p in ADLIBS)
    body = d.replace(x, f"(?:{eol(d)})$", "") if d.name != "spark" else f"regexp_replace({x}, r'(?:{eol(d)})\\z', '')"
    return d.join(d.where(d.split(body, eol(d)), "ln", f"NOT ({test})"), "\n")


def opening(d: Spark, x: str) -> str:
    return d.join(d.part(d.words(d.at(lines(d, x), "1")), "1", "10"), " ")


def ogr_block(d: Spark, x: str) -> str:
    """Whether the first ten words are a generic opening."""
    o = opening(d, x)
    return f"coalesce(NOT {d.has(o, '(?i)' + CRAFT)} AND {d.has(o, '(?i)' + OPENERS)}, false)"


def prompt_ascii(d: Spark, x: str) -> str:
    for a, b in ((chr(0x2014), "--"), (chr(0x2026), "..."), (chr(0x2192), "->"), (chr(0x2260), "!=")):
        x = f"replace({x}, {d.lit(a)}, {d.lit(b)})"
    return x


def snip(d: Spark, s: str, x: str, p: str, pad: int) -> str:
    """pad characters of x around the first match of p in s, whose places may differ; line ends shown as ' | '."""
    return snip_at(d, x, d.before(s, p), f"length({d.extract(s, p)})", pad)


def snip_at(d: Spark, x: str, at: str, n: str, pad: int) -> str:
    if d.name == "spark":  # the place is found once
        piece = f"substring({x}, greatest(at - {pad}, 0) + 1, least(length({x}), at + {n} + {pad}) - greatest(at - {pad}, 0))"
        return d.replace(strip(d, f"transform(array({at}), at -> {piece})[0]"), r"\s*[\r\n]+\s*", " | ")
    start = f"greatest({at} - {pad}, 0)"
    piece = f"substring({x}, {start} + 1, least(length({x}), {at} + {n} + {pad}) - {start})"
    return d.replace(strip(d, piece), r"\s*[\r\n]+\s*", " | ")
