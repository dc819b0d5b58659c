"""Column functions over text: cleaning, chunk quality, DOIs, Markdown pieces.

All are built-in expressions (Column in, Column out); a null text stays null or counts as
empty where a function says so. Character classes are spelled out, because Java's \\w, \\s
and $ mean less, or other things, than the rules here.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space, word characters, digits and CJK as Unicode classes (Java and RE2 syntax).
BLANKS = r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WS = f"[{BLANKS}]"
BLANK_CHARS = "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
WORD = r"[\p{L}\p{N}_]"
DIGIT = (
    r"[\p{Nd}\x{b2}\x{b3}\x{b9}\x{2070}\x{2074}-\x{2079}\x{2080}-\x{2089}\x{2460}-\x{2468}\x{2474}-\x{247c}\x{2488}-\x{2490}\x{24ea}\x{24f5}-\x{24fd}\x{24ff}"
    r"\x{2776}-\x{277e}\x{2780}-\x{2788}\x{278a}-\x{2792}\x{1369}-\x{1371}\x{19da}\x{10a40}-\x{10a43}\x{10e60}-\x{10e68}\x{11052}-\x{1105a}\x{1f100}-\x{1f10a}]"
)
CJK = r"[\x{4e00}-\x{9fff}]"
PICTURE = "<!-- Start of picture text -->"
STRIP = rf"^{WS}+|{WS}+\z"
HYPHEN_LINE = rf"({WORD})-{WS}*\n{WS}*({WORD})"
HYPHEN_BLANK = rf"({WORD})-{WS}+({WORD})"
NUMBERS_ONLY = r"^[0-9" + BLANKS + r".,;:]+\z"
MARKS_ONLY = r"^[^\p{L}\p{N}_]+\z"
CAPTION = rf"^(?:Figure|FIGURE|Fig\.|Table|SOURCE|Source){WS}"
DOI = rf"10\.\p{{Nd}}{{4,}}/[^{BLANKS}]+"
UNSAFE = r'[\\/:*?"<>|]'
FENCE_OPEN = rf"^```(?:json)?{WS}*"
FENCE_CLOSE = rf"{WS}*```\z"
OBJECT = r"(?s)\{.*\}"


# The same rules for a whole text at once (Java syntax): a hyphen between words, whose left
# one is not the right one of the hyphen before; the blanks around a line's end; a line
# that is short, of numbers or of marks only, or holds the picture mark.
_HYPHEN = rf"-(?<={WORD}-)(?<!\G-)"
# (?![!-~]) rules most places out before the large class of blanks is asked.
_FLAT = BLANKS.replace(r"\t-\r", r"\t\x{b}-\r")
_EDGES = rf"(?![!-~])[{_FLAT}]*+\n{WS}*+"
_NOISE = rf"(?:\A|\n)(?:[^\n]{{1,2}}|[0-9{_FLAT}.,;:]++|[^\p{{L}}\p{{N}}_\n]++|[^\n<]*+(?:<(?!{PICTURE[1:]})[^\n<]*+)*+{PICTURE}[^\n]*+)(?=\n|\z)"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANK_CHARS))


def clean_text(c: Column) -> Column:
    """Soft hyphens and hyphenation out, blanks collapsed, noise lines dropped."""
    c = F.replace(c, F.lit("\xad"), F.lit(""))
    c = F.regexp_replace(c, rf"{_HYPHEN}{WS}*\n{WS}*({WORD})", "$1")
    c = F.regexp_replace(c, rf"{_HYPHEN}{WS}+({WORD})", "$1")
    c = F.regexp_replace(c, "[ \t]{2,}|\t", " ")  # a single blank stays as it is
    c = F.regexp_replace(strip(c), _EDGES, "\n")
    return F.regexp_replace(F.regexp_replace(c, _NOISE, ""), r"\A\n", "")


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(c, "<[^>]+>", "")


def count_chars(c: Column, kind: str) -> Column:
    """Characters of a class ``[...]``: what is left when runs of all others go."""
    return F.length(F.regexp_replace(c, "[^" + kind[1:-1] + "]+", ""))


def digits(c: Column) -> Column:
    """Digits of any script. Other ASCII goes first, by a class that is cheap to test."""
    return count_chars(F.regexp_replace(c, r"[\x{0}-/:-\x{7f}]+", ""), DIGIT)


def english_words(c: Column) -> Column:
    return F.size(F.regexp_extract_all(c, F.lit("[a-zA-Z]+"), 0))


def _stretches(c: Column, marks: str, least: int) -> Column:
    """Pieces between ``marks`` (the inside of a class) with ``least`` characters or more after stripping.

    One match a piece, from its first character that is no blank to its last.
    """
    edge, inside = f"[^{BLANKS}{marks}]", f"[^{marks}]"
    return F.regexp_count(c, F.lit(edge if least == 1 else f"{edge}{inside}{{{least - 2},}}{edge}"))


def pieces(c: Column, marks: str, longer: int) -> Column:
    """Pieces between ``marks`` (the first of them ASCII) that have more than ``longer`` characters after stripping.

    Marks beyond ASCII become the first one: a class that holds them takes eight times as long.
    """
    for mark in marks:
        c = c if mark.isascii() else F.replace(c, F.lit(mark), F.lit(marks[0]))
    return _stretches(c, "".join(filter(str.isascii, marks)), longer + 1)


def line_count(c: Column) -> Column:
    """Lines with anything but blanks."""
    return F.regexp_count(c, F.lit(f"[^{BLANKS}][^\n]*+"))


def breaks(c: Column) -> Column:
    return F.size(F.split(c, "<br>")) - 1


def too_many_short_lines(c: Column, share: float = 0.5) -> Column:
    """More than ``share`` of the filled lines have fewer than 15 characters; true without lines."""
    n = line_count(c)
    return F.coalesce((n - _stretches(c, "\n", 15)) / F.nullif(n, F.lit(0)) > share, F.lit(True))


def is_figure_caption(c: Column) -> Column:
    rest = strip(F.array_join(F.slice(F.split(c, "\n"), 2, 2147483647), "\n"))
    labels = F.forall(F.split(rest, "\n"), lambda x: F.length(strip(x)) < 20)
    return (c.rlike(CAPTION) & ((F.length(rest) < 80) | labels)) | (breaks(c) > 5) | c.rlike("(?i)picture text")


def reject_reason(c: Column) -> Column:
    """Name of the first quality rule that a chunk fails, or ok."""
    n, cjk = F.length(c), count_chars(c, CJK)
    note = F.contains(c, F.lit("<!--")) & (pieces(c, ".!?", 15) < 3) & (cjk < 80)
    return (
        F.when(n < 120, "short")
        .when(digits(c) / n > 0.2, "digits")
        .when((count_chars(c, r"[\p{L}]") + cjk) / n < 0.5, "letters")
        .when((english_words(c) < 25) & (cjk < 50), "words")
        .when(pieces(c, ".!?。！？", 10) < 2, "sentences")
        .when(too_many_short_lines(c), "shortlines")
        .when(is_figure_caption(c), "caption")
        .when(note, "note")
        .otherwise("ok")
    )


def dois(c: Column) -> Column:
    return F.transform(F.regexp_extract_all(c, F.lit(DOI), 0), lambda m: F.regexp_replace(m, r"[.,;)]+\z", ""))


def doi(c: Column) -> Column:
    return F.get(dois(c), F.lit(0))


def doi_status(c: Column) -> Column:
    n = F.size(F.regexp_extract_all(c, F.lit(DOI), 0))
    return F.when(n == 0, "未找到").when(n == 1, "已找到").otherwise("待确认")


def preview(c: Column, n: int = 300) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def safe_name(c: Column) -> Column:
    return F.substring(F.regexp_replace(c, UNSAFE, "-"), 1, 100)


def numbered(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")


def page_suffix(pages: Column, before: str, after: str) -> Column:
    listed = F.array_join(F.transform(pages, lambda p: p.cast("string")), ", ")
    return F.when(F.size(pages) > 0, F.concat(F.lit(before), listed, F.lit(after)))


def evidence_markdown(e: Column, number: Column | None = None) -> Column:
    text = F.coalesce(e["text"], F.lit("")) if number is None else F.concat((number + 1).cast("string"), F.lit(". "), F.coalesce(e["text"], F.lit("")))
    excerpt = F.when(e["evidence_excerpt"] != "", F.concat(F.lit("   - 原文依据："), e["evidence_excerpt"]))
    return F.concat_ws("\n", text, page_suffix(e["evidence_pages"], "   - 证据页码：第 ", " 页"), excerpt)


def evidence_list_markdown(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda e, i: evidence_markdown(e, i)), "\n")


def evidence_cell(e: Column) -> Column:
    return F.concat(e["text"], F.coalesce(page_suffix(e["evidence_pages"], "（第", "页）"), F.lit("")))


def evidence_list_cell(items: Column) -> Column:
    return numbered(F.transform(items, evidence_cell))


def clean_json_text(c: Column) -> Column:
    """The object inside a model's answer: fences off, then first brace to last."""
    c = F.regexp_replace(F.regexp_replace(strip(c), FENCE_OPEN, ""), FENCE_CLOSE, "")
    return F.when(c.rlike(OBJECT), F.regexp_extract(c, OBJECT, 0)).otherwise(c)
