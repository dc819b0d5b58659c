import re

import pytest
from pyspark.sql import functions as F

from scriptorium.functions import records as R
from scriptorium.functions import text as T

CLEAN = [
    ("high\xadtech", "hightech"), ("evalu-\nate", "evaluate"), ("well- known", "wellknown"), ("a- b- c", "ab- c"), ("foo -\nbar", "foo -\nbar"), ("12 34.5, 6", ""), ("*** ---", ""), ("中文", ""),
    ("x <!-- Start of picture text --> y", ""), ("中文内容", "中文内容"), ("　abc\xa0", "abc"), ("one\n\n\n\ntwo", "one\ntwo"), ("１２３", "１２３"), ("", ""),
]
DOIS = [("see 10.1234/ab.c),", "10.1234/ab.c", "已找到"), ("10.123/x", None, "未找到"), ("10.1000/a 10.1000/a", "10.1000/a", "待确认"), ("10.1234/a,10.5555/b", "10.1234/a,10.5555/b", "已找到")]
LISTS = [
    ("null", []), ('"  "', []), ('["a",1]', ["a", "1"]), ("\"['a', 'b']\"", ["a", "b"]), ("\"('a', 'b')\"", ["a", "b"]), ('"[1, 2]"', ["1", "2"]), ('"(x)"', ["(x)"]), ("\"('a')\"", ["('a')"]),
    ('"[a, b]"', ["[a, b]"]), ("\"{'a': 1}\"", ["{'a': 1}"]), ('"123"', ["123"]), ('" x "', ["x"]), ("7", ["7"]),
]
PAGES = [("5", [5]), ('[1,"2","z",3.7,true,null]', [1, 2, 3, 1]), ('["3.7"," 4 "]', [4]), ('"3"', []), ("null", [])]


def column(spark, rows, f, kind="string"):
    frame = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, c {kind}")
    return [r.x for r in frame.select("i", f(F.col("c")).alias("x")).orderBy("i").collect()]


def test_clean_text(spark):
    assert column(spark, [a for a, _ in CLEAN], T.clean_text) == [b for _, b in CLEAN]


def test_doi(spark):
    assert column(spark, [a for a, _, _ in DOIS], T.doi) == [b for _, b, _ in DOIS]
    assert column(spark, [a for a, _, _ in DOIS], T.doi_status) == [c for _, _, c in DOIS]


def test_string_list(spark):
    assert column(spark, [a for a, _ in LISTS], lambda c: R.string_list(F.try_parse_json(c))) == [b for _, b in LISTS]


def test_page_list(spark):
    assert column(spark, [a for a, _ in PAGES], lambda c: R.page_list(F.try_parse_json(c))) == [b for _, b in PAGES]


def test_evidence(spark):
    one = column(spark, ['"s"', "null", "3", "[1]"], lambda c: R.evidence(F.try_parse_json(c)))
    assert [tuple(x) for x in one] == [("s", [], ""), ("", [], ""), ("", [], ""), ("", [], "")]
    many = column(spark, ['""', "null", "3", '[1, "a", {"text":"b","evidence_pages":2}]'], lambda c: R.evidence_list(F.try_parse_json(c)))
    assert [[tuple(e) for e in m] for m in many] == [[("", [], "")], [], [], [("a", [], ""), ("b", [2], "")]]


@pytest.mark.parametrize(
    ("text", "reason"),
    [
        ("x" * 119, "short"), ("9" * 26 + "a" * 100, "digits"), ("9" * 25 + "a" * 100, "words"), ("*" * 70 + "a" * 60, "letters"), ("word " * 24, "words"), ("word " * 30, "sentences"),
        ("中" * 25 + "。" + "文" * 25 + "。" + " " * 69 + "x", "ok"), ("a sentence here. " * 10, "ok"), ("\n".join(["short line."] * 12 + ["a longer line that is long enough."] * 3), "shortlines"),
        ("a sentence here. " * 10 + "<br>" * 6, "caption"), ("a sentence here. " * 10 + "<br>" * 5, "ok"), ("word word " * 14 + ". abcdefghijklmnop <!--", "note"),
    ],
)
def test_reject_reason(spark, text, reason):
    assert column(spark, [text], T.reject_reason) == [reason]


def test_null_text_counts(spark):
    assert column(spark, [None, ""], T.clean_text) == [None, ""]
    assert column(spark, ["a/b:c*d" + "e" * 200], T.safe_name) == [("a-b-c-d" + "e" * 200)[:100]]


def test_evidence_markdown(spark):
    rows = column(spark, [("t", [1, 2], "x"), ("t", [], "")], T.evidence_markdown, R.EVIDENCE)
    assert rows == ["t\n   - 证据页码：第 1, 2 页\n   - 原文依据：x", "t"]
    assert column(spark, [("t", [1, 2], "x"), ("t", [], "")], T.evidence_cell, R.EVIDENCE) == ["t（第1, 2页）", "t"]


def test_pieces_go_by_ascii_classes(spark):
    texts = ["", "一二三四五六七八九十十一。短！abcdefghijklm？ no", "a b c d e f g. h! ij", "。。", "x" * 12 + "？" + "y" * 10 + "." + "z" * 11]
    count = T.pieces(F.col("t"), ".!?。！？", 10)
    pattern = count._jc.toString()
    assert "[^.!?]" in pattern
    got = [r.n for r in spark.createDataFrame([(t,) for t in texts], "t string").select(count.alias("n")).collect()]
    assert got == [sum(len(p.strip()) > 10 for p in re.split("[.!?。！？]+", t)) for t in texts]
