"""Personal data in notations that the base rules do not know."""

import random

import pytest
from pyspark.sql import functions as F

from scriptorium.llm import op6_pii

PLANTED = {
    "write to jane(at)host3.org now": "write to [EMAIL] now",
    "write to jane [at] host3 [dot] org now": "write to [EMAIL] now",
    "write to jane(at)mail(dot)host3(dot)org now": "write to [EMAIL] now",
    "call (234) 555-6789 now": "call [PHONE] now",
    "call 234-555-6789 now": "call [PHONE] now",
    "call 1 (234) 555-6789 now": "call [PHONE] now",
    "card 4111.1111.1111.1111 now": "card [CARD] now",
    "card 4111/1111/1111/1111 now": "card [CARD] now",
    "server 10[.]0[.]3[.]7 here": "server [IP] here",
    "server 194[.]238[.]35[.]7 here": "server [IP] here",
    "host 10(dot)20(dot)3(dot)7 here": "host [IP] here",
    "ip 194 [dot] 238 [dot] 35 [dot] 7 here": "ip [IP] here",
}
CLEAN = [
    "number 4111111111111112 in the table", "number 4111.1111.1111.1112 in the table", 'token = "21135a35f4dd810370798c4b15d2c"', "from 2024-01-15 to 2024-02-15", "born 12.05.1987 here",
    "rows 10, 20, 30, 40 of it", "a total of 123 456 789 units", "in 1990-2004 it was", "value 12345.678901 m", "version 999[.]1[.]2[.]3 x", "meet us @ home. The end", "no numbers at all",
]


def luhn_end(head):
    return next(head + str(d) for d in range(10) if sum(v if i % 2 == 0 else 2 * v - 9 * (v > 4) for i, v in enumerate(map(int, reversed(head + str(d))))) % 10 == 0)


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(3)
    out = []
    for i in range(400):
        name = "".join(rnd.choice("abcdefgh") for _ in range(6))
        host = rnd.choice(("", "mail.")) + f"host{i % 7}.{rnd.choice(('org', 'com'))}"
        card = luhn_end("4" + "".join(rnd.choice("0123456789") for _ in range(14)))
        out.append((i, f"mail {name}@{host} or call +1 ({rnd.randrange(200, 999)}) 555-{rnd.randrange(1000, 9999)} at {rnd.randrange(1, 255)}.{rnd.randrange(255)}.{rnd.randrange(255)}.7 card {card} end"))
    texts = [*PLANTED, *CLEAN]
    return out + [(1000 + i, t) for i, t in enumerate(texts)]


def test_planted_notations_are_found_and_redacted(spark, rows):
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    texts = {r.doc_id: r.text for r in op6_pii.redact(frame).collect()}
    was = dict(rows)
    got = {was[i]: t for i, t in texts.items() if i >= 1000}
    assert {t: got[t] for t in PLANTED} == PLANTED
    dealt = {r.doc_id: r.text for r in op6_pii.redact(frame.repartition(7, "text")).where("doc_id >= 1000").collect()}
    assert {was[i]: t for i, t in dealt.items()} == got  # however the rows are dealt
    assert {t: got[t] for t in CLEAN} == {t: t for t in CLEAN}
    found = {r.doc_id: r for r in op6_pii.find_spans(frame).where("doc_id >= 1000").collect()}
    for i, r in found.items():
        assert not r.base and len(r.spans) == (was[i] in PLANTED)


def test_very_many_spans_in_one_text(spark):
    """A log of 360 KB with 40,000 addresses: positions and redaction are right, and the work per span does not grow."""
    import time

    from scriptorium.llm import op6_pii as O

    times = []
    for many in (4_000, 40_000):
        parts = [f"{i % 250}.{i % 7}.1.{i % 9}" for i in range(many)]
        text = " é ".join(parts) + " Ünd tail"
        frame = spark.createDataFrame([(1, text), (2, "none")], "doc_id long, text string").repartition(1)
        found = frame.select("doc_id", O._of_kinds(O.base_spans(F.col("text"))).alias("s"))
        found.collect()
        began = time.time()
        spans = {r["doc_id"]: r["s"] for r in found.collect()}
        times.append(time.time() - began)
        starts, at = [], 0
        for p in parts:
            starts.append((at, at + len(p), p))
            at += len(p) + 3
        assert [(s["start"], s["end"], s["text"]) for s in spans[1]] == starts and spans[2] == []
    assert times[1] < 10 and times[1] < 25 * max(times[0], 0.3)
    clean = {r["doc_id"]: r["text"] for r in O.redact(frame).collect()}
    assert clean[1] == " é ".join(["[IP]"] * 40_000) + " Ünd tail" and clean[2] == "none"


def test_spans_that_cross_blocks_and_overlap(spark, monkeypatch):
    from scriptorium.llm import op6_pii as O

    monkeypatch.setattr(O, "_BLOCK", 7)
    texts = ["x +41 44 668 18 00 y a.b@example.org z 4111 1111 1111 1111", "a@b.c", "", None, "é" * 20, "+12345678901234 10.0.0.1"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 AS gaps", "2 AS blocks", "3 AS spans")
    found = {r["doc_id"]: r["spans"] for r in O.find_spans(frame).collect()}
    clean = {r["doc_id"]: r["text"] for r in O.redact(frame).collect()}
    for i, text in enumerate(texts):
        out, at = "", 0
        for s in found[i] if text else []:
            if s["start"] >= at:
                out += text[at : s["start"]] + f"[{O.KINDS[s['kind']].upper()}]"
            at = max(at, s["end"])
        assert clean[i] == (text if not text else out + text[at:])


def test_a_kind_with_few_calibration_rows_goes_by_all_kinds():
    from scriptorium.llm.op6_pii import _limit

    others = [(False, at, 100, 100.0 if at >= 30 else 20.0) for at in range(50)]
    assert _limit(others, 0.99) == 0.6  # no row of its own
    assert _limit(others + [(True, 45, 3, 3.0)], 0.99) == 0.6 and _limit(others + [(True, 45, 3, 0.0)], 0.99) == 0.92
    assert _limit([(True, 49, 50, 0.0)], 0.99) is None and _limit([], 0.99) is None


def test_trees_and_thresholds_see_every_labelled_proposal(spark, monkeypatch):
    """Of more than 20,000 labelled proposals none is left out, nor what is made of them."""
    seen, write = {}, op6_pii.written

    class Enough(Exception):
        pass

    def written(df, name, **options):
        seen[name] = write(df, name, **options)
        if name == "pii-weighed":
            raise Enough
        return seen[name]

    monkeypatch.setattr(op6_pii, "written", written)
    rows = [(i, " ".join(f"mail u{i}x{j}@host{j}.org now" for j in range(15))) for i in range(1500)]
    with pytest.raises(Enough):
        op6_pii.find_spans(spark.createDataFrame(rows, "doc_id long, text string"))
    told = seen["pii-proposals"].where("label IS NOT NULL").count()
    assert told >= 22_000 and seen["pii-weighed"].agg(F.sum("n")).first()[0] == told + seen["pii-made"].count()
