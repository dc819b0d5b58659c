"""HTML extraction, WARC, tokens, ORC and packing."""

import base64
import hashlib
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from scriptorium.llm import op1_html, op2_packing, op3_warc, op9_token_orc
from scriptorium.llm.common import scratch_path, table, word_bpe_path
from scriptorium.llm.tokens import WordEncoder, encoder

ODD = ["á ́b <|endoftext|>x don't I'LL  \x1c y z\x0bq '\nT", "", "   ", "İ ΣΑΣ. ß", "a" * 500 + " " + "b" * 70 + "\n\n\tc", "가 x", "***. a,, b.. c.", "A<|ENDOFTEXT|>b", "3. x,y. 'tis it's, ok.", "日本語 text，mixed。"]


@pytest.fixture(scope="module")
def whole():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(word_bpe_path())
    return lambda text: np.array(tokenizer.encode(text or "", add_special_tokens=False).ids, dtype="<u4").tobytes()


def test_words_give_the_ids_of_whole_texts(spark, sf, whole):
    texts = ODD + [r.text for r in table(spark, sf, "documents").collect()]
    for most in (1_000_000, 50):
        assert WordEncoder(word_bpe_path(), most).encode(texts) == [whole(t) for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("aBcé'.,!* \n\t3\xa0Σßx<|>́"), max_size=40))
def test_words_give_the_ids_of_any_text(text):
    from tokenizers import Tokenizer

    ids = Tokenizer.from_file(word_bpe_path()).encode(text, add_special_tokens=False).ids
    assert encoder(word_bpe_path()).encode([text]) == [np.array(ids, dtype="<u4").tobytes()]


def docs(spark, rows, extra=True):
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    from pyspark.sql import functions as F

    return frame.select("*", F.lit(1).alias("part"), F.lit("x").alias("node"), F.lit(2).alias("row"), F.lit(3).alias("length")) if extra else frame


ROWS = [(3, "one two three"), (1, None), (2, ""), (None, "null id"), (7, "same"), (7, "same"), (9, "word " * 5000)]


def test_orc_round_trip(spark, whole):
    path = scratch_path(spark, "t")
    op9_token_orc.write_tokens(docs(spark, ROWS), path, word_bpe_path())
    rows = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in op9_token_orc.token_digest(op9_token_orc.read_tokens(spark, path)).collect())
    start = 0
    assert [r[1] for r in rows] == [None, 1, 2, 3, 7, 7, 9]
    texts = {i: t for i, t in ROWS}
    for s, i, n, crc in rows:
        ids = whole(texts[i]) + np.array([2], dtype="<u4").tobytes()
        assert (s, n, crc) == (start, len(ids) // 4, zlib.crc32(ids))
        start += n


def test_orc_skips_what_cannot_hold_a_document(spark):
    """Of several row groups, a search for one doc_id reads those whose index and Bloom filter admit it."""
    path = scratch_path(spark, "t")
    frame = spark.range(0, 60_000).selectExpr("id * 2 AS doc_id", "'a few words' AS text").coalesce(2)
    op9_token_orc.write_tokens(frame, path, word_bpe_path(), stripe_bytes=1 << 16)
    rows = spark.read.orc(path)

    def read(where):
        found = rows.where(where)
        plan = found._jdf.queryExecution().executedPlan()
        n = found._jdf.collectAsList().size()
        while plan.children().size():
            plan = plan.children().head()
        return n, plan.metrics().get("numOutputRows").get().value()

    assert read("doc_id = 5000") == (1, read("doc_id = 5000")[1]) and 0 < read("doc_id = 5000")[1] <= 20_000
    assert read("doc_id = 5001")[0] == 0 and read("doc_id = 5001")[1] <= 10_000
    assert rows.count() == 60_000 and spark.read.orc(path).rdd.getNumPartitions() >= 1


def test_other_vocabularies_encode_whole_texts(tmp_path, whole):
    """A file with other steps before its merges gets the library's ids, not those of single words."""
    import json

    from tokenizers import Tokenizer

    from scriptorium.llm import tokens

    assert tokens.by_words(word_bpe_path())
    found = json.load(open(word_bpe_path(), encoding="utf-8"))
    found["normalizer"] = None
    (tmp_path / "v.json").write_text(json.dumps(found), encoding="utf-8")
    other, full = tokens.encoder(str(tmp_path / "v.json")), Tokenizer.from_file(str(tmp_path / "v.json"))
    texts = ["Capital Letters, and  blanks.", None, "", "é É"]
    assert isinstance(other, tokens.TextEncoder)
    assert other.encode(texts) == [np.asarray(full.encode(t or "", add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]
    with pytest.raises(ValueError, match="whole texts"):
        tokens.WordEncoder(str(tmp_path / "v.json"))


def test_orc_of_nothing(spark):
    path = scratch_path(spark, "t")
    op9_token_orc.write_tokens(docs(spark, []), path, word_bpe_path())
    assert op9_token_orc.token_digest(op9_token_orc.read_tokens(spark, path)).count() == 0


def test_packing_places_every_token_once(spark, sf, whole):
    for frame, capacity in ((docs(spark, ROWS), 64), (table(spark, sf, "documents"), 2048)):
        texts = frame.select("doc_id", "text").collect()
        rows = op2_packing.pack_documents(frame, word_bpe_path(), capacity).collect()
        assert sum(r.length for r in rows) == sum(len(whole(t.text)) // 4 + 1 for t in texts)
        places = {}
        for r in rows:
            assert r.start == r.piece * capacity and 0 < r.length <= capacity
            places.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for at in places.values():
            end = 0
            for offset, length in sorted(at):
                assert offset == end
                end += length
            assert end <= capacity
        assert len(places) <= -(-sum(r.length for r in rows) // capacity) + max(1, len(rows) // 50) or capacity == 64
    assert op2_packing.pack_documents(docs(spark, []), word_bpe_path()).count() == 0


def best_possible(lengths, capacity):
    """Fewest bins, by trying everything."""
    best = [len(lengths)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(bins)
            return
        for k in {b: k for k, b in enumerate(bins) if b >= lengths[i]}.values():
            bins[k] -= lengths[i]
            go(i + 1, bins)
            bins[k] += lengths[i]
        go(i + 1, [*bins, capacity - lengths[i]])

    lengths = sorted(lengths, reverse=True)
    go(0, [])
    return best[0]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=12))
def test_bin_completion_against_brute_force(lengths):
    counts = np.bincount(lengths, minlength=21)
    patterns = op2_packing.bin_completion(counts, 20)
    left = counts.copy()
    for pattern, times in patterns:
        assert sum(pattern) <= 20
        for x in pattern:
            left[x] -= times
    assert not left.any()
    assert sum(t for _, t in patterns) == best_possible(lengths, 20)


def test_pieces_that_no_pair_starts_right():
    """Five sequences by best fit behind every single length and pair; four are possible."""
    lengths = [9, 13, 14, 15, 16, 18, 18, 21, 23, 23, 25]
    patterns = op2_packing.bin_completion(np.bincount(lengths, minlength=51), 50)
    assert op2_packing.gap(patterns, np.bincount(lengths, minlength=51), 50) == (4, 4)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 12), min_size=0, max_size=9), st.integers(1, 12))
def test_all_maximal_fillings_are_enumerated(lengths, room):
    counts = np.bincount(lengths, minlength=13)
    wanted = set()
    for mask in range(1 << len(lengths)):
        taken = [x for i, x in enumerate(lengths) if mask >> i & 1]
        rest = [x for i, x in enumerate(lengths) if not mask >> i & 1]
        if sum(taken) <= room and all(sum(taken) + x > room for x in rest):
            wanted.add(tuple(sorted(taken, reverse=True)))
    found = list(op2_packing.maximal_fillings(counts, room, lambda many=1: True))
    assert set(found) == wanted and len(found) == len(wanted)
    kept = set(op2_packing.fillings(counts, room, lambda many=1: True))
    assert kept <= wanted and all(any(op2_packing._dominated(f, g) for g in kept) for f in wanted)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><header>Site</header><nav><ul><li><a href="/">Home</a></li></ul></nav>
<!-- ad --><div class="ad">Buy now</div><article><h1>Big &amp; small</h1><p>First <b>bold</b>
 text.<br>More<p>Second &lt;p&gt; &copy; &am</p><form><input name=q>Find</form><section id="comments"><p>I agree</p></section></article>
<aside>Also read</aside><div class="cookie-notice">We use cookies</div><footer>&copy; all</footer></body></html>"""


def test_article_only(spark):
    want = "Big & small\nFirst bold text. More\nSecond <p> © &am"
    rows = spark.createDataFrame([(1, "u", PAGE), (None, None, None), (2, "u", ""), (3, "u", "<p>only"), (4, "u", "plain  text"), (4, "u", "plain  text")], "page_id long, url string, html string")
    out = sorted(op1_html.extract_main_text(rows).collect(), key=repr)
    assert sorted((r.page_id or 0, r.text) for r in out) == [(0, ""), (1, want), (2, ""), (3, "only"), (4, "plain text"), (4, "plain text")]
    assert all(r.n_chars == len(r.text) for r in out)


def test_page_without_article():
    body = "<div id=menu><a>x</a></div><div><p>" + "</p><p>".join(["A long enough paragraph of the text."] * 4) + "</p></div><div class=footer>f</div>"
    assert op1_html.main_text(body) == "\n".join(["A long enough paragraph of the text."] * 4)


def test_registered_pages_have_their_article(spark, sf):
    for r in op1_html.query(spark, sf).collect():
        assert r.text and "track(" not in r.text and "©" not in r.text.splitlines()[0]


def test_warc_round_trip(spark):
    odd = "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\né\0" * 3
    rows = [(5, "u\r\nX: y", odd), (2, "v", odd), (1, None, "one"), (3, "w", None), (4, "w", ""), (None, "n", "null id"), (8, "z", "x" * 300_000), (8, "z", "x" * 300_000)]
    path = scratch_path(spark, "t")
    op3_warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), path)
    got = sorted(((r.page_id or 0, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in op3_warc.read_archives(spark, path).collect()), key=repr)
    digest = lambda s: base64.b32encode(hashlib.sha1((s or "").encode()).digest()).decode()
    link = {5: 2, 4: 3}
    want = sorted((((i or 0), len((s or "").encode()), digest(s), "revisit" if i in link else "response", link.get(i)) for i, _, s in rows), key=repr)
    assert got == want


def test_warc_headers(spark):
    rows = [(1, "u1", "same"), (2, "u2", "same"), (2, "u3", "other"), (3, None, "same")]
    path = scratch_path(spark, "t")
    op3_warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), path, date="2030-05-06T07:08:09Z")
    found = [f for r in spark.read.format("binaryFile").load(path).collect() for f, _ in op3_warc.records([bytes(r.content)])]
    names = {f["WARC-Record-ID"] for f in found}
    assert len(names) == 4 and all(re.fullmatch(r"<urn:uuid:[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}>", n) for n in names)
    assert {f["WARC-Date"] for f in found} == {"2030-05-06T07:08:09Z"}
    first = next(f for f in found if f["X-Page-Id"] == "1")
    again = [f for f in found if f["WARC-Type"] == "revisit"]
    assert {f["X-Page-Id"] for f in again} == {"2", "3"} and all(f["WARC-Refers-To"] == first["WARC-Record-ID"] and f["WARC-Refers-To-Target-URI"] == "u1" and f["WARC-Refers-To-Date"] == first["WARC-Date"] for f in again)


def test_warc_ids_are_fresh(spark):
    """Repeated rows, rows without a page_id, and a second writing have ids of their own; the response is an HTTP message."""
    rows = spark.createDataFrame([(1, "u", "same", 0), (1, "u", "same", 0), (2, "v", "same", 1), (None, "n", "x", 2), (None, "n", "x", 2), (4, "w", "two", 3), (5, "w", "two", 3)], "page_id long, url string, html string, digest int")
    names, found = set(), []
    for _ in range(2):
        op3_warc.write_archives(rows, path := scratch_path(spark, "t"))
        now = [(f, b) for r in spark.read.format("binaryFile").load(path).collect() for f, b in op3_warc.records([bytes(r.content)])]
        names |= {f["WARC-Record-ID"] for f, _ in now}
        found += now
    assert len(names) == 14
    assert all("WARC-Refers-To" not in f for f, _ in found if f.get("X-Page-Id") == "2")  # its response comes twice
    assert all(f["WARC-Refers-To"] in names for f, _ in found if f.get("X-Page-Id") == "5")
    assert all(b.startswith(b"HTTP/1.1 200 OK\r\n") and b.endswith(b"\r\n\r\ntwo") for f, b in found if f.get("X-Page-Id") == "4")


def test_warc_files_are_bounded_by_bytes(spark):
    rows = [(i, "u", f"{i}" + "x" * n) for i, n in enumerate([10] * 40 + [5_000] * 6 + [30_000])]
    path = scratch_path(spark, "t")
    op3_warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), path, most_records=20, most_bytes=20_000)
    files = [[int(f["X-Payload-Length"]) for f, _ in op3_warc.records([bytes(r.content)])] for r in spark.read.format("binaryFile").load(path).collect()]
    assert all(len(f) <= 20 and (sum(f) <= 20_000 or len(f) == 1) for f in files if f)
    assert sorted((r.page_id, r.payload_bytes) for r in op3_warc.read_archives(spark, path).collect()) == [(i, len(t)) for i, _, t in rows]


def test_warc_of_nothing(spark):
    path = scratch_path(spark, "t")
    op3_warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert op3_warc.read_archives(spark, path).count() == 0


def test_warc_equals_sql(compare):
    compare("op3_warc_revisits")
