"""Near duplicates, decontamination, personal data and top-k search."""

import hashlib
import random
import re

import numpy as np
import pytest

from scriptorium.llm import op6_pii, op7_mtree, op8_minhash, op10_decontaminate
from scriptorium.llm.common import table
from scriptorium.llm.graph import components
from scriptorium.llm.shingles import shingle_lists, word_hashes

WORDS = [f"w{i}" for i in range(4000)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, node string, key int")


def sets(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if len(words) >= width else ({tuple(words)} if words else set())


def brute_groups(rows, width, percent):
    s = {i: sets(t, width) for i, t in rows}
    root = {i: i for i in s}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in s:
        for b in s:
            if a < b and s[a] and s[b]:
                n = len(s[a] & s[b])
                if 100 * n >= percent * (len(s[a]) + len(s[b]) - n) and top(a) != top(b):
                    root[max(top(a), top(b))] = min(top(a), top(b))
    return {i: (len(s[i]), top(i)) for i in s}


def test_word_hashes_tell_words_apart():
    texts = ["The the THE  thE\tq", None, "", "É é", "a\x0bb\x1cc"]
    hashes, starts = word_hashes(texts)
    assert np.diff(starts).tolist() == [5, 0, 0, 2, 2] and len(set(hashes[:4].tolist())) == 1 and len(set(hashes.tolist())) == 6
    many, _ = word_hashes([" ".join(WORDS)])
    assert len(set(many.tolist())) == len(WORDS)
    assert [len(x) for x in shingle_lists(["a b c d", "a b", "", None], 3)] == [2, 1, 0, 0]


@pytest.mark.parametrize(("width", "percent", "block"), [(3, 85, 256), (5, 80, 8)])
def test_groups_against_brute_force(spark, monkeypatch, width, percent, block):
    monkeypatch.setattr(op8_minhash, "BLOCK", block)
    rnd = random.Random(5)
    rows = [(0, None), (1, ""), (2, " \n"), (3, "two words"), (4, "Two WORDS"), (5, "one")]
    for _ in range(6):
        base = [rnd.choice(WORDS) for _ in range(rnd.choice((30, 120)))]
        for _ in range(25):
            copy = list(base)
            for _ in range(rnd.randrange(0, 6)):
                copy[rnd.randrange(len(copy))] = rnd.choice(WORDS)
            if rnd.random() < 0.3:
                base = copy  # chains
            rows.append((len(rows), " ".join(copy)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in op8_minhash.near_duplicates(frame(spark, rows), width, percent).collect()}
    assert got == brute_groups(rows, width, percent)


def test_groups_with_odd_ids(spark):
    text = " ".join(WORDS[:50])
    rows = op8_minhash.near_duplicates(frame(spark, [(None, text), (4, text), (4, text), (None, ""), (9, text + " z")])).collect()
    assert sorted(((str(r.doc_id), r.component_id, r.kept) for r in rows), key=repr) == sorted([("4", 4, True), ("4", 4, True), ("9", 4, False), ("None", None, True), ("None", 4, False)], key=repr)
    assert op8_minhash.near_duplicates(frame(spark, [])).count() == 0


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 99), (5, 5), (200, 100)]
    out = {r.u: r.v for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert out == {i: 0 for i in range(1, 41)} | {100: 99, 200: 99}


@pytest.mark.parametrize("name", ["op7_mtree_topk", "op8_minhash_dedup", "op10_decontamination"])
def test_equals_sql(compare, name):
    compare(name)


def test_containment(spark):
    item = WORDS[:50]
    rows = [
        (1, " ".join(WORDS[500:900] + item + WORDS[900:2000])), (2, " ".join(WORDS[500:900] + item[:30] + WORDS[900:2000])), (3, None), (4, ""), (5, "W1, w2"), (6, "x " * 3000),
        (7, " ".join(item[:44]).upper()), (None, ". ".join(item)), (1, "again"),
    ]
    items = spark.createDataFrame([(10, " ".join(item)), (11, "w1 w2"), (12, None), (13, ""), (10, " ".join(item)), (None, "w1 w2")], "item_id long, text string")
    out = op10_decontaminate.contained_items(frame(spark, rows), items).collect()
    assert sorted((str(r.doc_id), r.item_id, r.n_shared) for r in out) == [("1", 10, 46), ("1", 11, 1), ("2", 11, 1), ("5", 11, 1), ("7", 10, 40), ("7", 11, 1), ("None", 10, 46), ("None", 11, 1)]
    assert op10_decontaminate.contained_items(frame(spark, []), items).count() == 0
    # each row by its own text: the clean row that repeats doc_id 1 stays
    left = op10_decontaminate.drop_contaminated(frame(spark, rows), items).collect()
    assert sorted((r.doc_id, r.text or "") for r in left) == sorted((i, t or "") for i, t in (rows[2], rows[3], rows[5], rows[8]))
    assert op10_decontaminate.contained_items(frame(spark, rows), items.where("item_id < 0")).count() == 0


PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def brute_spans(text):
    out = []
    for k, p in enumerate(PATTERNS):
        for m in re.finditer(p, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            total = sum(v if i % 2 == 0 else 2 * v - 9 * (v > 4) for i, v in enumerate(map(int, reversed(digits)))) if k == 2 else 0
            if k == 0 or k == 1 and all(int(x) <= 255 for x in m[0].split(".")) or k == 2 and 14 <= len(digits) <= 19 and total % 10 == 0 or k == 3 and 10 <= len(digits) <= 15:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans_against_brute_force(spark, sf):
    rnd = random.Random(2)
    bits = ["a.b", "@", "x@y.z", ".", "..", "-", " ", "  ", "1.2.3.4", "256.1.1.1", "0001.2.3.255", "10.0.0.0", "00.1.02.300", "4111 1111-1111 1111", "41111111111111111111", "+1 (234) 555-6789", "+", "(", ")", "\x01", "\x02", "é", "😀", "12", "x@b", "a@b@c.d", "\n", "_", "%"]
    rows = [(i, "".join(rnd.choice(bits) for _ in range(rnd.randrange(1, 14)))) for i in range(400)]
    rows += [(1000, None), (1001, ""), (1002, "9" * 60_000), (1003, "a" * 30_000), (1004, "1 " * 30_000), (1005, "a." * 20_000), (1006, "x@" + "a." * 20_000 + "c")]
    rows += [(2000 + r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    got = {r.doc_id: [(s.start, s.kind, s.end) for s in r.base] for r in op6_pii.find_spans(frame(spark, rows)).collect()}
    for i, text in rows:
        assert got[i] == brute_spans(text), (i, text and text[:100])


def test_more_spans_are_found_and_redacted(spark):
    rnd = random.Random(3)
    rows = []
    for i in range(600):
        name = "".join(rnd.choice("abcdefgh") for _ in range(6))
        rows.append((i, f"mail {name}@host{i % 7}.org or call +1 (2{i % 90 + 10}) 555-{i % 9000 + 1000} at 10.0.{i % 250}.7 code {i} {i * 7 % 1000}"))
    rows += [(900, "write to jane(at)host3.org now"), (901, None), (902, ""), (902, "")]
    out = {r.doc_id: r for r in op6_pii.find_spans(frame(spark, rows), precision=0.9).collect()}
    assert all(set(map(tuple, r.base)) <= set(map(tuple, r.spans)) for r in out.values())
    clean = op6_pii.redact(frame(spark, rows))
    assert clean.columns == ["doc_id", "text", "node", "key"] and clean.count() == len(rows)
    texts = {r.doc_id: r.text for r in clean.collect()}
    assert texts[0].startswith("mail [EMAIL] or call [PHONE] at [IP] code") and texts[901] is None and texts[902] == ""
    assert op6_pii.find_spans(frame(spark, [])).count() == 0


def brute_top(rows, every, k):
    ok = {i: np.floor(1024 * np.asarray(v, dtype=np.float32).astype(float)) for i, v in rows if v is not None and None not in v and np.isfinite(np.asarray(v, dtype=float)).all()}
    out = []
    for q in sorted(ok):
        if q % every == 0:
            best = sorted((-int(ok[q] @ ok[i]), i) for i in ok if i != q)[:k]
            out += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    return out


@pytest.mark.parametrize("part_rows", [4096, 40])
def test_top_k_against_brute_force(spark, part_rows):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(5, 8))
    rows = [(i, [float(x) for x in (centres[i % 5] * (1 + i % 3) + rng.normal(size=8) * 0.1).astype(np.float32)]) for i in range(700)]
    rows += [(700 + i, rows[3][1]) for i in range(40)] + [(800, None), (801, [None] * 8), (802, [float("nan")] * 8), (803, [float("inf")] * 8), (900, [0.0] * 8)]
    table_ = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, subtree string")
    got = sorted(tuple(r) for r in op7_mtree.top_k(table_, 100, 10, part_rows=part_rows, query_block=3).collect())
    assert got == brute_top(rows, 100, 10)
    assert op7_mtree.top_k(table_.where("vec_id < 3"), 1, 10).count() == 6
    assert op7_mtree.top_k(table_.where("vec_id < 0")).count() == 0


def test_stored_distances_save_computations():
    """On clustered vectors the search passes entries over by their stored distances, and still finds what a scan finds."""
    import pandas as pd

    rng = np.random.default_rng(7)
    x = np.unique((rng.normal(size=(12, 8)) * 900)[rng.integers(0, 12, 3000)].astype(np.int64) + rng.integers(-30, 30, (3000, 8)), axis=0)
    most = float((x.astype(float) ** 2).sum(axis=1).max())
    lifted = op7_mtree._lifted(x, most)
    pages = op7_mtree.build_pages(x, lifted, lifted[0])
    rows = [(p["leaf"], len(p["objects"]), p["objects"].tobytes(), p["parent_distance"].tobytes(), p["radius"].tobytes(), p["child"].tobytes(), np.asarray(p["rows"] if p["leaf"] else [], dtype=np.int64).tobytes(), np.ones(len(p["rows"]) if p["leaf"] else 0, dtype=np.int32).tobytes(), p["page"]) for p in pages]
    tree = op7_mtree.Tree(pd.DataFrame(rows, columns=["leaf", "n", "objects", "parent_distance", "radius", "child", "ids", "id_counts", "page"]), 8)
    for i in range(0, len(x), 150):
        want = sorted((-int(x[i] @ x[j]), j) for j in range(len(x)) if j != i)[:10]
        got = tree.search(x[i], i, 10, most, float(np.linalg.norm(np.append(x[i].astype(float), 0.0) - lifted[0])), None)
        assert sorted((-p, j) for p, j in got) == want
    assert tree.avoided > 500 and 5 * tree.computed < len(range(0, len(x), 150)) * len(x)


def test_long_vectors(spark):
    far = [(i, [3e4 * (i % 7 - 3), 2e4 + i, float(i)]) for i in range(300)]
    frame_ = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in op7_mtree.top_k(frame_([(i, [x * 10 for x in v]) for i, v in far]), 100, 3).collect())
    whole = {i: [int(np.floor(1024 * (x * 10))) for x in v] for i, v in far}
    want = [(q, r, i, -s) for q in (0, 100, 200) for r, (s, i) in enumerate(sorted((-sum(a * b for a, b in zip(whole[q], whole[i], strict=True)), i) for i in whole if i != q)[:3], 1)]
    assert got == want
    for big in (1e30, 1e8):
        with pytest.raises(ValueError, match="64 bits"):
            op7_mtree.top_k(frame_([(0, [big, 1.0]), (1, [1.0, 1.0])]))


def test_registered_spans(spark, sf):
    texts = {r.doc_id: r.text for r in table(spark, sf, "documents").collect()}
    rows = op6_pii.query(spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        base = [f"{op6_pii.KINDS[k]}:{a}:{b}" for a, k, b in brute_spans(texts[r.doc_id])]
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(b.startswith(k + ":") for b in base) for k in op6_pii.KINDS]
        assert set(base) <= set(r.spans.split(",")) | {""}


def test_short_items_inside_long_documents(spark):
    """Items of one to four words are found as runs of their own length, at every place of a text."""
    import re

    from scriptorium.llm import op10_decontaminate as D

    texts = ["so alpha beta gamma delta epsilon", "Alpha, beta; GAMMA", "gamma alpha beta", "one two three four five six seven", "nothing here at all to see", "beta", "", None, "x " * 3000 + "alpha beta gamma"]
    items = {1: "alpha beta gamma", 2: "beta", 3: "four five six seven", 4: "one two three four five six", 5: "", 6: "six seven eight"}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = sorted((r["doc_id"], r["item_id"]) for r in D.contained_items(docs, spark.createDataFrame(list(items.items()), "item_id long, text string")).collect())
    cut = lambda t: re.findall(r"\w+", (t or "").lower())
    runs = lambda w, k: {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
    wanted = []
    for d, text in enumerate(texts):
        for i, item in items.items():
            w = cut(item)
            own = runs(w, min(5, len(w))) if w else set()
            if own and 100 * len(own & runs(cut(text), min(5, len(w)))) >= 80 * len(own):
                wanted.append((d, i))
    assert found == sorted(wanted) and len(wanted) == 10
    kept = [r["doc_id"] for r in D.drop_contaminated(docs, spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")).collect()]
    assert sorted(kept) == [2, 3, 4, 5, 6, 7]
