"""Collocations against brute force and SQL; filters and their permutation round trip."""

import random
import re
from collections import Counter

import numpy as np

from scriptorium.llm import op12_collocations as O
from scriptorium.llm import quotient as Q

SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, longest=5, first=2000):
    """rows: (lang, text)."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(SMALL)):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            f.update((lang, tuple(words[i : i + k])) for k in range(1, longest + 1) for i in range(len(words) - k + 1))
    found = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    out = []
    for (lang, p), a in found.items():
        inside = any(o[0] == lang and len(o[1]) > len(p) and b >= a and any(o[1][i : i + len(p)] == p for i in range(len(o[1]))) for o, b in found.items())
        if not inside:
            cuts = [(1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            out.append((lang, " ".join(p), a, f[lang, p[:k]], f[lang, p[k:]], n[lang], score))
    ranked = []
    for lang in {o[0] for o in out}:
        mine = sorted((o for o in out if o[0] == lang), key=lambda o: (-o[6], -o[2], o[1].encode()))[:first]
        ranked += [(lang, i + 1, *o[1:]) for i, o in enumerate(mine)]
    return sorted(ranked)


def found(spark, rows, **options):
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, lang string, text string").selectExpr("*", "1 AS n", "2 AS rank", "'x' AS word", "3 AS ids")
    return sorted(tuple(r) for r in O.collocations(frame, **options).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def texts(seed, many=120):
    rng = random.Random(seed)
    words = ["a", "The", "ünder", "Über", "b c", "x-y", "日本", "q", "zz'", "İ"]
    marks = [" ", "  ", "\t", ". ", ",", "\n", " \r", "! ", "\x0b"]
    rows = []
    for i in range(many):
        text = "".join(rng.choice(words[: rng.randint(2, 10)]) + rng.choices(marks, [20, 2, 2, 1, 1, 1, 1, 1, 1])[0] for _ in range(rng.randint(0, 60)))
        rows.append((rng.choice(["en", "en", "en", "de", None, "und"]), text))
    return rows + rows[:20] + [("en", None), ("en", ""), ("fr", "only . marks"), ("en", "one two three four five six " * 12)]


def test_registered_query(compare):
    compare("op12_collocations")


def test_against_brute_force(spark):
    rows = texts(1)
    wanted = brute(rows, 8)
    assert len(wanted) > 100 and found(spark, rows, least=8) == wanted
    # ranks end where they should, ties by the phrase's bytes
    assert found(spark, rows, least=8, first=7) == brute(rows, 8, first=7)


def test_rare_words_by_join_and_a_full_bitmap(spark):
    """Words beyond the held table meet texts by shuffle; a bitmap too small to tell anything changes no count."""
    rows = texts(2)
    assert found(spark, rows, least=6, most=3, bitmap_bits=6) == brute(rows, 6)


def test_empty_tables_and_words_without_phrases(spark):
    assert found(spark, [("en", "a b")], least=2) == []
    assert found(spark, [("en", "a. a. a")], least=2) == []
    assert O.collocations(spark.createDataFrame([], "lang string, text string")).collect() == []


def test_very_long_texts_are_cut_between_words(monkeypatch):
    monkeypatch.setattr(O, "SLICE", 50)
    text = "Aa bb. cc\tdd " * 40 + "x" * 300 + " y"
    assert [w for part in O.tokens(text) for w in part] == next(iter([(text.lower().replace(".", " . ")).encode().split()]))
    assert len(list(O.tokens(text))) > 5 and list(O.tokens(None)) == []


def test_products_beyond_64_bits(spark):
    """Whole division of decimals is exact where 1000 a n and l r leave 64 bits."""
    a, n, left, right = 9_000_000_000_001, 17_000_000_000_003, 9_500_000_000_007, 9_100_000_000_009
    got = spark.sql(f"SELECT (CAST(1000 AS decimal(4, 0)) * CAST({n} AS decimal(18, 0)) * CAST({a} AS decimal(19, 0))) div CAST(CAST({left} AS decimal(19, 0)) * CAST({right} AS decimal(19, 0)) AS decimal(38, 0)) AS s").first()["s"]
    assert got == 1000 * a * n // (left * right)


def test_filters_keep_every_count():
    rng = np.random.default_rng(1)
    for n, bits, shard_bits in ((2, 3, 2), (2, 14, 4), (5, 14, 5), (5, 33, 6), (3, 1, 3), (4, 64, 3), (5, 12, 0)):
        ids = [rng.integers(0, min(1 << bits, 40), 3000) for _ in range(n)]
        widths = Q.layout(n, bits)
        counter, filters = Q.Counter(widths, min(shard_bits, widths[0]), most=700), []
        for at in range(0, 3000, 190):
            filters += counter.add(Q.pack([i[at : at + 190] for i in ids], bits))
        filters += counter.flush()
        got = {}
        for shard in {s for s, _ in filters}:
            columns, counts = Q.merged([f for s, f in filters if s == shard], widths, min(shard_bits, widths[0]))
            rows = [tuple(r) for r in Q.unpack(Q.restore(columns, widths[0]), n, bits).tolist()]
            assert not set(rows) & set(got)
            got.update(zip(rows, counts.tolist(), strict=True))
        assert got == Counter(zip(*(i.tolist() for i in ids), strict=True))


def test_filters_hold_large_counts_and_are_compact():
    columns, widths = [np.sort(np.random.default_rng(2).choice(1 << 30, 20_000, replace=False)).astype(np.uint64)], [30]
    counts = np.full(20_000, 3)
    counts[:5] = (254, 255, 256, 70_000, 1 << 40)
    data = Q.dump(columns, counts, widths, 0)
    back, same = Q.load(data, widths, 0)
    assert (back[0] == columns[0]).all() and (same == counts).all()
    assert len(data) < 4 * 20_000  # a plain pair of 64-bit numbers takes 16 bytes
    with_twice, twice = Q.merged([data, data], widths, 0)
    assert (with_twice[0] == columns[0]).all() and (twice == 2 * counts).all()
