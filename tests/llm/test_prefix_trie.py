"""Prefix tries against brute force and SQL, with containers and suffixes small enough to burst and chain."""

import hashlib
import math
import random
import zlib

from scriptorium.llm import op11_prefix_trie as O

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    """rows: (conv_id, turn, role, text)."""
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            name = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
            own.setdefault(conv, []).append(((turn is not None, turn or 0), name, role, text))
    own = {c: [t[2:] for t in sorted(turns)] for c, turns in own.items()}
    members, ends = {}, {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        whole = own.get(c - int(math.fmod(c, 5)), [])[:h] + turns[h:]
        for d in range(len(whole) + 1):
            members.setdefault(tuple(whole[:d]), []).append(c)
        ends.setdefault(tuple(whole), []).append(c)
    children = {}
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)
    below = {}
    for p in sorted(members, key=len, reverse=True):
        inner = children.get(p, [])
        saved = (len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0
        below[p] = (sum(below[c][0] for c in inner) or 1, saved + sum(below[c][1] for c in inner))
    digest = lambda p: hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest()
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children.get(p, [])), *below[p], digest(p)) for p, m in members.items())


def found(spark, rows, **options):
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS head", "2 AS level", "3 AS size", "4 AS n")
    return sorted((tuple(r) for r in O.prefix_trie(frame, **options).select(*COLUMNS).collect()), key=lambda r: r[:2])


def conversations(seed, many=60, longest=24):
    rng = random.Random(seed)
    rows = []
    for c in range(many):
        path = rng.choice([0, 0, 0, 1, 2])
        for t in range(rng.randint(1, longest)):
            word = f"hot {t}" if path == 0 and rng.random() < 0.97 else f"é{rng.randint(0, 2)}"
            rows.append((c * rng.choice([1, 1, 3]), t, rng.choice(["user", "user", None]) if rng.random() < 0.1 else "user", word))
    return rows


def test_registered_query(compare):
    compare("op11_prefix_trie")


def test_containers_burst_and_long_conversations_chain(spark):
    rows = conversations(1)
    # copies of a long conversation, which end together, and longer ones through their ends
    rows += [(c, t, "user", f"hot {t}") for c in range(500, 620, 5) for t in range(30)]
    rows += [(c, t, "user", f"hot {t}") for c in (700, 705, 710) for t in range(33 + c % 3)]
    wanted = brute(rows)
    assert found(spark, rows) == wanted
    assert found(spark, rows, span=4, most=3) == wanted


def test_one_suffix_a_head_and_deep_conversations(spark):
    rows = [(c, t, "a", f"{t % 7}") for c in (0, 5, 10) for t in range(60 - c)]
    assert found(spark, rows, span=3, most=1) == brute(rows)


def test_odd_rows(spark):
    rows = [(0, 0, "user", "a"), (0, None, None, "first"), (0, 1, "user", None), (0, 1, "user", None), (0, 1, "bot", ""), (None, 0, "user", "gone"), (7, 0, "user", "x"), (-3, 0, "user", "x"), (-10, 0, "user", "é" * 3), (-12, 3, "", ""), (11, 0, "user", "long " * 20_000)]
    wanted = brute(rows)
    assert found(spark, rows) == wanted and wanted[-1][0] is not None
    assert O.prefix_trie(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []
    # turns before the h-th of a conversation whose base is absent fall away
    turnless = next(c for c in range(1, 99) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 1)
    assert found(spark, [(turnless, 0, "user", "x")]) == [(turnless, 0, None, 1, 0, 1, 0, hashlib.sha256(str(turnless).encode()).hexdigest())]
