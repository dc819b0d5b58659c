"""Near-duplicate groups by circulant MinHash, banding and exact Jaccard verification.

All signature coordinates come from two permutations: the first scatters the shingles
over a circle, the second, shifted by one place for each coordinate, orders them.

Links are verified on full sets. Buckets are never turned into all their pairs: first
each member is held against the centre of one of its buckets, which settles groups of
copies; what then still lies in different components is compared within blocks of
bounded size. A text travels once for each of these, whatever the number of its buckets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm.common import small, small_batches, table, text_key, text_slices, unused, written
from scriptorium.llm.graph import components
from scriptorium.llm.shingles import in_both, mix, shingle_lists

_CIRCLE = 1 << 20
#: Members of a bucket, or of a centre, that one task compares at a time.
BLOCK = 256

_orders: dict[int, np.ndarray] = {}


def _shifted(coordinates: int) -> np.ndarray:
    """Row p: places p to p + coordinates - 1 of the second permutation, around the circle."""
    if coordinates not in _orders:
        order = np.argsort(mix(np.arange(_CIRCLE, dtype=np.uint64), 11)).astype(np.uint32)
        _orders[coordinates] = np.lib.stride_tricks.sliding_window_view(np.concatenate((order, order[: coordinates - 1])), coordinates)
    return _orders[coordinates]


def signature(shingles: np.ndarray, coordinates: int) -> np.ndarray:
    """Circulant MinHash of a non-empty set: coordinate k is the least of the order shifted by k.

    Coordinates keep their low 16 bits, which is where minima differ.
    """
    places = np.unique(mix(shingles, 5) >> np.uint64(44)).astype(np.int64)
    rows = _shifted(coordinates)
    return np.minimum.reduce([rows[places[i : i + 4096]].min(axis=0) for i in range(0, len(places), 4096)]).astype(np.uint16)


def band_keys(sig: np.ndarray, bands: int) -> np.ndarray:
    """A 64-bit key for each band; keys of different bands differ."""
    rows = sig.reshape(bands, -1).astype(np.uint64)
    key = mix(np.arange(bands, dtype=np.uint64), 3)
    for k in range(rows.shape[1]):
        key = mix(key + rows[:, k] * np.uint64(0x9E3779B97F4A7C15), 9)
    return key


def _set_name(s: np.ndarray) -> bytes:
    """A name of a set: two independent 64-bit sums over it."""
    return np.array([mix(s, 21).sum(dtype=np.uint64), mix(s, 22).sum(dtype=np.uint64)], dtype=">u8").tobytes()


def signatures(docs: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """doc_id, h (hash of the text), set_name (null without words), n_shingles and sketch (the signature)."""

    def run(batches):
        for batch in batches:
            for some in text_slices(batch):
                sets = shingle_lists(some.column("text").to_pylist(), width)
                sketches = [signature(s, bands * rows).tobytes() if len(s) else None for s in sets]
                yield pa.record_batch(
                    [some.column("doc_id"), some.column("h"), pa.array([_set_name(s) if len(s) else None for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array(sketches, pa.binary())],
                    names=["doc_id", "h", "set_name", "n_shingles", "sketch"],
                )

    return docs.select("doc_id", text_key().alias("h"), "text").mapInArrow(run, "doc_id long, h long, set_name binary, n_shingles long, sketch binary")


def _members(nodes: DataFrame, bands: int) -> DataFrame:
    """(key, node, band): each node in each of its buckets."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                some = batch.slice(at, 1024)
                keys = [band_keys(np.frombuffer(x.as_buffer(), dtype=np.uint16), bands) for x in some.column("sketch")]
                nodes_ = np.repeat(some.column("node").to_numpy(zero_copy_only=False), bands)
                yield pa.record_batch([pa.array(np.concatenate([*keys, np.zeros(0, dtype=np.uint64)]).view(np.int64)), pa.array(nodes_), pa.array(np.tile(np.arange(bands, dtype=np.int32), some.num_rows))], names=["key", "node", "band"])

    return nodes.select("node", "sketch").mapInArrow(run, "key long, node long, band int")


def _near(inter: int, a: int, b: int, percent: int) -> bool:
    return 100 * inter >= percent * (a + b - inter)


def _texts(docs: DataFrame, wanted: DataFrame, repeated: bool, many: int) -> DataFrame:
    """(node, text) of the wanted nodes (node, rep, h), written; small requests leave all other texts where they are."""
    own = docs.select(F.col("doc_id"), text_key().alias("h"), F.col("text"))
    asked = small(written(wanted.select("node", "rep", F.col("h").alias("rep_h")), "wanted", rows=many))
    found = own.join(asked, (F.col("h") == F.col("rep_h")) & F.col("doc_id").eqNullSafe(F.col("rep"))).select("node", "text")
    return written(found.dropDuplicates(["node"]) if repeated else found, "texts", "zstd")


def _verified(pairs: DataFrame, texts: DataFrame, width: int, percent: int, many: int) -> DataFrame:
    """Links (u, v) among about ``many`` pairs (u, centre) of nodes: those whose full sets are similar enough.

    A centre's text goes once to each ``BLOCK`` of its partners, and a partner's to its centre.
    """
    counts = pairs.groupBy("centre").agg(F.count("*").alias("n"))
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    partners = pairs.join(counts, "centre").select("centre", F.pmod(F.xxhash64("u"), blocks).cast("int").alias("block"), F.col("u").alias("node"), F.lit(1).alias("role"))
    centres = counts.select("centre", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), F.col("centre").alias("node"), F.lit(0).alias("role"))
    asked = small(written(partners.unionByName(centres), "stars", rows=many))

    def run(batches):
        held, whose = None, None
        for batch in batches:
            for some in text_slices(batch):
                found: list[tuple[int, int]] = []
                sets = shingle_lists(some.column("text").to_pylist(), width)
                for centre, node, role, s in zip(some.column("centre").to_pylist(), some.column("node").to_pylist(), some.column("role").to_pylist(), sets, strict=True):
                    if not role:
                        held, whose = s, centre
                    elif centre == whose and _near(in_both(held, s), len(held), len(s), percent):
                        found.append((node, centre))
                yield pa.record_batch([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64())], names=["u", "v"])

    dealt = texts.join(asked, "node").select("centre", "block", "role", "node", "text").repartition("centre", "block").sortWithinPartitions("centre", "block", "role")
    return dealt.mapInArrow(run, "u long, v long")


def _open(buckets: DataFrame, comps: DataFrame, many: int) -> DataFrame:
    """Rows of the ``many`` of buckets whose members lie in several components, with root, main (the most frequent root) and size; written."""
    rooted = written(buckets.join(small(comps).withColumnsRenamed({"u": "node", "v": "root"}), "node", "left").withColumn("root", F.coalesce("root", "node")), "rooted", rows=many)
    by_root = rooted.groupBy("key", "root").agg(F.count("*").alias("c"))
    found = by_root.groupBy("key").agg(F.sum("c").alias("size"), F.count("*").alias("roots"), F.max(F.struct("c", "root"))["root"].alias("main")).where("roots > 1")
    return written(rooted.join(small(written(found.select("key", "size", "main"), "several", rows=many // 2)), "key"), "open", rows=many)


def _promising(dealt: DataFrame, percent: int, bands: int) -> DataFrame:
    """The rows of blocks that take part in a pair worth comparing: key, block, node, root, role.

    A pair of different roots is worth it in the first bucket that it shares, if its
    sketches agree in no less than six standard deviations below ``percent`` of their
    places. So a pair costs its texts once, however many buckets it shares.
    """

    def run(batches):
        group, held, rows, used = None, [], [], None
        matrix = tops = None

        def out(found):
            columns = list(zip(*found, strict=True)) or [()] * 5
            return pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32()), strict=True)], names=["key", "block", "node", "root", "role"])

        def flush():
            return [r for r, u in zip(rows, used, strict=True) if u] if used is not None else []

        for batch in batches:
            found = []
            for key, block, node, root, role, band, raw in zip(*(batch.column(c).to_pylist() for c in ("key", "block", "node", "root", "role", "band", "sketch")), strict=True):
                if (key, block) != group:
                    found += flush()
                    group, held, rows, used = (key, block), [], [], None
                s = np.frombuffer(raw, dtype=np.uint16)
                if not role:
                    held.append(s)
                    rows.append((key, block, node, root, role))
                    continue
                if used is None:
                    used, matrix = np.zeros(len(held), dtype=bool), np.array(held).reshape(len(held), len(s))
                    tops = np.array([r[3] for r in rows], dtype=np.int64)
                same = matrix == s
                good = (same.mean(axis=1) >= percent / 100 - 6 * np.sqrt(percent * (100 - percent) / len(s)) / 100) & (tops != root)
                good &= same.reshape(len(held), bands, -1).all(axis=2).argmax(axis=1) == band
                if good.any():
                    used |= good
                    found.append((key, block, node, root, role))
            yield out(found)
        yield out(flush())

    return dealt.mapInArrow(run, "key long, block int, node long, root long, role int")


def _within_blocks(rows: DataFrame, nodes: DataFrame, texts: DataFrame, width: int, percent: int, bands: int, many: int) -> DataFrame:
    """Links between components, by exact comparison inside buckets.

    Members outside their bucket's main component (probes) meet all its members, block by
    block, first by sketch and then, where that leaves something, by set. A task holds one
    block and one probe; roots it has joined already are not compared again, and it
    returns a spanning forest of links, not pairs.
    """
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    targets = rows.select("key", F.pmod(F.xxhash64("node"), blocks).cast("int").alias("block"), "node", "root", "band", F.lit(0).alias("role"))
    probes = rows.where(F.col("root") != F.col("main")).select("key", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), "node", "root", "band", F.lit(1).alias("role"))
    dealt = targets.unionByName(probes).join(nodes.select("node", "sketch"), "node").repartition("key", "block").sortWithinPartitions("key", "block", "role")
    asked = small(written(_promising(dealt, percent, bands), "promising", rows=many))

    def run(batches):
        group, roots, held, index = None, [], [], None
        joined: dict[int, int] = {}

        def top(x: int) -> int:
            while joined.get(x, x) != x:
                x = joined[x]
            return x

        def places(s: np.ndarray) -> list[int]:
            """Of a full block, by an index of all its shingles; of a short one, set by set where roots still differ."""
            nonlocal index
            if len(held) <= 8:
                return [i for i, x in enumerate(held) if top(roots[i]) != top(root) and 100 * min(len(x), len(s)) >= percent * max(len(x), len(s)) and _near(in_both(x, s), len(x), len(s), percent)]
            if index is None:
                whole, owner = np.concatenate(held), np.repeat(np.arange(len(held), dtype=np.int32), [len(x) for x in held])
                order = np.argsort(whole, kind="stable")
                index = whole[order], owner[order], np.array([len(x) for x in held])
            lo, hi = np.searchsorted(index[0], s, "left"), np.searchsorted(index[0], s, "right")
            n = hi - lo
            at = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
            inter = np.bincount(index[1][at], minlength=len(held))
            return np.flatnonzero(100 * inter >= percent * (index[2] + len(s) - inter)).tolist()

        for batch in batches:
            for some in text_slices(batch):
                found: list[tuple[int, int]] = []
                sets = shingle_lists(some.column("text").to_pylist(), width)
                for key, block, root, role, s in zip(*(some.column(c).to_pylist() for c in ("key", "block", "root", "role")), sets, strict=True):
                    if (key, block) != group:
                        group, roots, held, index = (key, block), [], [], None
                        joined.clear()
                    if not role:
                        roots.append(root)
                        held.append(s)
                        continue
                    for i in places(s):
                        if (a := top(roots[i])) != (b := top(root)):
                            joined[max(a, b)] = min(a, b)
                            found.append((root, roots[i]))
                yield pa.record_batch([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64())], names=["u", "v"])

    dealt = texts.join(asked, "node").select("key", "block", "role", "root", "text").repartition("key", "block").sortWithinPartitions("key", "block", "role")
    return dealt.mapInArrow(run, "u long, v long")


def _settled(docs: DataFrame, width: int, percent: int, bands: int, rows: int, star_rounds: int) -> DataFrame:
    """doc_id, h, n_shingles, component_id and stays ((doc_id, h) of the component's row that stays) for every row; written."""
    small_batches(docs.sparkSession)
    sigs = written(signatures(docs, width, bands, rows), "signatures")
    repeated = not sigs.groupBy("doc_id", "h").agg(F.count("*").alias("c")).where("c > 1").isEmpty()
    # nulls come last: a set's first document has an id where any has
    order = lambda: F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("rep"), F.col("h").alias("h"))
    sets = sigs.where("n_shingles > 0").groupBy("set_name").agg(F.min(order()).alias("first"), F.count("*").alias("copies"), F.first("sketch").alias("sketch"))
    nodes = written(sets.select(F.monotonically_increasing_id().alias("node"), "set_name", "first", "copies", "sketch"), "nodes")

    members = _members(nodes, bands)
    shared = written(members.groupBy("key").agg(F.count("*").alias("c"), F.min("node").alias("centre")).where("c > 1"), "shared")
    buckets = written(members.join(small(shared), "key"), "buckets")
    many = buckets.count()
    wanted = buckets.select("node").distinct().join(nodes.select("node", "first.rep", "first.h"), "node")
    texts = _texts(docs, wanted, repeated, many)
    buckets_of = buckets.select("key", "band", "node", "c")

    def linked(pairs: DataFrame) -> DataFrame:
        """Verified links of each row's node and the centre of the largest of its buckets there."""
        widest = pairs.where("node != centre").groupBy(F.col("node").alias("u")).agg(F.max(F.struct("c", "key", "centre"))["centre"].alias("centre"))
        return _verified(written(widest, "pairs", rows=many), texts, width, percent, many)

    links = written(linked(buckets), "links", rows=many)
    comps = components(links, many)
    opened = _open(buckets_of, comps, many)
    for turn in range(1, star_rounds):
        # large buckets only: a few more centres leave little for the blocks
        large = opened.where(F.col("c") > BLOCK)
        if large.isEmpty():
            break
        mine = F.col("root") == F.col("main")
        centres = large.where(mine).groupBy("key").agg(F.min(F.struct(F.xxhash64("node", F.lit(turn)), "node"))["node"].alias("centre"))
        links = written(links.unionByName(linked(large.where(~mine).join(small(written(centres, "centres", rows=many)), "key"))), "links", rows=many)
        comps = components(links, many)
        opened = _open(buckets_of, comps, many)
    last = written(_within_blocks(opened, nodes, texts, width, percent, bands, many), "links", rows=many)
    if not last.isEmpty():
        comps = components(comps.unionByName(last), many)

    # only sets of several documents, or linked ones, need a name other than their document's own
    rooted = nodes.join(small(comps).withColumnsRenamed({"u": "node", "v": "root"}), "node", "left").select("set_name", "copies", "first", F.coalesce("root", "node").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("least"), F.sum("copies").alias("n")).where("n > 1")
    named = written(rooted.join(small(written(least, "least", rows=many)), "root").select("set_name", "least"), "named")
    joined = sigs.select("doc_id", "h", "set_name", "n_shingles").join(small(named), "set_name", "left")
    return joined.select("doc_id", "h", "n_shingles", F.when(F.col("least").isNull(), F.col("doc_id")).otherwise(F.col("least.rep")).alias("component_id"), F.when(F.col("least").isNotNull(), F.struct("least.rep", "least.h")).alias("stays"))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, bands: int = 32, rows: int = 4, star_rounds: int = 3) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``docs`` (doc_id, text).

    Two documents are linked when 100 * intersection >= ``percent`` * union of their sets
    of ``width``-word shingles; component_id is the smallest doc_id of the component.
    A pair just at ``percent`` = 80 shares none of 32 bands of 4 coordinates with
    probability 5e-8, at 85 with 5e-11.

    Documents with equal sets are one node from the start, so copies cost a count each.
    Null and empty texts and texts without words have no shingles, are linked with
    nothing and kept. Null doc_ids take part; a component of null doc_ids alone has a
    null component_id, and kept is false there unless it is a row by itself; rows that
    repeat a doc_id get a row each. No rows give no rows; other columns are ignored.
    """
    found = _settled(docs, width, percent, bands, rows, star_rounds)
    kept = F.when(F.col("stays").isNull(), F.lit(True)).otherwise(F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
    return found.select("doc_id", "n_shingles", "component_id", kept.alias("kept"))


def drop_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, bands: int = 32, rows: int = 4, star_rounds: int = 3) -> DataFrame:
    """``docs`` with one row of each near-duplicate group, with all its columns.

    The row that stays has the smallest doc_id, nulls last (of rows that repeat it, one
    of the least hash of the text). Rows in no group stay, among them all without words:
    null, empty and blank texts. Columns may have any names; no rows give no rows.
    """
    found = written(_settled(docs, width, percent, bands, rows, star_rounds).where("stays IS NOT NULL"), "grouped")
    own = F.col("doc_id").eqNullSafe(F.col("stays.rep")) & (F.col("h") == F.col("stays.h"))
    i, h = unused(docs, "doc_key"), unused(docs, "text_key")
    gone = written(found.where(~own).select(F.col("doc_id").alias(i), F.col("h").alias(h)).distinct(), "gone")
    twice = written(found.where(own).groupBy(F.col("doc_id").alias(i), F.col("h").alias(h)).agg(F.count("*").alias("c")).where("c > 1").drop("c"), "twice")
    same = F.col("doc_id").eqNullSafe(F.col(i)) & (text_key() == F.col(h))
    left = docs.join(small(gone), same, "left_anti")
    if twice.isEmpty():
        return left
    once = left.join(small(twice), same).dropDuplicates([i, h]).select(*docs.columns)
    return left.join(small(twice), same, "left_anti").unionByName(once)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


ORACLE_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x09-\\x0D\\x20]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) END AS sh
  FROM w),
e AS MATERIALIZED (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c
  FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY 1, 2),
l AS MATERIALIZED (SELECT a, b FROM i WHERE 100 * c >= 85 * (na + nb - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT s.doc_id, len(s.sh)::BIGINT AS n_shingles, min(r.b) AS component_id, s.doc_id = min(r.b) AS kept
FROM s JOIN r ON r.a = s.doc_id GROUP BY s.doc_id, len(s.sh)
"""
