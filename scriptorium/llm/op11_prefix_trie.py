"""Prefix tries of conversations, built as burst tries.

A turn's id is a hash of role and text. Rebuilt conversations are cut into suffixes of at
most ``SPAN`` turns, each under the trie head that its earlier turns lead to, so that a
conversation of any length is many rows. Equal suffixes of a head become one row. A head's
suffixes are its container; one with too many rows bursts: the turns that all of them
share become a run of trie nodes, and the next turn id deals the rest to new containers.
Containers are then spread over shards by their heads, sorted by suffix, and swept in
order into nodes; the runs above them are summed up from the containers below.

What lies below a suffix's end (the container of the longer conversations that lead
through it) comes from sums by conversation: each container's own leaves and savings are
credited to its smallest member and added up along that conversation, so a deep trie
takes no more rounds than a shallow one.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptorium.llm.common import small, table, written

#: Turns of a suffix at most.
SPAN = 512
#: Suffixes of a container at most.
CONTAINER = 2048
#: Turns that other conversations of a group of five can take from its first.
_SHARED = 8
_ROOT = hashlib.sha256(b"").hexdigest()


def turn_ids(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, tid, size): a 128-bit id of role and text, and the text's bytes; null conv_ids are left out."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    named = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    return rows.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.unhex(F.substring(named, 1, 32)).alias("tid"), F.octet_length(text).cast("long").alias("size"))


def positions(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, part, own, tid, size) in written ranges, and (conv_id, part, start, many, all).

    Turns are dealt to ranges of (conv_id, turn); ``own`` counts from 0 within a
    conversation's part of a range, which starts after ``start`` turns of earlier ranges.
    So a conversation with very many turns is several tasks'.
    """
    dealt = written(turns.repartitionByRange("conv_id", F.asc_nulls_first("turn"), "tid").withColumn("part", F.spark_partition_id()), "turns")
    order = Window.partitionBy("conv_id", "part").orderBy(F.asc_nulls_first("turn"), "tid")
    placed = dealt.withColumn("own", F.row_number().over(order).cast("long") - 1).drop("turn")
    conv = Window.partitionBy("conv_id")
    before = conv.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy("conv_id", "part").agg(F.count("*").alias("many"))
    return placed, counts.select("conv_id", "part", F.coalesce(F.sum("many").over(before), F.lit(0)).alias("start"), F.sum("many").over(conv).alias("all"))


def rebuilt(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, pos, tid, size, length) of every rebuilt conversation, and (conv_id, length) of all, turnless ones too."""
    placed, parts = positions(turn_ids(rows))
    parts = written(parts, "parts")
    at = placed.join(parts, ["conv_id", "part"]).withColumn("pos", F.col("start") + F.col("own"))
    base = F.col("conv_id") - F.col("conv_id") % 5
    first = at.where((F.col("conv_id") % 5 == 0) & (F.col("pos") < _SHARED)).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("pos", "tid", "size"))).alias("first"))
    take = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (_SHARED + 1)).alias("take")
    convs = parts.groupBy("conv_id").agg(F.first("all").alias("all")).select("conv_id", "all", base.alias("base"), take)
    convs = convs.join(first.withColumnRenamed("conv_id", "base"), "base", "left")
    shared = F.when(F.col("first").isNull() | (F.col("take") == 0), F.array().cast("array<struct<pos:bigint,tid:binary,size:bigint>>")).otherwise(F.slice("first", F.lit(1), F.greatest(F.col("take"), F.lit(1)).cast("int")))
    convs = written(convs.select("conv_id", "take", shared.alias("shared"), (F.size(shared) + F.greatest(F.col("all") - F.col("take"), F.lit(0))).cast("long").alias("length")), "convs")
    lead = convs.select("conv_id", F.explode("shared").alias("t"), "length").select("conv_id", "t.pos", "t.tid", "t.size", "length")
    # (conv_id, part) is no hot key, whatever a conversation's length
    info = parts.join(convs.select("conv_id", "take", F.size("shared").cast("long").alias("lead"), "length"), "conv_id")
    own = placed.join(info, ["conv_id", "part"]).withColumn("pos", F.col("start") + F.col("own")).where(F.col("pos") >= F.col("take"))
    own = own.select("conv_id", (F.col("pos") - F.col("take") + F.col("lead")).alias("pos"), "tid", "size", "length")
    return lead.unionByName(own), convs.select("conv_id", "length")


def suffixes(turns: DataFrame, convs: DataFrame, span: int) -> DataFrame:
    """(conv_id, level, head, tids, sizes, ends, key): the ``level``-th ``span`` turns of each conversation under their head."""
    level = F.floor(F.col("pos") / span).cast("long")
    cut = turns.groupBy("conv_id", level.alias("level")).agg(F.array_sort(F.collect_list(F.struct("pos", "tid", "size"))).alias("t"), F.first("length").alias("length"))
    cut = cut.select("conv_id", "level", F.transform("t", lambda x: x["tid"]).alias("tids"), F.transform("t", lambda x: x["size"]).alias("sizes"), (F.col("length") <= (F.col("level") + 1) * span).alias("ends"))
    none = convs.where("length = 0").select("conv_id", F.lit(0).cast("long").alias("level"), F.array().cast("array<binary>").alias("tids"), F.array().cast("array<bigint>").alias("sizes"), F.lit(True).alias("ends"))
    cut = written(cut.unionByName(none), "cut")

    def chain(batches):
        """Heads of a long conversation's suffixes, one after another."""
        for batch in batches:
            for conv, levels in zip(batch.column("conv_id").to_pylist(), batch.column("d").to_pylist(), strict=True):
                head, out = _ROOT, []
                for d in levels:
                    out.append((d["level"], head))
                    head = hashlib.sha256(f"{head}|{d['digest']}".encode()).hexdigest()
                for at in range(0, len(out), 10_000):
                    some = out[at : at + 10_000]
                    yield pa.record_batch([pa.array([conv] * len(some), pa.int64()), pa.array([x for x, _ in some], pa.int64()), pa.array([x for _, x in some])], names=["conv_id", "level", "head"])

    digest = F.array_join(F.transform("tids", F.hex), ",").alias("digest")
    long = cut.join(convs.where(F.col("length") > span).select("conv_id"), "conv_id", "left_semi")
    listed = long.select("conv_id", "level", F.sha2(digest, 256).alias("digest")).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("level", "digest"))).alias("d"))
    heads = listed.mapInArrow(chain, "conv_id long, level long, head string").where("level > 0")
    named = cut.join(heads, ["conv_id", "level"], "left").withColumn("head", F.coalesce("head", F.lit(_ROOT)))
    key = F.sha2(F.concat("head", F.lit("|"), F.sha2(F.array_join(F.transform("tids", F.hex), ","), 256)), 256)
    return written(named.select("conv_id", "level", "head", "tids", "sizes", "ends", key.alias("key")), "suffixes")


@dataclass
class Burst:
    """Containers' rows (with box, start, over, up), and the runs of nodes that burst, round by round."""

    rows: DataFrame
    runs: list[DataFrame]


def burst(rows: DataFrame, most: int) -> Burst:
    """Split containers until none has over ``most`` rows; rows: level, head, tids, sizes, n, conv, key, up."""
    now = rows.withColumn("box", F.col("head")).withColumn("over", F.lit(None).cast("string")).withColumn("start", F.lit(0).cast("long"))
    done, runs = [], []
    while True:
        apart = F.zip_with(F.min("tids"), F.max("tids"), lambda a, b: F.coalesce(a == b, F.lit(False)))
        boxes = now.groupBy("level", "box").agg(F.count("*").alias("rows"), apart.alias("same"), F.sum("n").alias("all"), F.min("conv").alias("least"))
        # all suffixes share as many turns as the first and the last of them do
        fork = F.coalesce(F.array_position("same", False) - 1, F.lit(0))
        boxes = written(boxes.where(F.col("rows") > most).select("level", "box", fork.cast("long").alias("fork"), F.col("all"), "least"), "oversized")
        if boxes.isEmpty():
            break
        big = small(boxes)
        if len(runs) == 0:
            now = written(now, "containers")
        done.append(now.join(big.select("level", "box"), ["level", "box"], "left_anti"))
        hit = now.join(big, ["level", "box"])
        goes = F.size("tids") > F.col("fork")
        turn = F.hex(F.get("tids", F.col("fork").cast("int")))
        # forks: counted on few distinct pairs, since a turn id repeats within its box
        sums = hit.groupBy("level", "box", "over", "head", "start", "up", "fork", "all", "least").agg(F.min(F.when(~goes, F.col("key"))).alias("key"), F.max(F.struct(F.size("tids"), F.slice("sizes", F.lit(1), F.col("fork").cast("int")).alias("s")))["s"].alias("sizes"))
        forks = hit.where(goes).select("level", "box", turn.alias("turn")).distinct().groupBy("level", "box").agg(F.count("*").alias("forks"))
        run = sums.join(forks, ["level", "box"]).select("level", "box", "over", "head", F.col("fork"), "start", F.col("fork").alias("stop"), F.col("all").alias("n"), F.col("least").alias("conv"), "up", "forks", "sizes", "key")
        runs.append(written(run, "runs"))
        # the head of a new container is the node at the fork; where that is the old head, so is its conversation
        up = F.when(F.col("fork") > F.col("start"), F.col("least")).otherwise(F.col("up"))
        child = hit.where(goes).withColumn("up", up).withColumn("over", F.col("box")).withColumn("box", F.sha2(F.concat("box", F.lit("/"), turn), 256)).withColumn("start", F.col("fork"))
        now = written(child.select(*now.columns), "containers")
    return Burst(now if not done else _union([*done, now]), runs)


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


_NODES = "level long, box string, over string, head string, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, key string"


class _Sweep:
    """One container's suffixes, in order, into nodes."""

    def __init__(self, row: dict):
        self.row, self.nodes, self.path = row, [], []
        self.tids: list[bytes] = []
        # children, leaves, saved of the container
        self.total = [0, 0, 0]

    def add(self, r: dict) -> None:
        tids, start = r["tids"], self.row["start"]
        same, most = start, min(len(tids), len(self.tids))
        while same < most and tids[same] == self.tids[same]:
            same += 1
        self.close(same)
        for size in r["sizes"][same:]:
            # n, conv, children, leaves, saved, size, key, children of this node
            self.path.append([0, r["conv"], 0, 0, 0, size, None, []])
        self.tids = tids
        for node in self.path:
            node[0] += r["n"]
            node[1] = min(node[1], r["conv"])
        if len(tids) > start:
            last = self.path[-1]
            last[6] = r["key"]
            last[2], last[3], last[4] = r["below"] or 0, r["leaves"] or 0, r["saved"] or 0
        # a suffix that ends at the head itself adds no node

    def close(self, depth: int) -> None:
        while len(self.path) > depth - self.row["start"]:
            node = self.path.pop()
            n, conv, children, leaves, saved, size, key, inner = node
            leaves, saved = leaves or (0 if children else 1), saved + (n - 1) * size
            at = len(self.nodes)
            self.nodes.append([self.row["start"] + len(self.path) + 1, conv, None, n, children, leaves, saved, key])
            for i in inner:
                self.nodes[i][2] = conv
            above = self.path[-1] if self.path else None
            if above is not None:
                above[7].append(at)
                above[2], above[3], above[4] = above[2] + 1, above[3] + leaves, above[4] + saved
            else:
                self.nodes[at][2] = self.row["up"]
                self.total = [self.total[0] + 1, self.total[1] + leaves, self.total[2] + saved]

    def out(self):
        """Nodes, then the container itself as a row of depth null."""
        self.close(self.row["start"])
        own = (self.row["level"], self.row["box"], self.row["over"], self.row["head"])
        yield from ((*own, *n) for n in self.nodes)
        yield (*own, None, self.row["up"], None, None, *self.total, None)


def sweep(rows: DataFrame) -> DataFrame:
    """Nodes of all containers, and a row of depth null for each with its children, leaves and savings."""
    kinds = {"long": pa.int64(), "string": pa.string()}
    fields = [f.strip().split(" ") for f in _NODES.split(",")]

    def run(batches):
        now, waiting = None, []

        def batch_of():
            columns = list(zip(*waiting, strict=True))
            return pa.record_batch([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])

        for batch in batches:
            for r in batch.to_pylist():
                if now is None or (now.row["level"], now.row["box"]) != (r["level"], r["box"]):
                    if now is not None:
                        waiting += now.out()
                        if len(waiting) > 20_000:
                            yield batch_of()
                            waiting = []
                    now = _Sweep(r)
                now.add(r)
        if now is not None:
            waiting += now.out()
        if waiting:
            yield batch_of()

    shards = rows.repartition("level", "box").sortWithinPartitions("level", "box", "tids")
    return written(shards.mapInArrow(run, _NODES), "nodes")


def fold(swept: DataFrame, runs: list[DataFrame], span: int) -> tuple[list[DataFrame], DataFrame]:
    """Node rows of the runs above containers, and (level, head, below, leaves, saved) of whole heads."""
    boxes = swept.where("depth IS NULL").select("level", "box", "over", "head", F.col("n_children").alias("below"), F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved"))
    nodes, whole = [], [boxes.where("over IS NULL")]
    waiting = [boxes.where("over IS NOT NULL")] if runs else []
    for run in reversed(runs):
        below = _union(waiting).groupBy("level", F.col("over").alias("box")).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
        # savings of the run itself, from each of its nodes down
        own = lambda first: F.aggregate(F.slice("sizes", first, F.greatest(F.col("stop") - first + 1, F.lit(0)).cast("int")), F.lit(0).cast("long"), lambda a, x: a + x) * (F.col("n") - 1)
        now = run.join(below, ["level", "box"])
        one = now.where("stop > start").withColumn("d", F.explode(F.sequence(F.col("start") + 1, F.col("stop"))))
        last = F.col("d") == F.col("stop")
        nodes.append(
            one.select(
                "level", "box", "over", "head", F.col("d").alias("depth"), F.col("conv").alias("conv_id"), F.when(F.col("d") == F.col("start") + 1, F.col("up")).otherwise(F.col("conv")).alias("parent_conv_id"), F.col("n").alias("n_convs"),
                F.when(last, F.col("forks")).otherwise(F.lit(1)).cast("long").alias("n_children"), F.col("leaves").alias("n_leaves"), (F.col("saved") + own(F.col("d").cast("int"))).alias("saved_tokens"), F.when(last, F.col("key")).alias("key"),
            )
        )
        heads = written(now.select("level", "box", "over", "head", F.when(F.col("stop") > F.col("start"), F.lit(1)).otherwise(F.col("forks")).cast("long").alias("below"), "leaves", (F.col("saved") + own((F.col("start") + 1).cast("int"))).alias("saved")), "heads")
        whole.append(heads.where("over IS NULL"))
        waiting.append(heads.where("over IS NOT NULL"))
    return nodes, _union(whole).select("level", "head", "below", "leaves", "saved")


def end_digests(ends: DataFrame) -> DataFrame:
    """(key, ends_sha256): SHA-256 of the decimal conv_ids of each key, ascending and joined by commas.

    A key's ids stream through one hash in order, since SHA-256 has no other way; nothing
    but the hash is held.
    """

    def run(batches):
        now, digest, out = None, None, []
        for batch in batches:
            for key, conv in zip(batch.column("key").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
                if key == now:
                    digest.update(f",{conv}".encode())
                    continue
                if now is not None:
                    out.append((now, digest.hexdigest()))
                now, digest = key, hashlib.sha256(str(conv).encode())
            yield pa.record_batch([pa.array([k for k, _ in out], pa.string()), pa.array([d for _, d in out], pa.string())], names=["key", "ends_sha256"])
            out = []
        if now is not None:
            yield pa.record_batch([pa.array([now]), pa.array([digest.hexdigest()])], names=["key", "ends_sha256"])

    return ends.select("key", "conv_id").repartition("key").sortWithinPartitions("key", "conv_id").mapInArrow(run, "key string, ends_sha256 string")


def prefix_trie(rows: DataFrame, span: int = SPAN, most: int = CONTAINER) -> DataFrame:
    """One row a node of the trie of rebuilt conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    rows: conv_id, turn, role, text; other columns are ignored. Rows without a conv_id are
    left out; a null role or text is empty; null turns come first; of equal turns, the
    smaller hash of role and text comes first, and rows that repeat all of them are turns
    of their own. The first of a negative conv_id's five is nearer zero (% as in SQL). No
    rows give no nodes. Conversations whose rebuilt form has no turn are
    members of the root alone. ``span`` bounds a suffix, ``most`` a container; neither
    changes the result.
    """
    turns, convs = rebuilt(rows)
    cut = suffixes(turns, convs, span)
    # equal suffixes of a head are one row; a head's own node belongs to the level above
    entry = cut.groupBy("level", "head", "tids").agg(F.first("sizes").alias("sizes"), F.count("*").alias("n"), F.min("conv_id").alias("conv"), F.first("key").alias("key"), F.max((~F.col("ends")).cast("long")).alias("more"))
    entry = written(entry, "entries")
    total, least, deepest = cut.where("level = 0").agg(F.count("*"), F.min("conv_id"), F.lit(0)).first()
    result = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
    if not total:
        return rows.sparkSession.createDataFrame([], result)
    deepest = cut.agg(F.max("level")).first()[0]
    no_tail = {c: F.lit(None).cast("long") for c in ("below", "leaves", "saved")}
    root_up = F.lit(least).cast("long")
    if deepest:
        above = entry.select(F.col("key").alias("head"), (F.col("level") + 1).alias("level"), F.col("conv").alias("up"))
        # a suffix that other turns follow ends at no leaf
        deep = entry.where("level > 0").join(above, ["level", "head"]).withColumns(no_tail | {"below": F.col("more")})
        deep = burst(written(deep, "deep"), most)
        _, local = fold(sweep(deep.rows), deep.runs, span)
        local = local.join(entry.groupBy("level", "head").agg(F.min("conv").alias("conv_id")), ["level", "head"])
        # each head's own sums go to its smallest member, and from there to all heads above it
        members = cut.where("level > 0").select("conv_id", "level", "head").join(local, ["level", "head", "conv_id"], "left")
        below = Window.partitionBy("conv_id").orderBy(F.desc("level")).rowsBetween(Window.unboundedPreceding, 0)
        sums = members.select("level", "head", F.sum("leaves").over(below).alias("leaves"), F.sum("saved").over(below).alias("saved")).groupBy("level", "head").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
        tails = sums.join(local.select("level", "head", "below"), ["level", "head"])
        tails = written(tails.select(F.col("head").alias("key"), (F.col("level") - 1).alias("level"), "below", "leaves", "saved"), "tails")
        ready = entry.join(above, ["level", "head"], "left").withColumn("up", F.coalesce("up", root_up)).join(tails, ["level", "key"], "left")
    else:
        ready = entry.withColumn("up", root_up).withColumns(no_tail)
    whole = burst(ready.select("level", "head", "tids", "sizes", "n", "conv", "key", "up", "below", "leaves", "saved"), most)
    swept = sweep(whole.rows)
    runs, heads = fold(swept, whole.runs, span)
    columns = ["level", "depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "key"]
    nodes = _union([n.select(*columns) for n in [swept.where("depth IS NOT NULL"), *runs]])
    nodes = nodes.withColumn("depth", F.col("level") * span + F.col("depth")).drop("level")
    none = F.sha2(F.concat(F.lit(_ROOT + "|"), F.sha2(F.lit(""), 256)), 256)  # the key of no turns
    root = heads.where("level = 0").select(
        F.lit(0).cast("long").alias("depth"), root_up.alias("conv_id"), F.lit(None).cast("long").alias("parent_conv_id"), F.lit(total).cast("long").alias("n_convs"), F.col("below").alias("n_children"),
        F.greatest("leaves", F.lit(1)).alias("n_leaves"), F.col("saved").alias("saved_tokens"), none.alias("key"),
    )
    digests = end_digests(cut.where("ends"))
    out = nodes.unionByName(root).join(digests, "key", "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(_ROOT)).alias("ends_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


ORACLE_SQL = """
WITH t AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END))) AS crc),
o AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id
  ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS pos FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 5 AS base, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
  lambda s, x: xor(s >> 8, t.crc[(xor(s, x) & 255) + 1])), 4294967295) % 9 AS h FROM (SELECT DISTINCT conv_id FROM o), t),
r AS (SELECT c.conv_id, 0 AS own, pos, role, text FROM c JOIN o ON o.conv_id = c.base AND o.pos < c.h
  UNION ALL SELECT c.conv_id, 1, pos, role, text FROM c JOIN o ON o.conv_id = c.conv_id AND o.pos >= c.h),
s AS (SELECT conv_id, list({'role': role, 'text': text} ORDER BY own, pos) AS s FROM r GROUP BY conv_id),
a AS (SELECT c.conv_id, coalesce(s, []) AS s FROM c LEFT JOIN s USING (conv_id)),
p AS (SELECT conv_id, d, s[1:d] AS p, CASE WHEN d > 0 THEN s[1:d - 1] END AS up, d = len(s) AS ends FROM (SELECT conv_id, s, unnest(range(len(s) + 1)) AS d FROM a)),
n AS (SELECT p, any_value(up) AS up, d, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends)), sha256('')) AS ends FROM p GROUP BY p, d),
k AS (SELECT up, count(*) AS k FROM n WHERE d > 0 GROUP BY up),
m AS (SELECT n.*, coalesce(k.k, 0) AS n_children, CASE WHEN d > 0 THEN (n_convs - 1) * octet_length(encode(p[d].text)) ELSE 0 END AS saved FROM n LEFT JOIN k ON k.up = n.p),
u AS (SELECT v.p, sum((x.n_children = 0)::INT)::BIGINT AS n_leaves, sum(x.saved)::BIGINT AS saved_tokens FROM m v JOIN m x ON x.d >= v.d AND x.p[1:v.d] = v.p GROUP BY v.p)
SELECT m.conv_id, m.d AS depth, q.conv_id AS parent_conv_id, m.n_convs, m.n_children, u.n_leaves, u.saved_tokens, m.ends AS ends_sha256
FROM m JOIN u ON u.p = m.p LEFT JOIN n q ON q.p = m.up AND m.d > 0
"""
