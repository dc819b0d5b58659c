"""Exact top-k by integer inner product with a paged M-tree and best-first search.

An M-tree needs a metric. Each vector x gets one more component, sqrt(M - |x|^2) with M
the largest squared norm, and each query a zero; then |q - x|^2 = |q|^2 + M - 2 q.x, so
the nearest vectors are those with the largest products. Bounds come from distances with
a margin for rounding; ranks come from integer products alone.

The top of the tree is two levels of pivots, a table of bounded size: what lies nearest to
a top pivot forms a subtree, and what lies nearest to one of its inner pivots a part. Each
part is built in one task as pages of entries (routing object, covering radius, distance
to the parent's routing object) and written as a table. A query is answered first in the
part of its nearest pivots; the k-th product found there then rules out other parts by
their covering radii before they are searched.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptorium.llm.common import table, written

#: Bytes of pivots that the driver and every task hold at most.
PIVOT_BYTES = 32 << 20
LEAF = 256
FANOUT = 16
_PAGES = "subtree int, part int, cut int, page int, leaf boolean, n int, objects binary, parent_distance binary, radius binary, child binary, ids binary, id_counts binary"


def integer_vectors(rows: DataFrame, scale: int = 1024) -> DataFrame:
    """vec_id, v (64-bit integers as bytes), norm (squared) and largest (of its components), of vectors that are whole and finite.

    Components beyond 2**62 are cut to that here; ``largest`` tells, and :func:`top_k` refuses them.
    """

    def run(batches):
        for batch in batches:
            ids, vectors, norms, largest = [], [], [], []
            for i, v in zip(batch.column("vec_id").to_pylist(), batch.column("embedding").to_pylist(), strict=True):
                if i is None or v is None or any(x is None for x in v):
                    continue
                x = np.asarray(v, dtype=np.float64)
                if np.isfinite(x).all():
                    with np.errstate(over="ignore"):
                        x = np.floor(scale * x)
                        norms.append(float((x * x).sum()))
                    ids.append(i)
                    largest.append(float(np.abs(x).max(initial=0)))
                    vectors.append(np.clip(x, -(2.0**62), 2.0**62).astype(np.int64))
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array([x.tobytes() for x in vectors], pa.binary()), pa.array(norms, pa.float64()), pa.array(largest, pa.float64())], names=["vec_id", "v", "norm", "largest"])

    return rows.select("vec_id", "embedding").mapInArrow(run, "vec_id long, v binary, norm double, largest double")


def _matrix(column, dims: int) -> np.ndarray:
    """Vectors from bytes, shorter ones padded with zeros (which change no product)."""
    out = np.zeros((len(column), dims), dtype=np.int64)
    for i, raw in enumerate(column):
        x = np.frombuffer(raw, dtype=np.int64)
        out[i, : len(x)] = x
    return out


def _lifted(x: np.ndarray, most: float) -> np.ndarray:
    f = x.astype(np.float64)
    return np.hstack([f, np.sqrt(np.maximum(most - (f * f).sum(axis=1), 0))[:, None]])


def pick_pivots(sample: np.ndarray, many: int) -> np.ndarray:
    """Indexes of objects far from each other, each next the farthest from those before."""
    chosen = [0]
    near = np.linalg.norm(sample - sample[0], axis=1)
    while len(chosen) < many and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, np.linalg.norm(sample - sample[chosen[-1]], axis=1))
    return np.array(chosen)


def build_pages(x: np.ndarray, lifted: np.ndarray, root: np.ndarray) -> list[dict]:
    """Pages of an M-tree over the rows of ``lifted``; page 0 is the root.

    A page's entries: leaf pages hold row numbers, inner pages routing objects with the
    covering radius and the child page; both hold each entry's distance to the routing
    object of their own page (``root`` for page 0).
    """
    pages: list[dict] = []

    def add(rows: np.ndarray, parent: np.ndarray) -> int:
        at = len(pages)
        pages.append({})
        to_parent = np.linalg.norm(lifted[rows] - parent, axis=1)
        if len(rows) <= LEAF or to_parent.max() - to_parent.min() == 0 and (lifted[rows] == lifted[rows[0]]).all():
            pages[at] = {"page": at, "leaf": True, "objects": lifted[rows], "rows": rows, "parent_distance": to_parent, "radius": np.zeros(len(rows)), "child": np.zeros(len(rows), dtype=np.int32)}
            return at
        step = max(1, len(rows) // 512)
        some = rows[::step]
        pivots = some[pick_pivots(lifted[some], FANOUT)]
        apart = np.linalg.norm(lifted[rows][:, None, :] - lifted[pivots][None, :, :], axis=2) if len(rows) * len(pivots) < 1 << 14 else np.stack([np.linalg.norm(lifted[rows] - lifted[p], axis=1) for p in pivots], axis=1)
        own = apart.argmin(axis=1)
        used = np.unique(own)
        children, radii = [], []
        for k in used:
            mine = own == k
            radii.append(float(apart[mine, k].max()))
            children.append(add(rows[mine], lifted[pivots[k]]))
        objects = lifted[pivots[used]]
        pages[at] = {"page": at, "leaf": False, "objects": objects, "rows": None, "parent_distance": np.linalg.norm(objects - parent, axis=1), "radius": np.array(radii), "child": np.array(children, dtype=np.int32)}
        return at

    if len(x):
        add(np.arange(len(x)), root)
    return pages


class Tree:
    """A part's pages, as read back."""

    def __init__(self, pdf: pd.DataFrame, dims: int):
        self.pages, self.largest = {}, 0.0
        #: Entries whose distance or product was computed, and those passed over by a stored distance.
        self.computed = self.avoided = 0
        for r in pdf.itertuples():
            ids, counts = np.frombuffer(r.ids, dtype=np.int64), np.frombuffer(r.id_counts, dtype=np.int32)
            objects = np.frombuffer(r.objects, dtype=np.float64)
            self.largest = max(self.largest, float(np.abs(objects).max(initial=0)))
            self.pages[r.page] = (r.leaf, objects.reshape(r.n, dims + 1), np.frombuffer(r.parent_distance), np.frombuffer(r.radius), np.frombuffer(r.child, dtype=np.int32), ids, np.concatenate(([0], np.cumsum(counts))))

    def search(self, q: np.ndarray, own: int, k: int, most: float, to_root: float, floor: float | None) -> list[tuple[int, int]]:
        """The k best (product, vec_id) of this part that can be among the best ``k`` at ``floor`` or above.

        Pages wait in order of the least distance anything in them can have. An entry
        whose |distance of the query to the page's object - stored distance to it| exceeds
        the radius and the bound is passed over without computing its distance.
        """
        qf = np.append(q.astype(np.float64), 0.0)
        square = float(qf @ qf)
        margin = 1e-6 * (1 + np.sqrt(square + most))

        def reach(product: float) -> float:  # nothing farther has so large a product
            return np.sqrt(max(0.0, square + most - 2 * product)) + margin

        exact = self.largest * np.abs(qf).max(initial=0) * len(qf) < 2**53
        best: list[tuple[int, int]] = []  # heap of (product, -vec_id), worst first
        bound = reach(floor) if floor is not None else np.inf
        waiting = [(0.0, 0, to_root)]
        while waiting:
            least, page, to_object = heapq.heappop(waiting)
            if least > bound:
                break
            leaf, objects, parent_distance, radius, child, ids, ends = self.pages[page]
            near = np.flatnonzero(np.abs(to_object - parent_distance) - radius <= bound + margin)
            self.computed, self.avoided = self.computed + len(near), self.avoided + len(objects) - len(near)
            if not len(near):
                continue
            some = objects if len(near) == len(objects) else objects[near]
            if not leaf:
                apart = np.linalg.norm(some - qf, axis=1)
                for d, i in zip(apart.tolist(), near.tolist(), strict=True):
                    low = max(0.0, d - radius[i] - margin)
                    if low <= bound:
                        heapq.heappush(waiting, (max(low, least), int(child[i]), d))
                continue
            # below 2**53 sums of doubles are exact, beyond it those of integers
            products = (some @ qf).astype(np.int64) if exact else some[:, :-1].astype(np.int64) @ q
            least_product = best[0][0] if len(best) == k else None if floor is None else floor
            good = slice(None) if least_product is None else products >= least_product
            pairs = zip(products[good].tolist(), near[good].tolist(), strict=True)
            for p, i in pairs:
                if len(best) == k and p < best[0][0]:
                    continue
                for vec in ids[ends[i] : ends[i + 1]].tolist():
                    if vec == own:
                        continue
                    if len(best) < k:
                        heapq.heappush(best, (p, -vec))
                    elif (p, -vec) > best[0]:
                        heapq.heapreplace(best, (p, -vec))
            if len(best) == k:
                bound = min(bound, reach(best[0][0]))
        return [(p, -v) for p, v in best]


def _search(pages: DataFrame, asked: DataFrame, k: int, dims: int, most: float, pivots) -> DataFrame:
    """Answers of (query_id, v, floor, subtree, part, cut, block) in the parts they name."""

    def run(key: tuple, tree: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, int]] = []
        if len(tree) and len(queries):
            held, root = Tree(tree, dims), pivots.value[key[0]][0][key[1]]
            for r, q in zip(queries.itertuples(), _matrix(queries["v"], dims), strict=True):
                to_root = float(np.linalg.norm(np.append(q.astype(np.float64), 0.0) - root))
                found = held.search(q, r.query_id, k, most, to_root, None if pd.isna(r.floor) else int(r.floor))
                out += [(r.query_id, p, v) for p, v in found]
        return pd.DataFrame(out, columns=["query_id", "score", "vec_id"])

    # a block's queries meet a copy of the part's pages
    blocks = asked.select(*(F.col(c).alias(c) for c in ("subtree", "part", "cut", "block"))).distinct()
    trees = pages.join(blocks, ["subtree", "part", "cut"])
    key = ["subtree", "part", "cut", "block"]
    return trees.groupBy(*key).cogroup(asked.groupBy(*key)).applyInPandas(run, "query_id long, score long, vec_id long")


def _nearest(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row, the nearest pivot and its distance."""
    if not len(x):
        return np.zeros(0, dtype=np.int32), np.zeros(0)
    apart = np.stack([np.linalg.norm(x - p, axis=1) for p in pivots], axis=1)
    at = apart.argmin(axis=1).astype(np.int32)
    return at, apart[np.arange(len(x)), at]


def top_k(rows: DataFrame, every: int = 100, k: int = 10, scale: int = 1024, part_rows: int = 4096, most_pivots: int = 256, query_block: int = 4096) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` largest products for each vec_id divisible by ``every``.

    ``rows`` has vec_id and embedding (array<float>). Vectors that are null, hold a null or
    a number that is not finite, or have a null vec_id take no part; shorter vectors count
    as ending in zeros; rows that repeat a vec_id and its vector are one; fewer than ``k``
    others give fewer rows; no rows give no rows; other columns are ignored. Equal vectors
    are one entry with their k + 1 smallest ids, which is all that can be asked of them.
    Vectors so long that a product could leave 64 bits raise ValueError before the search.

    ``most_pivots`` bounds the pivots of each of the two levels (and ``PIVOT_BYTES`` all of
    them), so the driver's and every task's table of pivots does not grow with the rows.
    Parts aim at ``part_rows`` rows; one that gets more than twice as many is cut by hash,
    so that no task holds more.
    """
    spark = rows.sparkSession
    whole = written(integer_vectors(rows, scale), "vectors")
    by_id = Window.partitionBy("v").orderBy("vec_id")
    few = whole.select("v", "vec_id").distinct().withColumn("r", F.row_number().over(by_id)).where(F.col("r") <= k + 1)
    vectors = written(few.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")), "vectors")
    many, most, dims, largest = whole.agg(F.count("*"), F.max("norm"), F.max(F.length("v")), F.max("largest")).first()
    result = "query_id long, rank int, vec_id long, score long"
    if not many:
        return spark.createDataFrame([], result)
    dims //= 8
    if dims * largest * largest >= 2.0**63:
        raise ValueError(f"inner products leave 64 bits: components up to {largest:g} in {dims} dimensions")
    sample = _lifted(_matrix([r["v"] for r in vectors.select("v").orderBy(F.xxhash64("v"), "v").limit(2048).collect()], dims), most)
    wanted = min(most_pivots, -(-many // part_rows))
    inner_most = max(1, min(most_pivots, PIVOT_BYTES // (8 * (dims + 1) * wanted)))
    top = spark.sparkContext.broadcast(sample[pick_pivots(sample, wanted)])

    def to_subtree(batches):
        for batch in batches:
            at, _ = _nearest(_lifted(_matrix(batch.column("v").to_pylist(), dims), most), top.value)
            yield pa.record_batch([batch.column("v"), batch.column("ids"), pa.array(at)], names=["v", "ids", "subtree"])

    in_subtree = written(vectors.mapInArrow(to_subtree, "v binary, ids array<long>, subtree int"), "subtrees")
    parts = {r["subtree"]: min(inner_most, -(-r["count"] // part_rows)) for r in in_subtree.groupBy("subtree").count().collect()}  # one row a pivot

    def inner(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x = _matrix(pdf["v"], dims)
        chosen = pick_pivots(_lifted(x, most), parts[key[0]])
        return pd.DataFrame({"subtree": key[0], "v": [x[i].tobytes() for i in chosen]})

    by_hash = Window.partitionBy("subtree").orderBy(F.xxhash64("v"), "v")
    drawn = in_subtree.select("subtree", "v").withColumn("r", F.row_number().over(by_hash)).where(F.col("r") <= 4 * inner_most)
    found: dict[int, list[bytes]] = {}
    for r in drawn.groupBy("subtree").applyInPandas(inner, "subtree int, v binary").collect():  # PIVOT_BYTES at most
        found.setdefault(r["subtree"], []).append(r["v"])
    centres = {s: _lifted(_matrix(v, dims), most) for s, v in found.items()}
    held = spark.sparkContext.broadcast(centres)

    def to_part(batches):
        for batch in batches:
            x, subtree = _lifted(_matrix(batch.column("v").to_pylist(), dims), most), batch.column("subtree").to_numpy()
            part, d = np.zeros(len(x), dtype=np.int32), np.zeros(len(x))
            for s in np.unique(subtree):
                mine = subtree == s
                part[mine], d[mine] = _nearest(x[mine], held.value[s])
            yield pa.record_batch([batch.column("v"), batch.column("ids"), batch.column("subtree"), pa.array(part), pa.array(d)], names=["v", "ids", "subtree", "part", "d"])

    dealt = written(in_subtree.mapInArrow(to_part, "v binary, ids array<long>, subtree int, part int, d double"), "dealt")
    # one row a pivot: covering radius, and how many tasks its part takes
    sizes = dealt.groupBy("subtree", "part").agg(F.max("d").alias("radius"), F.ceil(F.count("*") / (2 * part_rows)).cast("int").alias("cuts"))
    table_ = {s: (c, np.full(len(c), -np.inf), np.zeros(len(c), dtype=np.int32)) for s, c in centres.items()}
    for s, p, r, c in sizes.collect():
        table_[s][1][p], table_[s][2][p] = r, c
    own = spark.sparkContext.broadcast(table_)
    cuts = spark.createDataFrame([(s, p, int(c)) for s, t in table_.items() for p, c in enumerate(t[2]) if c], "subtree int, part int, cuts int")
    placed = dealt.join(F.broadcast(cuts), ["subtree", "part"]).withColumn("cut", F.pmod(F.xxhash64("v"), F.col("cuts")).cast("int"))

    def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x = _matrix(pdf["v"], dims)
        ids = pdf["ids"].tolist()
        out = []
        for p in build_pages(x, _lifted(x, most), own.value[key[0]][0][key[1]]):
            mine = [ids[i] for i in p["rows"]] if p["leaf"] else []
            out.append((*key, p["page"], p["leaf"], len(p["objects"]), p["objects"].tobytes(), p["parent_distance"].tobytes(), p["radius"].tobytes(), p["child"].tobytes(), np.array([i for m in mine for i in m], dtype=np.int64).tobytes(), np.array([len(m) for m in mine], dtype=np.int32).tobytes()))
        return pd.DataFrame(out, columns=[c.split()[0] for c in _PAGES.split(", ")])

    pages = written(placed.groupBy("subtree", "part", "cut").applyInPandas(build, _PAGES), "mtree")

    queries = whole.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "v").distinct()

    def route(home: bool):
        def run(batches):
            for batch in batches:
                x = _matrix(batch.column("v").to_pylist(), dims).astype(np.float64)
                x = np.hstack([x, np.zeros((len(x), 1))])
                first, _ = _nearest(x, np.stack([top.value[s] for s in sorted(own.value)]))
                names = np.array(sorted(own.value), dtype=np.int32)
                rows_, places = [], []
                floors = None if home else batch.column("floor").to_pylist()
                for i in range(len(x)):
                    square = float(x[i] @ x[i])
                    margin = 1e-6 * (1 + np.sqrt(square + most))
                    limit = np.inf if home or floors[i] is None else np.sqrt(max(0.0, square + most - 2 * floors[i])) + 2 * margin
                    for s in [names[first[i]]] if home else names:
                        centre, radius, cut = own.value[s]
                        apart = np.linalg.norm(centre - x[i], axis=1)
                        nearest = int(np.where(cut > 0, apart, np.inf).argmin())
                        take = [nearest] if home else np.flatnonzero((apart - radius <= limit) & (cut > 0)).tolist()
                        for p in take:
                            if home or s != names[first[i]] or p != nearest:
                                rows_ += [i] * int(cut[p])
                                places += [(int(s), p, c) for c in range(int(cut[p]))]
                some = batch.select(["query_id", "v"]).take(pa.array(rows_, pa.int64()))
                floor = pa.array([None if home else floors[i] for i in rows_], pa.float64())
                columns = [pa.array([p[n] for p in places], pa.int32()) for n in range(3)]
                yield pa.record_batch([*some.columns, floor, *columns], names=["query_id", "v", "floor", "subtree", "part", "cut"])

        return run

    routed = "query_id long, v binary, floor double, subtree int, part int, cut int"
    blocks = max(1, -(-many // (every * query_block)))
    block = F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block")
    near = written(_search(pages, queries.mapInArrow(route(True), routed).select("*", block), k, dims, most, own), "near")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    floors = near.withColumn("r", F.row_number().over(best)).where(F.col("r") == k).select("query_id", F.col("score").cast("double").alias("floor"))
    rest = queries.join(floors, "query_id", "left").mapInArrow(route(False), routed).select("*", block)
    found_ = near.unionByName(_search(pages, written(rest, "routed"), k, dims, most, own))
    return found_.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


ORACLE_SQL = """
WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 10
"""
