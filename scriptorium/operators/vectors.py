"""Vectors of texts and exact nearest neighbours."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from scriptorium.sources.papers import scratch_path
from scriptorium.sources.ranges import numbered_within
from scriptorium.sources.scratch import stored

#: Queries that are broadcast at most; more of them become rows beside the store, in blocks of so many.
QUERY_BLOCK = 10_000
#: Vectors of the store that meet a block of queries at a time.
PAGE_ROWS = 16_384
#: Queries of several blocks that a task holds at most, and numbers of the store's vectors.
LOT_ROWS, DEAL_NUMBERS = 40_000, 8_000_000
#: Queries and vectors whose distances are held at a time.
TILE = 256, 1024


def hash_vectors(rows: DataFrame, key: str, text: str, dims: int = 64) -> DataFrame:
    """(key, bucket, weight): L2-normalised token counts in ``dims`` hash buckets, as a sparse table."""
    token = F.explode(F.filter(F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}_]+"), lambda t: t != "")).alias("t")
    bucket = F.pmod(F.conv(F.substring(F.md5("t"), 1, 8), 16, 10).cast("long"), F.lit(dims)).cast("int")
    counts = rows.select(key, token).groupBy(key, bucket.alias("bucket")).agg(F.count("*").alias("n"))
    norm = F.sqrt(F.sum(F.col("n") * F.col("n")).over(Window.partitionBy(key)).cast("double"))
    return counts.select(key, "bucket", (F.col("n") / norm).alias("weight"))


def dense(rows: DataFrame, key: str, dims: int = 64) -> DataFrame:
    """(key, embedding) from the sparse table."""
    pairs = F.map_from_entries(F.collect_list(F.struct("bucket", "weight")))
    return rows.groupBy(key).agg(pairs.alias("m")).select(key, F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.coalesce(F.get(F.map_values(F.map_filter("m", lambda k, _: k == i)), F.lit(0)), F.lit(0.0)).cast("float")).alias("embedding"))


def embed_with(rows: DataFrame, batch_function, schema: str) -> DataFrame:
    """Vectors from a user's function over batches (an iterator of pandas frames to another)."""
    return rows.mapInPandas(batch_function, schema)


def embed_from(rows: DataFrame, vectors: DataFrame, key: str, batch: str | None = None) -> DataFrame:
    """``rows`` with the ``embedding`` that ``vectors`` (key, embedding) has for them; rows without one are left out.

    With ``batch``, a column that says which rows were sent together, a batch in which any
    row has no vector gives nothing, as a failed call would.
    """
    joined = rows.join(vectors.where("embedding IS NOT NULL").select(key, "embedding").dropDuplicates([key]), key, "left")
    if batch is None:
        return joined.where("embedding IS NOT NULL")
    failed = joined.where("embedding IS NULL").select(batch).distinct()
    return joined.join(failed, batch, "left_anti").select(*joined.columns)


def in_batches(rows: DataFrame, group: str, *order: str, most: int = 64) -> DataFrame:
    """``rows`` with ``batch_no``, from 1: each ``group``'s rows in ``order``, ``most`` to a call of an embedder.

    Rows are written first, since ranges are cut by a pass of its own over them.
    """
    numbered = numbered_within(stored(rows, "batches"), group, *order, name="_n")
    return numbered.withColumn("batch_no", F.floor((F.col("_n") - 1) / most).cast("long") + 1).drop("_n")


def batch_report(rows: DataFrame, vectors: DataFrame, key: str, group: str) -> DataFrame:
    """(group, batch_no, sent, missing, stored, failure): what became of each batch of ``rows`` (with ``batch_no``).

    A batch is stored whole or not at all: where rows have no vector, or vectors of
    different lengths, none of its rows are, and ``failure`` says why.
    """
    # only lengths meet the rows, not vectors
    known = vectors.groupBy(key).agg(F.max("embedding").alias("embedding")).where("embedding IS NOT NULL").select(key, F.size("embedding").alias("size"))
    per = rows.select(key, group, "batch_no").join(known, key, "left").groupBy(group, "batch_no").agg(F.count("*").alias("sent"), F.count_if(F.col("size").isNull()).alias("missing"), F.min("size").alias("least"), F.max("size").alias("most"))
    failure = F.when(F.col("missing") > 0, "missing vectors").when(F.col("least") != F.col("most"), "mixed lengths")
    return per.withColumn("failure", failure).select(group, "batch_no", "sent", "missing", F.when(F.col("failure").isNull(), F.col("sent")).otherwise(0).cast("long").alias("stored"), "failure")


def batch_totals(report: DataFrame) -> DataFrame:
    """batches, failed_batches, sent, stored over a report."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return report.agg(F.count("*").alias("batches"), F.count("failure").alias("failed_batches"), total("sent"), total("stored"))


def vector_profile(vectors: DataFrame) -> DataFrame:
    """shortest, longest, missing, vectors: mixed lengths show before a search fails on them."""
    n = F.size("embedding")
    return vectors.agg(F.min(F.when(F.col("embedding").isNotNull(), n)).alias("shortest"), F.max(F.when(F.col("embedding").isNotNull(), n)).alias("longest"), F.count_if(F.col("embedding").isNull()).alias("missing"), F.count("*").alias("vectors"))


def _usable(rows: DataFrame, name: str, vector: str, metric: str) -> DataFrame:
    """Rows with an id and a vector, all of it finite, and for cosine with a direction."""
    v = F.col(vector)
    good = F.col(name).isNotNull() & v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(good & F.exists(v, lambda x: x != 0) if metric == "cosine" else good)


def profile(queries: DataFrame, store: DataFrame) -> tuple[int | None, int]:
    """The one length of all vectors of both tables (None without vectors) and the number of queries, from one aggregate; raises where there are several lengths."""
    sizes = queries.select(F.size("q").alias("n"), F.lit(1).alias("asked")).unionByName(store.select(F.size("embedding").alias("n"), F.lit(0).alias("asked")))
    least, most, asked = sizes.agg(F.min("n"), F.max("n"), F.coalesce(F.sum("asked"), F.lit(0))).first()
    if least != most:
        raise ValueError(f"vectors of {least} to {most} components; embed all with one model first")
    return least, asked


def distances(q: np.ndarray, e: np.ndarray, metric: str) -> np.ndarray:
    """Distance of each row of ``q`` to each row of ``e``, component by component, so that equal vectors are equally far."""
    out = np.zeros((len(q), len(e)))
    for j in range(q.shape[1]):
        a, b = q[:, j, None], e[None, :, j]
        out += (a - b) ** 2 if metric in ("sql2", "l2") else a * b
    if metric == "l2":
        return np.sqrt(out)
    if metric == "cosine":
        size = lambda x: np.sqrt(np.add.accumulate(x * x, axis=1)[:, -1])
        out /= size(q)[:, None] * size(e)[None, :]
    return out if metric == "sql2" else 1 - out


class _Best:
    """The k nearest of what was seen so far for each of a few queries."""

    def __init__(self, q: np.ndarray, k: int, metric: str):
        self.q, self.k, self.metric = q, k, metric
        self.whose, self.ids, self.far = np.zeros(0, dtype=np.int64), None, np.zeros(0)
        self.limit = np.full(len(q), np.inf)  # the k-th distance so far

    def see(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        d = distances(self.q, vectors, self.metric)
        if len(vectors) > self.k and np.isinf(self.limit).any():  # most of the first vectors go before they are sorted
            self.limit = np.fmin(self.limit, np.partition(d, self.k - 1, axis=1)[:, self.k - 1])
        i, j = np.nonzero(d <= self.limit[:, None])
        if not len(i):
            return
        whose, ids_, far = np.concatenate((self.whose, i)), ids[j] if self.ids is None else np.concatenate((self.ids, ids[j])), np.concatenate((self.far, d[i, j]))
        order = np.lexsort((ids_, far, whose))
        whose, ids_, far = whose[order], ids_[order], far[order]
        place = np.arange(len(whose)) - np.searchsorted(whose, whose, "left")
        self.limit[whose[place == self.k - 1]] = far[place == self.k - 1]
        self.whose, self.ids, self.far = (x[place < self.k] for x in (whose, ids_, far))


class Nearest:
    """The k nearest of what was seen so far for each query; distances of one tile are held at a time."""

    def __init__(self, q: np.ndarray, k: int, metric: str):
        self.parts = [_Best(q[at : at + TILE[0]], k, metric) for at in range(0, len(q), TILE[0])]

    def see(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        for at in range(0, len(vectors), TILE[1]):
            for part in self.parts:
                part.see(ids[at : at + TILE[1]], vectors[at : at + TILE[1]])

    def found(self, names: list, kinds: tuple[pa.DataType, pa.DataType]) -> dict[str, pa.Array]:
        whose = [names[n * TILE[0] + i] for n, part in enumerate(self.parts) for i in part.whose]
        ids = [x for part in self.parts if part.ids is not None for x in part.ids.tolist()]
        return {"query_id": pa.array(whose, kinds[0]), "vec_id": pa.array(ids, kinds[1]), "distance": pa.array(np.concatenate([np.zeros(0), *(part.far for part in self.parts)]))}


def _vectors(column, dims: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(-1, dims)


def packed(rows: DataFrame, most: int, name: str) -> DataFrame:
    """(name, data): runs of at most ``most`` rows as Arrow streams, written; ``name`` tells them apart.

    Each task packs the rows it has, so nothing is shuffled and no key can be hot.
    """

    def run(batches):
        waiting, size = [], 0

        def out(held):
            table = pa.Table.from_batches(held)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema) as stream:
                stream.write_table(table)
            return pa.record_batch([pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["data"])

        for batch in batches:
            while batch.num_rows:
                part, batch = batch.slice(0, most - size), batch.slice(most - size)
                waiting.append(part)
                size += part.num_rows
                if size == most:
                    yield out(waiting)
                    waiting, size = [], 0
        if size:
            yield out(waiting)

    at = scratch_path(rows.sparkSession, name)
    blocks = rows.mapInArrow(run, "data binary").withColumn(name, F.monotonically_increasing_id())
    blocks.write.parquet(at)
    return rows.sparkSession.read.schema(blocks.schema).parquet(at)


def _tiles(pages: DataFrame, blocks: DataFrame, dims: int, k: int, metric: str, schema: str, kinds: tuple[pa.DataType, pa.DataType], query_block: int, page_rows: int) -> DataFrame:
    """Every page of the store with every block of queries, as deals of pages that meet lots of blocks.

    A page is copied once a lot and a block once a deal, so lots and deals are as large as
    a task holds, whatever the size of a block or page; there are more deals only where the
    cores would lack work.
    """
    cores = pages.sparkSession.sparkContext.defaultParallelism
    n_pages = pages.count()
    lots = -(-blocks.count() // max(4, LOT_ROWS // query_block))
    deals = max(-(-n_pages // max(1, DEAL_NUMBERS // (page_rows * dims))), min(n_pages, -(-2 * cores // lots)))
    of = lambda name, many: F.pmod(F.xxhash64(name), F.lit(many)).cast("int")
    all_of = lambda many: F.explode(F.sequence(F.lit(0), F.lit(many - 1)))
    left = pages.select(of("page", deals).alias("deal"), all_of(lots).alias("lot"), "data")
    right = blocks.select(all_of(deals).alias("deal"), of("block", lots).alias("lot"), "data")

    def run(page: pa.Table, asked: pa.Table) -> pa.Table:
        held = [pa.ipc.open_stream(raw.as_buffer()).read_all() for raw in asked.column("data")]
        if not held:
            return pa.table({"query_id": pa.array([], kinds[0]), "vec_id": pa.array([], kinds[1]), "distance": pa.array([], pa.float64())})
        block = pa.concat_tables(held).combine_chunks()
        near = Nearest(_vectors(block.column("q").combine_chunks(), dims), k, metric)
        for other in page.column("data"):
            for batch in pa.ipc.open_stream(other.as_buffer()).read_all().to_batches():
                near.see(np.array(batch.column("vec_id").to_pylist()), _vectors(batch.column("embedding"), dims))
        return pa.table(near.found(block.column("query_id").to_pylist(), kinds))

    key = ["deal", "lot"]
    # so many partitions by name: small as pages are, their work is not, and would be put together into few tasks
    dealt = lambda rows: rows.repartition(min(deals * lots, 32 * cores), *key)
    return dealt(left).groupBy(*key).cogroup(dealt(right).groupBy(*key)).applyInArrow(run, schema)


def knn(queries: DataFrame, store: DataFrame, k: int = 6, metric: str = "sql2", query_block: int = QUERY_BLOCK, page_rows: int = PAGE_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, distance): the ``k`` nearest rows of ``store`` for each query, ties by vec_id.

    queries: (query_id, q); store: (vec_id, embedding); metric: sql2, l2, ip or cosine.
    Rows without an id, and vectors that are null, hold a null or a number that is not finite (for cosine, or are
    all zeros) take no part; vectors of different lengths raise before the search. Rows
    that repeat an id each count.

    Up to ``query_block`` queries are broadcast and the store streams past them where it
    lies. More queries become blocks, rows beside the store: the store is read once, as
    pages of ``page_rows`` vectors, and a task meets a page with a block. Either way a task
    keeps k rows a query before the shuffle, and nothing that is broadcast grows.
    """
    spark = store.sparkSession
    queries, store = _usable(queries.select("query_id", "q"), "query_id", "q", metric), _usable(store.select("vec_id", "embedding"), "vec_id", "embedding", metric)
    dims, asked = profile(queries, store)
    kinds = {f.name: f.dataType for f in [*queries.schema, *store.schema]}
    schema = f"query_id {kinds['query_id'].simpleString()}, vec_id {kinds['vec_id'].simpleString()}, distance double"
    if not dims or not asked:
        return spark.createDataFrame([], schema.replace(", vec_id", ", rank int, vec_id"))
    arrow = to_arrow_type(kinds["query_id"]), to_arrow_type(kinds["vec_id"])
    if asked <= query_block:
        rows = queries.collect()  # ``query_block`` at most
        held = spark.sparkContext.broadcast(([r[0] for r in rows], np.array([r[1] for r in rows], dtype=np.float64).reshape(-1, dims)))

        def stream(batches):
            names, q = held.value
            near = Nearest(q, k, metric)
            for batch in batches:
                near.see(np.array(batch.column("vec_id").to_pylist()), _vectors(batch.column("embedding"), dims))
            found = near.found(names, arrow)
            yield pa.record_batch(list(found.values()), names=list(found))

        found = store.mapInArrow(stream, schema)
    else:
        pages, blocks = packed(store, page_rows, "page"), packed(queries, query_block, "block")
        found = _tiles(pages, blocks, dims, k, metric, schema, arrow, query_block, page_rows)
    best = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "distance")
