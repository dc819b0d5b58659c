"""Approximate nearest neighbours by inner product with randomly rotated one-bit codes.

A vector x of a cell with centre c is kept as the signs of its rotated residual
P(x - c), packed to bits, with two scalars: the residual's length and the cosine f between
the residual and its code. For a query q, <q, x> is then estimated as
<q, c> + |x - c| <Pq, code> / f, and the random rotation bounds the error: it stays within
``width`` |q| |x - c| sqrt((1 - f^2) / f^2 / (dims - 1)) with a probability that ``width``
sets (2.5: about 0.99 on the side that matters). A vector whose estimate plus bound
reaches the k-th best product so far is reranked on the original vectors.

Cells are pages of bounded size, written once. A block of queries first meets the pages
of its own cell; the k-th product found there rules out cells by their radius and vectors
by their bound in all other pages.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptorium.llm.common import table, written

#: Bytes of sampled vectors that the driver holds to fit centres.
SAMPLE_BYTES = 32 << 20
#: Bytes of original vectors in a page at most, about.
PAGE_BYTES = 8 << 20
RESULT = "query_id long, rank int, vec_id long, score double"


def usable(rows: DataFrame) -> DataFrame:
    """vec_id, embedding: one row for each vec_id (of several vectors the least) among vectors that are whole, finite and not all zeros."""
    v = F.col("embedding")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = F.col("vec_id").isNotNull() & v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0)
    return rows.where(good).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def _matrix(raw: list[bytes], dims: int, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(raw), dtype=kind).reshape(-1, dims)


def fit_centres(sample: np.ndarray, many: int, rounds: int = 8) -> np.ndarray:
    """``many`` centres of the sampled vectors, by a few rounds of k-means from evenly spaced ones."""
    centres = sample[np.linspace(0, len(sample) - 1, many).astype(int)].copy()
    for _ in range(rounds if many > 1 else 1):
        own = assign(sample, centres)
        for c in np.unique(own):
            centres[c] = sample[own == c].mean(axis=0)
    return centres


def assign(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each row."""
    return (x @ centres.T - (centres * centres).sum(axis=1) / 2).argmax(axis=1).astype(np.int32)


def rotation(dims: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def encode(x: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed signs of the rotated residuals, their lengths, and the cosines between residual and code."""
    rest = (x - centre) @ turn
    size = np.sqrt((rest * rest).sum(axis=1))
    cosine = np.abs(rest).sum(axis=1) / np.where(size > 0, size, 1) / np.sqrt(x.shape[1])
    return np.packbits(rest >= 0, axis=1), size, np.where(size > 0, cosine, 1.0)


def estimates(q: np.ndarray, bits: np.ndarray, size: np.ndarray, cosine: np.ndarray, centre: np.ndarray, turn: np.ndarray, width: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(queries x vectors) estimated products and by how much they may be too small, in units of the third, one a query."""
    dims = q.shape[1]
    length = np.sqrt((q * q).sum(axis=1))
    scale = size.max(initial=0) + np.sqrt((centre * centre).sum())
    signs = np.unpackbits(bits, axis=1, count=dims).astype(np.float32) * 2 - 1
    unit = q / length[:, None]
    near = ((unit @ turn).astype(np.float32) @ signs.T) * (size / scale / cosine / np.sqrt(dims)).astype(np.float32)
    near += (unit @ (centre / scale)).astype(np.float32)[:, None]
    slack = width * size / scale * np.sqrt(np.maximum(1 - cosine * cosine, 0) / (cosine * cosine) / max(1, dims - 1))
    # single precision: a little more than its rounding
    return near, (slack + 1e-5).astype(np.float32), length * scale


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Row by row, in double precision, component after component, so that equal vectors score alike everywhere."""
    return np.add.accumulate(q * x, axis=1)[:, -1]


def search_page(names: np.ndarray, q: np.ndarray, floors: np.ndarray, ids: np.ndarray, x: np.ndarray, near: np.ndarray, slack: np.ndarray, unit: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query number, vec_id, score) of each query's k best of a page among those at its floor or above."""
    own = names[:, None] == ids[None, :]
    near = np.where(own, -np.inf, near)
    floors = floors.copy()
    if len(ids) > k:  # the k best estimates give a first floor
        first = np.argpartition(near, len(ids) - k, axis=1)[:, len(ids) - k :]
        exact = np.sort(np.einsum("qd,qkd->qk", q, x[first]), axis=1)
        whole = ~np.isinf(np.take_along_axis(near, first, axis=1)).any(axis=1)
        floors[whole] = np.maximum(floors[whole], exact[whole, 0] - 1e-9 * (1 + np.abs(exact[whole, 0])))
    i, j = np.nonzero((near + slack >= (floors / unit)[:, None]) & ~own)
    got = np.concatenate([np.einsum("pd,pd->p", q[i[at : at + 65_536]], x[j[at : at + 65_536]]) for at in range(0, len(i), 65_536)] or [np.zeros(0)])
    keep = got >= floors[i] - 1e-9 * (1 + np.abs(floors[i]))
    i, j = i[keep], j[keep]
    score = products(q[i], x[j])
    order = np.lexsort((ids[j], -score, i))
    i, j, score = i[order], j[order], score[order]
    place = np.arange(len(i)) - np.searchsorted(i, i, "left")
    return i[place < k], ids[j[place < k]], score[place < k]


def nearest(rows: DataFrame, every: int = 20, k: int = 20, width: float = 2.5, cell_rows: int = 16_384, most_cells: int = 1024, sample_rows: int = 16_384, query_block: int = 256, lot: int = 8, seed: int = 13) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` largest inner products found for each vec_id divisible by ``every``.

    ``rows`` has vec_id (long) and embedding (array of float or double). Vectors that are
    null, all zeros, or hold a null or a number that is not finite, and rows without a
    vec_id take no part; rows that repeat a vec_id count once (with the least of their
    vectors); shorter vectors count as ending in zeros; fewer than ``k`` others give fewer
    rows; no rows give no rows; other columns are ignored. Ties go to the smaller vec_id.
    Components so large that products could leave double precision raise ValueError.

    Centres are fitted on ``sample_rows`` rows at most (and ``SAMPLE_BYTES``), of which
    there are at most ``most_cells``; every row is indexed. A cell of over twice ``cell_rows``
    is cut by hash into pages, so that no task holds more; query blocks are dealt to copies
    of a page ``lot`` at a time. ``width`` trades recall for reranking.
    """
    spark = rows.sparkSession
    kind = "<f4" if rows.schema["embedding"].dataType.elementType.simpleString() == "float" else "<f8"
    vectors = written(usable(rows), "vectors")
    many, dims, largest = vectors.agg(F.count("*"), F.max(F.size("embedding")), F.max(F.array_max(F.transform("embedding", F.abs)))).first()
    if not many:
        return spark.createDataFrame([], RESULT)
    if dims * largest > 1e150:
        raise ValueError(f"inner products leave double precision: components up to {largest:g}")
    item = np.dtype(kind).itemsize
    cell_rows = max(256, min(cell_rows, PAGE_BYTES // (item * dims)))
    sample_rows = max(1, min(sample_rows, SAMPLE_BYTES // (8 * dims)))

    def padded(lists: list) -> np.ndarray:
        out = np.zeros((len(lists), dims))
        for i, v in enumerate(lists):
            out[i, : len(v)] = v
        return out

    some = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).toArrow()
    centres = fit_centres(padded(some.column("embedding").to_pylist()), min(most_cells, sample_rows, -(-many // cell_rows)))
    held = spark.sparkContext.broadcast((centres, rotation(dims, seed)))

    def code(batches):
        centres, turn = held.value
        for batch in batches:
            x = padded(batch.column("embedding").to_pylist())
            cell = assign(x, centres) if len(x) else np.zeros(0, dtype=np.int32)
            bits, size, cosine = encode(x, centres[cell], turn)
            raw = lambda rows: pa.array([r.tobytes() for r in rows], pa.binary())
            yield pa.record_batch([batch.column("vec_id"), pa.array(cell), raw(x.astype(kind)), raw(bits), pa.array(size), pa.array(cosine)], names=["vec_id", "cell", "v", "bits", "size", "cosine"])

    coded = written(vectors.mapInArrow(code, "vec_id long, cell int, v binary, bits binary, size double, cosine double"), "codes")
    # one row a centre
    asked = F.count_if(F.col("vec_id") % every == 0)
    cells = {r["cell"]: (float(r["radius"]), -(-r["n"] // (2 * cell_rows)), -(-r["asked"] // query_block)) for r in coded.groupBy("cell").agg(F.max("size").alias("radius"), F.count("*").alias("n"), asked.alias("asked")).collect()}
    deal = spark.createDataFrame([(c, cuts, max(1, blocks)) for c, (_, cuts, blocks) in cells.items()], "cell int, cuts int, blocks int")
    dealt = coded.join(F.broadcast(deal), "cell")

    def pack(key: tuple, rows: pa.Table) -> pa.Table:
        whole = lambda name: b"".join(rows.column(name).to_pylist())
        plain = lambda name, to: rows.column(name).to_numpy().astype(to).tobytes()
        return pa.table({"cell": pa.array([key[0].as_py()], pa.int32()), "cut": pa.array([key[1].as_py()], pa.int32()), "ids": [plain("vec_id", "<i8")], "v": [whole("v")], "bits": [whole("bits")], "size": [plain("size", "<f8")], "cosine": [plain("cosine", "<f8")]})

    cut = F.pmod(F.xxhash64("vec_id"), F.col("cuts")).cast("int").alias("cut")
    pages = written(dealt.select("cell", cut, "vec_id", "v", "bits", "size", "cosine").groupBy("cell", "cut").applyInArrow(pack, "cell int, cut int, ids binary, v binary, bits binary, size binary, cosine binary"), "pages")

    def block(key: tuple, rows: pa.Table) -> pa.Table:
        floors = np.array([-np.inf if f is None else f for f in rows.column("floor").to_pylist()], dtype="<f8")
        return pa.table({"home": pa.array([key[0].as_py()], pa.int32()), "block": pa.array([key[1].as_py()], pa.int32()), "asked": [rows.column("vec_id").to_numpy().astype("<i8").tobytes()], "q": [b"".join(rows.column("v").to_pylist())], "floors": [floors.tobytes()]})

    which = F.pmod(F.xxhash64(F.col("vec_id") + 1), F.col("blocks")).cast("int").alias("block")
    queries = dealt.where(F.col("vec_id") % every == 0).select(F.col("cell").alias("home"), which, "vec_id", "v")
    packed = "home int, block int, asked binary, q binary, floors binary"
    lots = max(1, -(-sum(b for _, _, b in cells.values()) // lot))

    def route(home: bool):
        def run(batches):
            centres, _ = held.value
            for batch in batches:
                for r in batch.to_pylist():
                    q, floors = _matrix([r["q"]], dims, kind).astype(np.float64), np.frombuffer(r["floors"], dtype="<f8")
                    length = np.sqrt((q * q).sum(axis=1))
                    go = [c for c, (radius, _, _) in cells.items() if (c == r["home"]) == home and (home or ((q @ centres[c] + length * radius) * (1 + 1e-9) + 1e-9 >= floors).any())]
                    to = [(c, cut) for c in go for cut in range(cells[c][1])]
                    out = {n: pa.array([r[n]] * len(to), batch.schema.field(n).type) for n in ("home", "block", "asked", "q", "floors")}
                    yield pa.record_batch([*out.values(), pa.array([c for c, _ in to], pa.int32()), pa.array([c for _, c in to], pa.int32())], names=[*out, "cell", "cut"])

        return run

    def search(key: tuple, page: pa.Table, asked: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if page.num_rows:
            centres, turn = held.value
            p = page.to_pylist()[0]
            ids, x = np.frombuffer(p["ids"], dtype="<i8"), _matrix([p["v"]], dims, kind).astype(np.float64)
            bits = np.frombuffer(p["bits"], dtype=np.uint8).reshape(len(ids), -1)
            size, cosine = np.frombuffer(p["size"], dtype="<f8"), np.frombuffer(p["cosine"], dtype="<f8")
            for r in asked.to_pylist():
                names, q, floors = np.frombuffer(r["asked"], dtype="<i8"), _matrix([r["q"]], dims, kind).astype(np.float64), np.frombuffer(r["floors"], dtype="<f8")
                for at in range(0, len(names), 128):
                    s = slice(at, at + 128)
                    i, vec, score = search_page(names[s], q[s], floors[s], ids, x, *estimates(q[s], bits, size, cosine, centres[p["cell"]], turn, width), k)
                    found.append((names[s][i], vec, score))
        columns = [np.concatenate([f[n] for f in found] or [np.zeros(0)]) for n in range(3)]
        return pa.table({"query_id": pa.array(columns[0].astype(np.int64)), "vec_id": pa.array(columns[1].astype(np.int64)), "score": pa.array(columns[2].astype(np.float64))})

    def answers(asked: DataFrame, home: bool) -> DataFrame:
        blocks = asked.groupBy("home", "block").applyInArrow(block, packed)
        routed = written(blocks.mapInArrow(route(home), packed + ", cell int, cut int").withColumn("lot", F.pmod(F.xxhash64("home", "block"), F.lit(lots)).cast("int")), "routed")
        key = ["cell", "cut", "lot"]
        copies = pages.join(routed.select(*(F.col(c).alias(c) for c in key)).distinct(), ["cell", "cut"])
        return copies.groupBy(*key).cogroup(routed.groupBy(*key)).applyInArrow(search, "query_id long, vec_id long, score double")

    near = written(answers(queries.withColumn("floor", F.lit(None).cast("double")), True), "near")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    floors = near.withColumn("r", F.row_number().over(best)).where(F.col("r") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("floor"))
    rest = answers(queries.join(floors, "vec_id", "left"), False) if len(cells) > 1 else near.limit(0)
    found = near.unionByName(rest).withColumn("rank", F.row_number().over(best))
    return found.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
