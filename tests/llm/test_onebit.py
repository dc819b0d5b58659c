"""One-bit codes against brute force: recall, exact scores, odd rows, bounds."""

import numpy as np
import pytest

from scriptorium.llm import op13_onebit as O

ROWS = "vec_id long, embedding array<float>, label int"


def brute(rows, every=20, k=20):
    """(query_id, rank, vec_id, score) by comparing every pair; rows: {vec_id: list}."""
    dims = max(map(len, rows.values()), default=0)
    x = {i: np.array([*map(float, np.float32(v)), *[0.0] * (dims - len(v))]) for i, v in rows.items()}
    out = []
    for q in x:
        if q % every == 0:
            near = sorted((-float(np.add.accumulate(x[q] * x[i])[-1]), i) for i in x if i != q)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(near)]
    return sorted(out)


def test_registered_query(spark, sf):
    found = [tuple(r) for r in O.query(spark, sf).select("query_id", "rank", "vec_id", "score").collect()]
    table = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    wanted = brute(table)
    assert len(found) == len(wanted)
    near = {(q, i): s for q, _, i, s in wanted}
    hits = [(q, i) for q, _, i, _ in found if (q, i) in near]
    assert len(hits) >= 0.98 * len(wanted)
    assert all(s == near[q, i] for q, _, i, s in found if (q, i) in near)  # not nearly: exactly


def test_cells_cuts_and_lots(spark):
    """Clusters with a third of all rows in one, equal vectors, several pages a cell and lots a page."""
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((6, 24)) * 3
    own = np.where(np.arange(1500) % 3 == 0, 0, np.arange(1500) % 6)
    x = (centres[own] + rng.standard_normal((1500, 24))).astype(np.float32)
    x[100:140] = x[100]
    table = {i: v.tolist() for i, v in enumerate(x)}
    rows = spark.createDataFrame([(i, v, 0) for i, v in table.items()], ROWS)
    found = [tuple(r) for r in O.nearest(rows, cell_rows=256, query_block=8, lot=2).collect()]
    wanted = brute(table)
    assert len(found) == len(wanted)
    assert len({f[:1] + f[2:] for f in found} & {w[:1] + w[2:] for w in wanted}) >= 0.98 * len(wanted)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0], 1), (1, None, 1), (2, [0.0, 0.0], 1), (3, [nan, 1.0], 1), (4, [inf, 1.0], 1), (5, [1.0, None], 1), (None, [1.0, 1.0], 1), (6, [3.0], 1), (7, [3.0, 0.0], 1), (8, [], 1), (20, [-1.0, 0.0], 1), (20, [-1.0, 0.0], 2)]
    frame = spark.createDataFrame(rows, ROWS).selectExpr("*", "1 AS score", "2 AS cell", "3 AS query_id")
    found = sorted(tuple(r) for r in O.nearest(frame).collect())
    assert found == brute({0: [1.0, 2.0], 6: [3.0], 7: [3.0, 0.0], 20: [-1.0, 0.0]})
    assert O.nearest(frame.limit(0)).collect() == []
    assert O.nearest(frame.where("vec_id = 0")).collect() == []
    huge = spark.createDataFrame([(0, [1e200]), (1, [1e200])], "vec_id long, embedding array<double>")
    with pytest.raises(ValueError, match="double precision"):
        O.nearest(huge)


def test_estimates_stay_within_their_bounds():
    rng = np.random.default_rng(5)
    x, q = rng.standard_normal((4000, 48)), rng.standard_normal((50, 48))
    centre, turn = x.mean(axis=0), O.rotation(48, 1)
    bits, size, cosine = O.encode(x, centre, turn)
    assert bits.shape == (4000, 6) and np.allclose(turn @ turn.T, np.eye(48))
    near, slack, unit = O.estimates(q, bits, size, cosine, centre, turn, 2.5)
    error = (q @ x.T) / unit[:, None] - near
    assert abs(error.mean()) < 0.01 and (error > slack).mean() < 0.02
    # the bound is worth something: it leaves most vectors out of reranking
    tenth = np.sort(q @ x.T, axis=1)[:, -20] / unit
    assert (near + slack >= tenth[:, None]).mean() < 0.35
    same = O.encode(np.repeat(centre[None], 3, axis=0), centre, turn)
    near, _, unit = O.estimates(q, *same, centre, turn, 2.5)
    assert np.allclose(near * unit[:, None], (q @ centre)[:, None], rtol=1e-4, atol=1e-4)
