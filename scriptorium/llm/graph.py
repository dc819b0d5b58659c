"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import written


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Point the neighbours u of each node at its smallest neighbour.

    links: (u, v) with u > v. The large star points the larger neighbours, the small star
    the smaller ones and the node itself.
    """
    if large:
        near = links.select(F.col("u").alias("n"), F.col("v").alias("o")).unionByName(links.select(F.col("v").alias("n"), F.col("u").alias("o")))
        least = near.groupBy("n").agg(F.min("o").alias("m")).select("n", F.least("n", "m").alias("m"))
        out = near.where(F.col("o") > F.col("n")).join(least, "n").select(F.col("o").alias("u"), F.col("m").alias("v"))
    else:
        least = links.groupBy("u").agg(F.min("v").alias("m"))
        out = links.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where(F.col("u") > F.col("v")).distinct()


def components(links: DataFrame, rows: int | None = None, most_rounds: int = 40) -> DataFrame:
    """(u, v): each linked node u other than its component's smallest node v.

    links: any pairs (u, v) of one comparable type, about ``rows``; loops, repeats and
    either order are fine, and no links give no rows. Every round is written to the shared folder. It ends when a round changes
    nothing; the number of rounds grows with the logarithm of the longest chain.
    """
    now = written(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where(F.col("u") > F.col("v")).distinct(), "links", rows=rows)
    mark = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003)).first()
    before = mark(now)
    for _ in range(most_rounds):
        if not before[0]:
            return now
        now = written(_star(_star(now, large=True), large=False), "links", rows=before[0])
        if (after := mark(now)) == before:
            return now
        before = after
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
