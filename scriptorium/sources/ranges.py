"""Rows in written ranges of a sort order, so that work in order of a key needs no task with all of a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.sources.scratch import scratch_path


def in_ranges(rows: DataFrame, *order: Column | str) -> DataFrame:
    """``rows`` with ``part``, numbers of ranges of ``order`` that Spark cuts by sampled quantiles.

    The table is written: ranges that are computed twice need not be cut at the same places.
    """
    at = scratch_path(rows.sparkSession, "ranges")
    dealt = rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id())
    dealt.write.parquet(at)
    return rows.sparkSession.read.schema(dealt.schema).parquet(at)


def several_parts(parts: DataFrame, *group: str) -> DataFrame:
    """Of one row for each group and part, those of groups in several parts: two for each range at most, and those between."""
    return parts.withColumn("_parts", F.count("*").over(Window.partitionBy(*group))).where("_parts > 1").drop("_parts")


def numbered_within(rows: DataFrame, group: str, *order: Column | str, name: str = "n") -> DataFrame:
    """``rows`` with ``name``, from 1 within each ``group`` in ``order``; a large group is several tasks'.

    Each range counts its own rows of a group and starts after those of earlier ranges.
    """
    dealt = in_ranges(rows, F.asc_nulls_first(group), *order)
    counts = dealt.groupBy(group, "part").agg(F.count("*").alias("_c"))
    earlier = Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = several_parts(counts, group).select(F.col(group).alias("_g"), F.col("part").alias("_p"), F.coalesce(F.sum("_c").over(earlier), F.lit(0)).alias("_start"))
    own = dealt.withColumn("_own", F.row_number().over(Window.partitionBy(group, "part").orderBy(*order)))
    joined = own.join(starts, F.col(group).eqNullSafe(F.col("_g")) & (F.col("part") == F.col("_p")), "left")
    return joined.withColumn(name, (F.coalesce("_start", F.lit(0)) + F.col("_own")).cast("long")).select(*rows.columns, name)
