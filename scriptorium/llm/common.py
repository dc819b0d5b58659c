"""What the operators share: written tables, small ones, slices of texts, default paths."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.sources.papers import scratch_path, spread

#: Rows of a handful of numbers that are broadcast at most; beyond it they meet others by shuffle.
BROADCAST_ROWS = 1_000_000
#: Rows of a file, where a table's size is known before it is written.
FILE_ROWS = 8_192
#: Rows that Spark hands to Python at a time where they hold texts.
BATCH_ROWS = 1_000


def written(df: DataFrame, name: str, compression: str = "snappy", rows: int | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage, survives lost executors.

    ``rows``, about how many there are, keeps small tables out of very many small files:
    a task takes ``FILE_ROWS`` rows or more where the plan has more tasks than that.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df = df if rows is None else df.coalesce(max(2, -(-rows // FILE_ROWS)))
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, most: int | None = None) -> DataFrame:
    """A written table of short rows, marked for broadcast if it has no more than ``most`` rows."""
    return F.broadcast(df) if df.count() <= (BROADCAST_ROWS if most is None else most) else df


def small_batches(spark: SparkSession) -> None:
    """Lower the session's rows a batch to ``BATCH_ROWS``, so that batches of texts stay small in JVM and Python."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if not 0 < now <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def text_slices(batch: pa.RecordBatch, most: int = 250_000, rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Runs of at most ``rows`` rows with at most ``most`` characters of ``text``, or one longer row."""
    lengths = pc.fill_null(pc.utf8_length(batch.column("text")), 0).to_pylist()
    at = 0
    while at < len(lengths):
        end, size = at, 0
        while end < len(lengths) and (end == at or size + lengths[end] <= most) and end - at < rows:
            size += lengths[end]
            end += 1
        yield batch.slice(at, end - at)
        at = end


def unused(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_key(text: str = "text") -> F.Column:
    """A 64-bit hash that, with the doc_id, names a row's document where doc_ids repeat."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")), F.col(text).isNull())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def word_bpe_path() -> str:
    """The public vocabulary file that the queries use; operators take any path."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def agreed(labels: DataFrame) -> DataFrame:
    """(doc_id, label): one row for each doc_id whose labels, 0 or 1, all agree; nulls say nothing."""
    some = labels.where("doc_id IS NOT NULL AND label IN (0, 1)").groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("other"))
    return some.where("label = other").drop("other")
