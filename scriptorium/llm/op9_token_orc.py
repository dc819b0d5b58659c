"""Token ids in ORC: run-length encoded integers, row indexes, Bloom filters on doc_id."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm.common import scratch_path, small_batches, table, word_bpe_path
from scriptorium.llm.tokens import encoder

_SCHEMA = "part int, seq long, doc_id long, start_in_part long, n_tokens long, ids array<int>"


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 2, stripe_bytes: int = 64 << 20) -> None:
    """Encode every text and write its ids to ORC files at ``path`` in ascending doc_id order.

    ``docs`` has doc_id and text; other columns are ignored. Rows are dealt by ranges of
    doc_id, sorted within each range and encoded where they lie, so file part-00000 ends
    before part-00001 begins. Each row holds the ids (run-length encoded by ORC), its
    place within its file and the number of ids before it there; doc_id has a Bloom
    filter, and the row index has its bounds for every 10,000 rows, so a reader skips the
    stripes that cannot hold a document.

    Null and empty texts give ``end_id`` alone; a null doc_id sorts first; equal doc_ids
    are all kept, ordered by a hash of the text; no rows, no part files with rows.
    """
    small_batches(docs.sparkSession)
    text = F.coalesce("text", F.lit(""))
    ranged = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("tie")).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")

    def encode(batches):
        part, seq, before = TaskContext.get().partitionId(), 0, 0
        enc, end = encoder(tokenizer_path), np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                found = [x + end for x in enc.encode(some.column("text").to_pylist())]
                n = np.array([len(x) // 4 for x in found], dtype=np.int64)
                starts = before + np.concatenate(([0], np.cumsum(n)[:-1]))
                ends = np.concatenate(([0], np.cumsum(n))).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(found), dtype="<i4")))
                rows = len(found)
                yield pa.record_batch([pa.array(np.full(rows, part, dtype=np.int32)), pa.array(np.arange(seq, seq + rows)), some.column("doc_id"), pa.array(starts), pa.array(n), ids], names=["part", "seq", "doc_id", "start_in_part", "n_tokens", "ids"])
                seq, before = seq + rows, before + int(n.sum())

    out = ranged.select("doc_id", "text").mapInArrow(encode, _SCHEMA)
    (out.write.option("orc.bloom.filter.columns", "doc_id").option("orc.stripe.size", stripe_bytes).option("orc.row.index.stride", 10_000).option("orc.compress", "ZSTD").orc(path))


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The rows of :func:`write_tokens` with ``start``: ids of all documents before each one.

    What each file holds comes from two of its columns only; the running totals over
    files are one row for each file.
    """
    rows = spark.read.schema(_SCHEMA).orc(path)
    files = sorted(rows.groupBy("part").agg(F.max(F.col("start_in_part") + F.col("n_tokens")).alias("n")).collect())
    total, before = 0, []
    for part, n in files:
        before.append((part, total))
        total += n
    offsets = spark.createDataFrame(before, "part int, before long")
    joined = rows.join(F.broadcast(offsets), "part")
    return joined.withColumn("start", F.col("before") + F.col("start_in_part"))


def token_digest(rows: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32, counted and summed from the ids that were read."""

    def digest(batches):
        for batch in batches:
            lists = batch.column("ids")
            lists = lists if isinstance(lists, pa.Array) else lists.combine_chunks()
            ends = lists.offsets.to_numpy()
            raw = memoryview(np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), dtype="<i4")).cast("B")
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            yield pa.record_batch([batch.column("doc_id"), batch.column("start"), pa.array(np.diff(ends).astype(np.int64)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.select("doc_id", "start", "ids").mapInArrow(digest, "doc_id long, start long, n_tokens long, ids_crc32 long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), path, word_bpe_path())
    return token_digest(read_tokens(spark, path))
