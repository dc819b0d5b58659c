"""Pages to chunks to the rows that retrieval keeps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.text import clean_text, reject_reason


def chunk_pages(pages: DataFrame) -> DataFrame:
    """(source, page, chunk_no, text): cleaned pages, split at blank lines. Cleaning drops those, so a page is a chunk.

    Cleaned lines are stripped, and so is a piece between blank lines. The Generate makes
    the text a column of its own, which rules then read without cleaning it again.
    """
    cut = pages.select("source", "page", F.posexplode(F.split(clean_text(F.col("text")), "\n\n")).alias("n", "text"))
    return cut.where("text != ''").select("source", "page", (F.col("n") + 1).alias("chunk_no"), "text")


def with_reason(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("reason", reject_reason(F.col("text")))


def kept_chunks(chunks: DataFrame) -> DataFrame:
    return with_reason(chunks).where("reason = 'ok'").drop("reason")


def with_ids(chunks: DataFrame) -> DataFrame:
    """chunk_id: a hash of what the chunk is, so that ingesting twice gives the same ids."""
    parts = F.concat_ws("|", "source", F.col("page").cast("string"), F.col("chunk_no").cast("string"), "text")
    return chunks.select(F.sha2(parts, 256).alias("chunk_id"), "source", "page", "chunk_no", "text")


def kept_by_source(pages: DataFrame) -> DataFrame:
    """(source, chunks): how many chunks of each source pass every rule, 0 too, in one pass over the pages.

    The outer generate keeps a page that has no text, so no second scan has to tell which
    sources there are; counts meet before the shuffle.
    """
    cut = pages.select("source", F.explode_outer(F.split(clean_text(F.col("text")), "\n\n")).alias("text"))
    kept = F.coalesce((F.col("text") != "") & (reject_reason(F.col("text")) == "ok"), F.lit(False))
    return cut.groupBy("source").agg(F.count_if(kept).alias("chunks"))


def papers_without_chunks(pages: DataFrame) -> DataFrame:
    return kept_by_source(pages).where("chunks = 0").select("source")


def ingest_totals(pages: DataFrame) -> DataFrame:
    """papers, papers_with_chunks, chunks."""
    return kept_by_source(pages).agg(F.count("*").alias("papers"), F.count_if(F.col("chunks") > 0).alias("papers_with_chunks"), F.coalesce(F.sum("chunks"), F.lit(0)).alias("chunks"))
