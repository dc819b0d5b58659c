"""A cleaning pipeline over documents: quality, near duplicates, benchmark leaks, personal data, packing.

Each stage takes (spark, docs, sf_dir), with docs the rows that its predecessor kept,
and returns the columns of documents; the last returns the places in packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm.common import table, word_bpe_path, written
from scriptorium.llm.op2_packing import pack_documents
from scriptorium.llm.op5_quality import keep_good, remainder
from scriptorium.llm.op6_pii import redact
from scriptorium.llm.op8_minhash import drop_near_duplicates
from scriptorium.llm.op10_decontaminate import drop_contaminated


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go: those that it scores below 0.7.

    Null and empty texts are scored as texts without words; repeated rows share a score,
    and rows with null or repeated doc_ids are judged each by its own text.
    """
    labels = table(spark, sf_dir, "labels").where(remainder(4) != 2)
    return keep_good(docs, labels.select("doc_id", F.col("quality").cast("int").alias("label")))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: shingles of five words, similarity 0.8.

    Null and empty texts are like nothing and stay; of equal rows one stays; rows with null
    or repeated doc_ids are told apart by their texts.
    """
    return drop_near_duplicates(docs, width=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; null and empty texts stay, each row is judged by its own text."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def remove_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data become the names of their kinds; null and empty texts stay as they are, and so do all rows."""
    clean = redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else clean


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of 2048, filled by best-fit packing; a null text is an end mark alone, equal rows are packed each."""
    return pack_documents(docs, word_bpe_path())


STAGES = [
    ("quality", quality),
    ("near_duplicates", deduplicate),
    ("decontamination", decontaminate),
    ("personal_data", remove_personal_data),
    ("packing", pack),
]

#: Classifiers and sketches are not SQL; tests/llm/test_pipeline.py holds stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of all kept documents' pieces; an empty table gives no rows, columns beyond doc_id and text pass through the stages."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
