"""Papers, pages and the chunk store."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.sources.ranges import numbered_within
from scriptorium.sources.scratch import scratch_path


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` of a table with fewer splits than the session has cores, dealt over all of them; larger tables stay as they are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def list_papers(spark: SparkSession, path: str) -> DataFrame:
    """path, title, length, modified of the PDF files below a folder (or of one file); contents are not read.

    A folder that is missing or has no papers gives no rows; one that cannot be read raises.
    """
    try:
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]").load(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "path string, title string, length long, modified timestamp")
    return files.select("path", F.element_at(F.split("path", r"[\\/]"), -1).alias("title"), "length", F.col("modificationTime").alias("modified"))


def pages_from_documents(docs: DataFrame, lines_per_page: int = 10) -> DataFrame:
    """(source, page, text): pages of so many lines each, from page 1; null texts have none. No shuffle."""
    lines = docs.where("text IS NOT NULL").select(F.col("doc_id").cast("string").alias("source"), F.split("text", "\n").alias("lines"))
    starts = F.sequence(F.lit(1), F.size("lines"), F.lit(lines_per_page))
    cut = lines.select("source", "lines", F.posexplode(starts).alias("p", "first"))
    return cut.select("source", (F.col("p") + 1).alias("page"), F.array_join(F.slice("lines", F.col("first"), F.lit(lines_per_page)), "\n").alias("text"))


def pages_from_html(pages: DataFrame) -> DataFrame:
    """(source, page, page_id, text): a host's pages in order of page_id.

    Hosts are numbered in ranges of (host, page_id) that are cut where the pages are, so
    neither a large host nor outlying ids make a large task. Null urls share a null host;
    of null page_ids, all come first; equal ones in order of their text.
    """
    host = F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1)
    rows = pages.select(host.alias("source"), "page_id", F.col("html").alias("text"))
    numbered = numbered_within(rows, "source", F.asc_nulls_first("page_id"), F.asc_nulls_first("text"), name="page")
    return numbered.select("source", F.col("page").cast("int").alias("page"), "page_id", "text")


def full_text(pages: DataFrame, run: int = 64) -> DataFrame:
    """(source, full_text, prompt_text): pages in order, plain and under page marks.

    Runs of ``run`` pages are joined first, so a source with very many pages is many tasks'
    until its runs are joined.
    """
    marked = lambda x: F.concat(F.lit("===== PAGE "), x["page"].cast("string"), F.lit(" =====\n"), x["text"])
    runs = pages.groupBy("source", F.floor((F.col("page") - 1) / run).alias("run")).agg(F.array_sort(F.collect_list(F.struct("page", "text"))).alias("p"))
    runs = runs.select("source", F.struct("run", F.array_join(F.transform("p", lambda x: x["text"]), "").alias("plain"), F.array_join(F.transform("p", marked), "\n\n").alias("marked")).alias("r"))
    whole = runs.groupBy("source").agg(F.array_sort(F.collect_list("r")).alias("r"))
    return whole.select("source", F.array_join("r.plain", "").alias("full_text"), F.array_join("r.marked", "\n\n").alias("prompt_text"))


#: Hex digits of a chunk_id that name its folder in a store.
STORE_DIGITS = 1


def append_chunks(chunks: DataFrame, path: str, once: bool = True, batch: str | None = None) -> None:
    """Add chunks to the Parquet store at ``path``; with ``once``, none whose chunk_id is there already.

    The store lies in folders by the first hex digits of chunk_id. Only folders that the
    new chunks touch are read to tell which are there, one column of them. A ``batch`` that
    the store's ledger names was appended before and is not looked at again; a batch that
    failed before it got there is appended again, and ``once`` keeps it single.
    """
    spark = chunks.sparkSession
    if batch is not None and batch in _ledger(spark, path):
        return
    fresh = (chunks.dropDuplicates(["chunk_id"]) if once else chunks).withColumn("folder", F.substring("chunk_id", 1, STORE_DIGITS))
    if once and store_exists(spark, path):
        at = scratch_path(spark, "append")
        fresh.write.parquet(at)
        fresh = spark.read.schema(fresh.schema).parquet(at)
        touched = [r["folder"] for r in fresh.select("folder").distinct().collect()]  # 16 to the digits at most
        there = spark.read.schema("chunk_id string, folder string").parquet(path).where(F.col("folder").isin(touched))
        fresh = fresh.join(there, ["folder", "chunk_id"], "left_anti").select(*fresh.columns)
    fresh.repartition("folder", F.pmod(F.xxhash64("chunk_id"), F.lit(8))).write.mode("append").partitionBy("folder").parquet(path)
    if batch is not None:
        spark.createDataFrame([(batch,)], "batch string").coalesce(1).write.mode("append").parquet(f"{path}/_ledger")


def _ledger(spark: SparkSession, path: str) -> set[str]:
    """Names of the batches that were appended."""
    try:
        return {r["batch"] for r in spark.read.schema("batch string").parquet(f"{path}/_ledger").collect()}
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return set()


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """The chunks of a store, without the folders' names."""
    return spark.read.parquet(path).drop("folder")


def store_exists(spark: SparkSession, path: str) -> bool:
    """Whether Spark can read a table at ``path``, on any file system."""
    try:
        spark.read.parquet(path)
    except AnalysisException:
        return False
    return True


def reset_store(spark: SparkSession, path: str, schema: str = "chunk_id string, source string, page int, chunk_no int, text string") -> None:
    """Leave an empty store without a ledger; also where there was none."""
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)


def require_papers(papers: DataFrame, path: str) -> DataFrame:
    """``papers`` (of :func:`list_papers`) itself; raises where ``path`` is no paper and holds none."""
    if papers.isEmpty():
        raise ValueError(f"{path} is neither a PDF file nor a folder with any")
    return papers


def require_non_empty(df: DataFrame, what: str = "the store") -> DataFrame:
    """df itself; raises if it has no rows (reads one row at most)."""
    if df.isEmpty():
        raise ValueError(f"{what} has no rows; ingest first")
    return df
