"""Benchmark items inside long documents: size-partitioned MinHash containment, then exact check.

Items are partitioned by the size of their shingle sets, each size class up to twice
the one before. An item's sketch is the bottom of its set in MinHash order; its length
follows from the class bound, so that a document holding 80 % of the item must hold a
stated number of the sketch's shingles (it can miss no more than 20 % of the item).
Long documents need no sketch of their own, which would lose a short item. Only
built-in functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm.common import small, table, text_key, unused, written


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits; none for a null."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _with_words(rows: DataFrame, *keys: str) -> DataFrame:
    """Words as a column of their own, so that they are cut once and not for each shingle."""
    return rows.select(*keys, words(F.col("text")).alias("ws"))


def _windows(ws: Column, width: int, of, short: tuple[int, ...] = ()) -> Column:
    """``of`` each run of ``width`` words, and of each of the ``short`` lengths; of the whole sequence where there are fewer; none without words."""
    n = F.size(ws)
    runs = lambda size: F.transform(F.sequence(F.lit(0), n - size), lambda i: of(*(F.get(ws, i + k) for k in range(size))))
    none = F.array().cast(f"array<{'long' if of is F.xxhash64 else 'string'}>")
    whole = F.when(n >= width, runs(width)).when(n > 0, F.array(of(*(F.get(ws, F.lit(k)) for k in range(width))))).otherwise(none)
    return F.concat(whole, *(F.when(n > size, runs(size)).otherwise(none) for size in short)) if short else whole


def _hashes(ws: Column, width: int, short: tuple[int, ...] = ()) -> Column:
    return _windows(ws, width, F.xxhash64, short)


def _texts(ws: Column, width: int, short: tuple[int, ...] = ()) -> Column:
    return _windows(ws, width, lambda *w: F.concat_ws(" ", *w), short)


def _short_lengths(items: DataFrame, width: int) -> tuple[int, ...]:
    """Numbers of words below ``width`` that items have: at most ``width`` - 1 rows."""
    n = F.size(words(F.col("text")))
    return tuple(sorted(r["n"] for r in items.select(n.alias("n")).where((F.col("n") > 0) & (F.col("n") < width)).distinct().collect()))


def sketches(items: DataFrame, width: int, percent: int) -> DataFrame:
    """Rows (item_id, h, need): an item's sketch, and how much of it a match must hold.

    With q shingles in the class up to u, a match misses at most m = q * (100 - percent)
    // 100 of them. The sketch has twice the class's largest m, and one more, so at
    least its length less m of it is in every match.
    """
    sets = _with_words(items, "item_id").select("item_id", F.array_sort(F.array_distinct(_hashes(F.col("ws"), width))).alias("s")).where(F.size("s") > 0)
    q = F.size("s")
    bound = F.pow(F.lit(2.0), F.ceil(F.log2(q.cast("double")))).cast("int")
    length = F.least(q, F.floor(2 * bound * (100 - percent) / 100).cast("int") + 1)
    missed = F.floor(q * (100 - percent) / 100).cast("int")
    return sets.select("item_id", F.explode(F.slice("s", 1, length)).alias("h"), (length - missed).alias("need"))


def _contained(docs: DataFrame, keys: list[str], items: DataFrame, width: int, percent: int) -> DataFrame:
    """As :func:`contained_items`, for documents that ``keys`` tell apart; the first may be null."""
    short = _short_lengths(items, width)
    sketch = written(sketches(items, width, percent).dropDuplicates(["item_id", "h"]), "sketch").withColumnRenamed("h", "shingle_hash")
    shingles = _with_words(docs, *keys).select(*keys, F.explode(_hashes(F.col("ws"), width, short)).alias("shingle_hash"))
    hits = shingles.join(small(sketch), "shingle_hash").distinct()
    found = written(hits.groupBy(*keys, "item_id").agg(F.count("*").alias("n"), F.min("need").alias("need")).where("n >= need").select(*keys, "item_id"), "candidates")

    # exact: the shingles themselves, of candidates only
    of_items = _with_words(items.join(found.select("item_id").distinct(), "item_id", "left_semi"), "item_id").select("item_id", F.explode(F.array_distinct(_texts(F.col("ws"), width))).alias("shingle")).distinct()
    of_items = written(of_items, "item-shingles")
    sizes = of_items.groupBy("item_id").agg(F.count("*").alias("n_item"))
    ids = written(found.select(*(F.col(k).alias(f"{k}_found") for k in keys)).distinct(), "found")
    same = [F.col(k).eqNullSafe(F.col(f"{k}_found")) for k in keys]
    of_docs = _with_words(docs.join(small(ids), same, "left_semi"), *keys).select(*keys, F.explode(F.array_distinct(_texts(F.col("ws"), width, short))).alias("shingle"))
    shared = of_docs.join(small(of_items), "shingle").distinct().groupBy(*keys, "item_id").agg(F.count("*").alias("n_shared"))
    out = shared.join(sizes, "item_id").where(100 * F.col("n_shared") >= percent * F.col("n_item"))
    return out.select(*keys, "item_id", "n_item", "n_shared", (F.col("n_shared") / F.col("n_item")).alias("containment"))


def contained_items(docs: DataFrame, items: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, item_id, n_item, n_shared, containment) where a document holds at least ``percent`` % of an item.

    Containment is the share of the item's distinct ``width``-word shingles that are in
    the document's; a text of fewer words has its whole sequence as one shingle. An item of
    fewer words is looked for as a run of so many words anywhere in a document. Texts
    without words, null or empty, match nothing. Rows that repeat an item are one item;
    rows that repeat a doc_id are one document, as are null doc_ids; items with a null
    item_id are left out. Whole texts are
    used; no rows give no rows; other columns are ignored.
    """
    return _contained(docs.select("doc_id", "text"), ["doc_id"], items, width, percent)


def drop_contaminated(docs: DataFrame, items: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns.

    Each row is judged by its own text, also where doc_ids are null or repeat; null and
    empty texts stay. Columns may have any names; no rows give no rows.
    """
    own = docs.select("doc_id", text_key().alias("text_key"), "text")
    i, h = unused(docs, "doc_key"), unused(docs, "text_key_")
    found = _contained(own, ["doc_id", "text_key"], items, width, percent).select(F.col("doc_id").alias(i), F.col("text_key").alias(h)).distinct()
    return docs.join(small(written(found, "contaminated")), [F.col("doc_id").eqNullSafe(F.col(i)), text_key() == F.col(h)], "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS ws FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS ws FROM benchmark),
ds AS (SELECT DISTINCT doc_id, unnest(list_concat(CASE WHEN len(ws) > 4 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) ELSE [] END,
  flatten(list_transform((SELECT coalesce(list(DISTINCT len(ws)) FILTER (len(ws) BETWEEN 1 AND 4), []) FROM b), lambda k: list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' ')))))) AS s FROM d),
bs AS (SELECT DISTINCT item_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
  ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS s FROM b),
n AS (SELECT item_id, count(*) AS n_item FROM bs GROUP BY 1),
c AS (SELECT doc_id, item_id, count(*) AS n_shared FROM ds JOIN bs USING (s) GROUP BY 1, 2)
SELECT doc_id, item_id, n_item, n_shared, n_shared / n_item AS containment FROM c JOIN n USING (item_id)
WHERE 100 * n_shared >= 80 * n_item
"""
