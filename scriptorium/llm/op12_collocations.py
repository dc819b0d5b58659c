"""Phrase collocations per language, counted exactly with counting quotient filters.

Only words that occur often enough can be part of a candidate, so they alone get ids;
texts become runs of ids, and n-grams are counted level by level. Each task keeps its
n-grams in filters (:mod:`scriptorium.llm.quotient`), which are split into shards by the
first bits of the quotient; a shard's filters, sorted as they are, are merged in one
task. An n-gram of a next level is counted only if both of its halves without an end word
may be frequent, by a bitmap of bounded size: what the bitmap lets through wrongly costs
time and changes no count.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptorium.llm import quotient as Q
from scriptorium.llm.common import small, small_batches, table, text_slices, written

#: Words whose ids every task holds at most; rarer ones meet texts by shuffle.
HELD_WORDS = 1_000_000
#: Bits of the largest bitmap of frequent phrases.
BITMAP_BITS = 27
#: Bytes of text that are cut into words at a time.
SLICE = 4 << 20
#: Words of texts for each shard of filters, about.
SHARD_WORDS = 1 << 21
#: A word id that is not in the table every task holds (only while rarer words are looked up).
_RARE = -1
# a full stop cannot be part of a word: it stands for every mark between pieces
_MARKS = bytes.maketrans(b".,;:!?\n\x0b\x0c\r\t", b".......... ")
_BREAK = b"."
_BLANK = re.compile(rb"[ .]")


def tokens(text: str | None) -> Iterator[list[bytes]]:
    """Words of a text in small letters (A-Z only), ``.`` between pieces; long texts in slices that end between words."""
    data = (text or "").encode().lower().translate(_MARKS)
    at = 0
    while at < len(data):
        end = len(data)
        if end - at > SLICE:
            gap = _BLANK.search(data, at + SLICE)
            end = gap.end() if gap else end
        yield data[at:end].replace(b".", b" . ").split()
        at = end


def count_words(docs: DataFrame) -> DataFrame:
    """(lang, word, n): occurrences of each word, and those of all words where word is null."""

    def run(batches):
        held: dict[str, Counter] = {}
        size = 0

        def out():
            for lang, counter in held.items():
                counter.pop(_BREAK, None)
                words = list(counter)
                for at in range(0, len(words), 50_000):
                    some = words[at : at + 50_000]
                    yield pa.record_batch([pa.array([lang] * len(some)), pa.array([w.decode() for w in some]), pa.array([counter[w] for w in some], pa.int64())], names=["lang", "word", "n"])
                yield pa.record_batch([pa.array([lang]), pa.array([None], pa.string()), pa.array([sum(counter.values())], pa.int64())], names=["lang", "word", "n"])
            held.clear()

        for batch in batches:
            for some in text_slices(batch):
                for lang, text in zip(some.column("lang").to_pylist(), some.column("text").to_pylist(), strict=True):
                    for words in tokens(text):
                        held.setdefault(lang, Counter()).update(words)
                        size += len(words)
                        if size > 4_000_000 or sum(map(len, held.values())) > 400_000:
                            yield from out()
                            size = 0
        yield from out()

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def vocabulary(counts: DataFrame) -> DataFrame:
    """(id, lang, word, n): ids from 1 without gaps, by place in a written table."""
    at = F.monotonically_increasing_id()
    rows = written(counts.select("lang", "word", "n", at.alias("place")), "words")
    part = F.shiftright("place", 33)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # one row a file of the table
    starts = rows.groupBy(part.alias("part")).agg(F.count("*").alias("many")).select("part", F.coalesce(F.sum("many").over(before), F.lit(0)).alias("start"))
    in_part = F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    return written(rows.withColumn("part", part).join(F.broadcast(starts), "part").select((F.col("start") + in_part + 1).alias("id"), "lang", "word", "n"), "vocabulary")


def encode(docs: DataFrame, words: DataFrame, many: int, most: int) -> DataFrame:
    """(ids): each text as 64-bit word ids, 0 for pieces' ends and words without an id.

    At most ``most`` of the ``many`` words, the commonest, are handed to every task; rarer
    ones are looked up by a join, in which none of them can be a hot key.
    """
    spark = docs.sparkSession
    common = words if many <= most else words.orderBy(F.desc("n"), "id").limit(most)
    listed = common.select("lang", "word", "id").toArrow()  # ``most`` rows at most
    held: dict[str, tuple[list[bytes], list[int]]] = {}
    for lang, word, i in zip(*(listed.column(c).to_pylist() for c in ("lang", "word", "id")), strict=True):
        some = held.setdefault(lang, ([], []))
        some[0].append(word.encode())
        some[1].append(i)
    shared = spark.sparkContext.broadcast(held)
    rare = many > most

    def run(batches):
        ids = {lang: dict(zip(*lists, strict=True)) for lang, lists in shared.value.items()}
        other = {lang: {**d, _BREAK: 0} for lang, d in ids.items()}
        missing = _RARE if rare else 0
        for batch in batches:
            for some in text_slices(batch):
                rows, unknown = [], []
                for lang, text in zip(some.column("lang").to_pylist(), some.column("text").to_pylist(), strict=True):
                    get, parts, left, at = other.get(lang, {_BREAK: 0}).get, [], [], 0
                    for words in tokens(text):
                        found = np.fromiter(map(get, words, repeat(missing)), dtype=np.int64, count=len(words))
                        if rare:
                            left += [(at + int(j), words[j].decode()) for j in np.flatnonzero(found == _RARE)]
                        at += len(found)
                        parts.append(found)
                    whole = np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)
                    rows.append(whole if rare else tight(whole))
                    unknown.append(left)
                arrays = [pa.array([r.astype("<i8").tobytes() for r in rows], pa.binary())]
                if rare:
                    spots = pa.array([[{"at": a, "word": w} for a, w in left] for left in unknown], pa.list_(pa.struct([("at", pa.int64()), ("word", pa.string())])))
                    arrays += [some.column("lang"), spots]
                yield pa.record_batch(arrays, names=["ids", "lang", "spots"][: len(arrays)])

    small_batches(spark)
    if not rare:
        return written(docs.mapInArrow(run, "ids binary").where(F.length("ids") > 8), "encoded")
    rows = docs.mapInArrow(run, "ids binary, lang string, spots array<struct<at: bigint, word: string>>")
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "half")
    spots = rows.select("row", "lang", F.explode("spots").alias("s")).select("row", "lang", "s.at", "s.word")
    known = spots.join(words.select("lang", "word", "id"), ["lang", "word"]).groupBy("row").agg(F.collect_list(F.struct("at", "id")).alias("known"))

    def patch(batches):
        for batch in batches:
            out = []
            for raw, known in zip(batch.column("ids").to_pylist(), batch.column("known").to_pylist(), strict=True):
                ids = np.frombuffer(raw, dtype="<i8").copy()
                ids[ids == _RARE] = 0
                for k in known or ():
                    ids[k["at"]] = k["id"]
                out.append(tight(ids).astype("<i8").tobytes())
            yield pa.record_batch([pa.array(out, pa.binary())], names=["ids"])

    return written(rows.select("row", "ids").join(known, "row", "left").select("ids", "known").mapInArrow(patch, "ids binary").where(F.length("ids") > 8), "encoded")


def tight(ids: np.ndarray) -> np.ndarray:
    """Ids without words that stand alone between zeros, and one zero where there were several."""
    some = ids != 0
    beside = np.zeros(len(ids), dtype=bool)
    beside[:-1] |= some[1:]
    beside[1:] |= some[:-1]
    ids = np.where(some & beside, ids, 0)
    keep = ids != 0
    keep[1:] |= ids[:-1] != 0
    return ids[keep]


def _spots(columns: list[np.ndarray], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Two bits of a bitmap of 2**size bits for each row."""
    h = Q.mixed(columns)
    mask = np.uint64((1 << size) - 1)
    return h & mask, (h >> np.uint64(32)) & mask


def bitmap(phrases: DataFrame, many: int, n: int, bits: int, most: int = BITMAP_BITS) -> tuple[int, np.ndarray]:
    """(size, words of 64 bits): a bitmap of 2**size bits, ``most`` at most, that has every one of the phrases."""
    size = min(most, max(10, (16 * many).bit_length()))

    def run(batches):
        for batch in batches:
            ids = np.array(batch.column("ids").to_pylist(), dtype=np.int64).reshape(-1, n)
            both = np.concatenate(_spots(Q.pack(list(ids.T), bits), size))
            slot, at = np.unique(both >> np.uint64(6), return_inverse=True)
            word = np.zeros(len(slot), dtype=np.uint64)
            np.bitwise_or.at(word, at, np.uint64(1) << (both & np.uint64(63)))
            yield pa.record_batch([pa.array(slot.astype(np.int64)), pa.array(word.view(np.int64))], names=["slot", "word"])

    # at most 2**(most - 6) rows
    rows = phrases.select("ids").mapInArrow(run, "slot long, word long").groupBy("slot").agg(F.bit_or("word").alias("word")).toArrow()
    out = np.zeros(1 << (size - 6), dtype=np.uint64)
    out[rows.column("slot").to_numpy()] = rows.column("word").to_numpy().view(np.uint64)
    return size, out


def grams(ids: np.ndarray, n: int, bits: int, seen: tuple[int, np.ndarray] | None) -> list[np.ndarray]:
    """Packed n-grams of a run of ids that hold no zero and whose shorter parts ``seen`` lets through."""
    ends = len(ids) - n + 1
    if ends < 1:
        return Q.pack([ids[:0]] * n, bits)
    good = np.logical_and.reduce([ids[i : i + ends] != 0 for i in range(n)])
    if seen is not None:
        size, words = seen
        shorter = np.flatnonzero(np.logical_and.reduce([ids[i : i + ends + 1] != 0 for i in range(n - 1)]))
        fine = np.zeros(ends + 1, dtype=bool)
        a, b = _spots(Q.pack([ids[shorter + i] for i in range(n - 1)], bits), size)
        bit = lambda s: (words[s >> np.uint64(6)] >> (s & np.uint64(63))) & np.uint64(1)
        fine[shorter] = (bit(a) & bit(b)) != 0
        good &= fine[:-1] & fine[1:]
    at = np.flatnonzero(good)
    return Q.pack([ids[at + i] for i in range(n)], bits)


def count_phrases(encoded: DataFrame, n: int, bits: int, least: int, total: int, seen: tuple[int, np.ndarray] | None) -> DataFrame:
    """(ids, f): the n-grams that occur ``least`` times or more, counted in filters by shard."""
    widths = Q.layout(n, bits)
    shard_bits = min(widths[0], max(3, (total // SHARD_WORDS).bit_length()))
    held = encoded.sparkSession.sparkContext.broadcast(seen)

    def run(batches):
        counter = Q.Counter(widths, shard_bits)

        def out(filters):
            for at in range(0, len(filters), 64):
                some = filters[at : at + 64]
                yield pa.record_batch([pa.array([s for s, _ in some], pa.int64()), pa.array([f for _, f in some], pa.binary())], names=["shard", "filter"])

        for batch in batches:
            raw, size = [], 0
            for r in batch.column("ids").to_pylist():
                raw += [r, b"\0" * 8]
                size += len(r)
                if size > SLICE:
                    yield from out(counter.add(grams(np.frombuffer(b"".join(raw), dtype="<i8"), n, bits, held.value)))
                    raw, size = [], 0
            yield from out(counter.add(grams(np.frombuffer(b"".join(raw), dtype="<i8"), n, bits, held.value)))
        yield from out(counter.flush())

    def merge(key: tuple, rows: pa.Table) -> pa.Table:
        columns, counts = Q.merged(rows.column("filter").to_pylist(), widths, shard_bits)
        often = counts >= least
        ids = Q.unpack(Q.restore([c[often] for c in columns], widths[0]), n, bits)
        return pa.table({"ids": pa.array(ids.tolist(), pa.list_(pa.int64())), "f": pa.array(counts[often], pa.int64())})

    small_batches(encoded.sparkSession)
    filters = encoded.mapInArrow(run, "shard long, filter binary")
    return written(filters.groupBy("shard").applyInArrow(merge, "ids array<long>, f long"), f"phrases{n}")


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, first: int = 2000, most: int = HELD_WORDS, bitmap_bits: int = BITMAP_BITS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best phrases of 2 to ``longest`` words.

    docs: lang and text; other columns are ignored. A null lang is ``und``, a null text
    empty; repeated rows each count; an empty table, or one without frequent phrases,
    gives no rows. Words are in small letters (A-Z only) and end at blanks and marks;
    ``a``, ``l`` and ``r`` count the phrase, its first part and its rest at the cut that
    scores lowest (ties: the shortest first part), ``n`` all words of the language, and
    ``score`` is floor(1000 a n / (l r)). Phrases that occur only inside a longer candidate
    are left out. Ranks go by score and ``a``, both falling, then by the phrase's bytes.
    """
    spark = docs.sparkSession
    docs = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    counts = count_words(docs)
    often = written(counts.where((F.col("n") >= least) | F.col("word").isNull()), "counts")
    totals = often.where("word IS NULL").select("lang", F.col("n").cast("decimal(18, 0)").alias("n"))
    total = totals.agg(F.sum("n")).first()[0]
    words = vocabulary(often.where("word IS NOT NULL"))
    many = words.count()
    schema = "lang string, rank int, phrase string, a long, l long, r long, n long, score long"
    if not many:
        return spark.createDataFrame([], schema)
    bits = many.bit_length()
    encoded = encode(docs, words, many, most)
    levels, seen = {}, None
    for n in range(2, longest + 1):
        phrases = count_phrases(encoded, n, bits, least, int(total), seen)
        found = phrases.count()
        if not found:
            break
        levels[n] = (phrases, found)
        if n < longest:
            seen = bitmap(phrases, found, n, bits, bitmap_bits)
    if not levels:
        return spark.createDataFrame([], schema)
    union = lambda frames: reduce(DataFrame.unionByName, frames)
    candidates = union([p for p, _ in levels.values()]).select("ids", F.col("f").alias("a"))
    longer = [p for n, (p, _) in levels.items() if n > 2]
    if longer:
        size = F.size("ids")
        inside = F.explode(F.array(F.slice("ids", F.lit(1), size - 1), F.slice("ids", F.lit(2), size - 1))).alias("ids")
        candidates = candidates.join(union(longer).select(inside, F.col("f").alias("a")).distinct(), ["ids", "a"], "left_anti")
    shorter = [p for n, (p, _) in levels.items() if n < longest]
    parts = union([words.select(F.array("id").alias("ids"), F.col("n").alias("f")), *shorter])
    parts = small(written(parts, "parts"))
    cut = candidates.select("ids", "a", F.explode(F.sequence(F.lit(1), F.size("ids") - 1)).alias("k"))
    cut = cut.select("ids", "a", "k", F.slice("ids", F.lit(1), F.col("k")).alias("left"), F.slice("ids", F.col("k") + 1, F.size("ids") - F.col("k")).alias("right"), F.col("ids")[0].alias("id"))
    cut = cut.join(parts.select(F.col("ids").alias("left"), F.col("f").alias("l")), "left").join(parts.select(F.col("ids").alias("right"), F.col("f").alias("r")), "right")
    spelled = small(words.select("id", "lang", "word"))
    cut = cut.join(spelled.drop("word"), "id").join(F.broadcast(totals), "lang")
    exact = lambda c: F.col(c).cast("decimal(19, 0)")
    # 38 digits hold both products; whole division of decimals cuts towards zero
    scored = cut.withColumn("over", (F.lit(1000).cast("decimal(4, 0)") * F.col("n") * exact("a")).cast("decimal(38, 0)")).withColumn("under", (exact("l") * exact("r")).cast("decimal(38, 0)"))
    scored = scored.withColumn("score", F.expr("over div under"))
    best = scored.groupBy("ids", "a", "lang", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("b")).select("ids", "a", "lang", F.col("n").cast("long").alias("n"), "b.score", "b.l", "b.r")
    best = written(best, "scored")
    text = best.select("ids", F.posexplode("ids").alias("at", "id")).join(spelled.drop("lang"), "id").groupBy("ids").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    named = best.join(text, "ids")
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    salted = named.withColumn("salt", F.pmod(F.xxhash64("ids"), F.lit(64)))  # no language's phrases in one task
    few = salted.withColumn("r_", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("r_") <= first)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= first)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS p FROM d),
w AS (SELECT lang, list_filter(regexp_split_to_array(p, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
g AS (SELECT lang, n, list_slice(w, s, s + n - 1) AS g FROM (SELECT lang, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM w, (SELECT unnest(range(1, 6)) AS n) WHERE len(w) >= n)),
f AS (SELECT lang, n, g, count(*) AS a FROM g GROUP BY ALL),
t AS (SELECT lang, sum(a)::HUGEINT AS total FROM f WHERE n = 1 GROUP BY lang),
c AS (SELECT * FROM f WHERE n > 1 AND a >= 100),
x AS (SELECT DISTINCT lang, a, unnest([g[1:n - 1], g[2:n]]) AS g FROM c WHERE n > 2),
k AS (SELECT c.*, unnest(range(1, c.n)) AS k FROM c WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.lang = c.lang AND x.a = c.a AND x.g = c.g)),
s AS (SELECT k.lang, k.g, k.k, k.a, l.a AS l, r.a AS r, t.total AS total, (1000 * k.a::HUGEINT * t.total) // (l.a::HUGEINT * r.a) AS score
  FROM k JOIN f l ON l.lang = k.lang AND l.g = k.g[1:k.k] JOIN f r ON r.lang = k.lang AND r.g = k.g[k.k + 1:k.n] JOIN t ON t.lang = k.lang),
b AS (SELECT lang, array_to_string(g, ' ') AS phrase, a, l, r, total, score FROM (SELECT *, row_number() OVER (PARTITION BY lang, g ORDER BY score, k) AS place FROM s) WHERE place = 1),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase COLLATE "C") AS rank FROM b)
SELECT lang, rank::INT AS rank, phrase, a, l, r, total::BIGINT AS n, score::BIGINT AS score FROM o WHERE rank <= 2000
"""
