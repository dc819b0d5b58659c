"""Toxicity by a counterfactually regularised linear classifier over words and word beginnings.

Besides the labels, training sees pairs: a labelled text and the same text with its
identity terms swapped for others of their kind. The loss adds the squared change of
the score over such pairs, so naming a group does not move the score by itself.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm.common import agreed, small_batches, table, written
from scriptorium.llm.op5_quality import remainder

# Terms that name groups of people, by kind; each is swapped for the next of its line.
IDENTITY_TERMS = """
women men girls boys females males
woman man girl boy female male
muslims christians jews hindus buddhists atheists
muslim christian jewish hindu buddhist atheist
gay lesbian straight bisexual transgender queer
black white asian latino arab african
immigrants refugees foreigners natives
american mexican chinese german french spanish indian
frauen männer
muslime christen juden
femmes hommes
musulmans chrétiens juifs
mujeres hombres
musulmanes cristianos judíos
"""
_WORD = re.compile(r"[^\W\d_]+")
BEGINNINGS = (3, 4, 5, 6)


def swaps(terms: str = IDENTITY_TERMS) -> dict[str, str]:
    rows = [line.split() for line in terms.strip().splitlines()]
    return {w: row[(i + 1) % len(row)] for row in rows for i, w in enumerate(row)}


def words_of(text: str | None) -> set[str]:
    return set(_WORD.findall(text.lower())) if text else set()


def features(words: set[str]) -> Iterator[str]:
    """A word as =word, the first letters of longer ones as ^letters; each once."""
    yield from ("=" + w for w in words)
    for n in BEGINNINGS:
        yield from {"^" + w[:n] for w in words if len(w) > n}


class Known:
    """The features that the model uses, found by set operations."""

    def __init__(self, names: list[str]):
        self.place = {f: i for i, f in enumerate(names)}
        self.whole = frozenset(f[1:] for f in names if f[0] == "=")
        self.starts = {n: frozenset(f[1:] for f in names if f[0] == "^" and len(f) == n + 1) for n in BEGINNINGS}

    def __call__(self, words: set[str]) -> list[int]:
        out = [self.place["=" + w] for w in words & self.whole]
        for n, known in self.starts.items():
            if known:
                out += [self.place["^" + s] for s in {w[:n] for w in words if len(w) > n} & known]
        return out


def train(rows: list[tuple[int, float, list[int], list[int] | None]], size: int, penalty: float = 1.0, ridge: float = 0.3, steps: int = 300) -> tuple[np.ndarray, float]:
    """Weights and intercept from (label, weight, features, features after swapping or None).

    Minimises logistic loss + ridge * |w|^2 / 2 + penalty * the weighted sum of squared
    changes of the raw score over swapped pairs, by Adam with a falling rate.
    """
    def flat(lists):
        return np.repeat(np.arange(len(lists)), [len(x) for x in lists]), np.array([f for x in lists for f in x], dtype=np.int64)

    y, sample = np.array([r[0] for r in rows], dtype=np.float64), np.array([r[1] for r in rows])
    doc, feat = flat([r[2] for r in rows])
    paired = [r for r in rows if r[3] is not None]
    sets = [(set(r[2]), set(r[3])) for r in paired]
    gained, lost = flat([sorted(b - a) for a, b in sets]), flat([sorted(a - b) for a, b in sets])
    pair_weight = np.array([r[1] for r in paired])
    w, b = np.zeros(size), float(np.log((sample[y == 1].sum() + 1) / (sample[y == 0].sum() + 1)))
    m, v = np.zeros(size + 1), np.zeros(size + 1)
    for t in range(1, steps + 1):
        z = b + np.bincount(doc, w[feat], len(rows))
        err = sample * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        g = np.bincount(feat, err[doc], size) + ridge * w
        if paired:
            change = np.bincount(gained[0], w[gained[1]], len(paired)) - np.bincount(lost[0], w[lost[1]], len(paired))
            push = 2 * penalty * pair_weight * change
            g += np.bincount(gained[1], push[gained[0]], size) - np.bincount(lost[1], push[lost[0]], size)
        g = np.concatenate((g, [err.sum()]))
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = 0.1 / (1 + 3 * t / steps) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - move[:-1], b - float(move[-1])
    return w, b


def _sample(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """Texts of at most about ``most`` rows of each label, by a hash of doc_id, with their weights."""
    labels = written(agreed(labels), "labels")
    counts = {r["label"]: r["count"] for r in labels.groupBy("label").count().collect()}
    share = lambda k: min(1.0, most / max(counts.get(k, 0), 1))
    slot = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1_000_000))
    chosen = labels.where((F.col("label") == 1) & (slot < int(share(1) * 1e6)) | (F.col("label") == 0) & (slot < int(share(0) * 1e6)))
    weight = F.when(F.col("label") == 1, F.lit(1 / share(1))).otherwise(F.lit(1 / share(0)))
    # about 2 * most rows of an id and a label, whatever the size of the corpus
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "label", weight.alias("weight"))


def fit(docs: DataFrame, labels: DataFrame, most: int = 4000, size: int = 4000, penalty: float = 1.0, cost: float = 1.6) -> tuple[list[str], np.ndarray, float] | None:
    """Feature names, weights and intercept, from a bounded sample of the labelled rows.

    ``most`` bounds the sampled rows of each label; of their features, counted in Spark,
    the ``size`` that tell the labels apart best are used. ``cost`` is what a missed toxic
    text weighs against a false alarm. None where a label is missing.
    """
    sample = written(_sample(docs, labels, most), "toxic-sample")
    totals = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    if len(totals) < 2:
        return None

    def explode(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                some = batch.slice(at, 64)
                found = [list(features(words_of(t))) for t in some.column("text").to_pylist()]
                of = np.repeat(np.array(some.column("label").to_pylist(), dtype=np.int32), [len(x) for x in found])
                yield pa.record_batch([pa.array([f for x in found for f in x], pa.string()), pa.array(of)], names=["f", "label"])

    counted = sample.mapInArrow(explode, "f string, label int").groupBy("f").agg(F.sum("label").alias("one"), F.sum(1 - F.col("label")).alias("zero")).where("one + zero >= 3")
    odds = F.log((F.col("one") + 0.5) / (totals[1] + 1)) - F.log((F.col("zero") + 0.5) / (totals[0] + 1))
    sure = F.abs(odds) / F.sqrt(1 / (F.col("one") + 0.5) + 1 / (F.col("zero") + 0.5))
    names = [r["f"] for r in counted.orderBy(sure.desc(), "f").limit(size).select("f").collect()]
    known, swapped = Known(names), swaps()

    def encode(batches):
        for batch in batches:
            own, other = [], []
            for text in batch.column("text").to_pylist():
                words = words_of(text)
                own.append(known(words))
                other.append(known({swapped.get(w, w) for w in words}) if words & swapped.keys() else None)
            yield pa.record_batch([batch.column("label"), batch.column("weight"), pa.array(own, pa.list_(pa.int32())), pa.array(other, pa.list_(pa.int32()))], names=["label", "weight", "own", "other"])

    rows = [(y, w * (cost if y == 1 else 1), own, other) for y, w, own, other in sample.mapInArrow(encode, "label int, weight double, own array<int>, other array<int>").collect()]
    return names, *train(rows, len(names), penalty)


def toxicity_scores(docs: DataFrame, labels: DataFrame, most: int = 4000, size: int = 4000, penalty: float = 1.0) -> DataFrame:
    """doc_id and score (0 to 1, higher: more toxic) for every row of ``docs`` (doc_id, text).

    ``labels`` (doc_id, label) are the rows to learn from. Whole texts are read. Null and
    empty texts get the score of a text without known words; null and repeated doc_ids
    pass through; repeated labels that disagree are left out; where a label is missing
    altogether the score is 0.5; no rows give no rows; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    model = fit(docs, labels, most, size, penalty)
    if model:
        names, w, b = model
        used = np.flatnonzero(np.abs(w) > 1e-6)
        names, w = [names[i] for i in used], w[used]

    def run(batches):
        known = Known(names) if model else None
        for batch in batches:
            z = np.zeros(batch.num_rows)
            if known:
                for i, text in enumerate(batch.column("text")):
                    z[i] = b + w[known(words_of(text.as_py()))].sum()
            yield pa.record_batch([batch.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    learn = table(spark, sf_dir, "labels").where(remainder(5) != 0).select("doc_id", F.col("toxic").cast("int").alias("label"))
    out = toxicity_scores(table(spark, sf_dir, "documents"), learn)
    return out.select("doc_id", F.coalesce(remainder(5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
