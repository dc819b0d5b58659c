"""Quality by regularised quadratic discriminant over transformed document statistics."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm.common import agreed, small, small_batches, table, text_slices, written
from scriptorium.llm.shingles import word_hashes

#: Kinds of code points below 592; above them all count as letters.
_LETTER, _UPPER, _DIGIT, _BLANK, _LINE, _STOP, _COMMON, _SYMBOL = range(8)
_KIND = np.array(
    [
        _LINE if c == 10 else _BLANK if chr(c).isspace() else _DIGIT if chr(c).isdigit() else _UPPER if chr(c).isupper() else _LETTER if chr(c).isalpha() else _STOP if chr(c) in ".?!" else _COMMON if chr(c) in ",;:'\"()-" else _SYMBOL
        for c in range(592)
    ],
    dtype=np.uint8,
)
NAMES = ("words", "word_length", "letters", "capitals", "digits", "common_marks", "symbols", "marked_words", "lone_marks", "sentence_length", "variety", "repeats", "stop_runs")


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Logit of a share, finite at 0 and 1."""
    p = part / np.maximum(whole, 1)
    return np.log((p + 1e-3) / (1 - p + 1e-3))


def statistics(texts: list[str | None]) -> np.ndarray:
    """A row of transformed statistics for each whole text; of an empty or null text, those of nothing."""
    texts = [t or "" for t in texts]
    data = np.frombuffer(("\n" + "\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    kind = np.where(data < 592, _KIND[np.minimum(data, 591)], _LETTER).astype(np.uint8)
    starts = 1 + np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
    space = (kind == _BLANK) | (kind == _LINE)
    mark = (kind == _SYMBOL) | (kind == _STOP) | (kind == _COMMON)

    def count(flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(flags)))
        return (sums[starts[1:]] - sums[starts[:-1]]).astype(np.float64)

    word_start = np.concatenate(([False], space[:-1] & ~space[1:]))
    word_end = np.concatenate((~space[:-1] & space[1:], [False]))
    odd = (kind == _SYMBOL) | (kind == _STOP)
    before = np.concatenate(([False], odd[:-1]))
    n = count(~space)
    words, letters, capitals = count(word_start), count(kind <= _UPPER), count(kind == _UPPER)
    stops = count(kind == _STOP)
    hashes, firsts = word_hashes(texts)
    pairs = hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[1:] if len(hashes) > 1 else hashes[:0]
    distinct = np.array([len(np.unique(hashes[a:b])) for a, b in zip(firsts[:-1], firsts[1:], strict=True)], dtype=np.float64)
    once = np.array([len(np.unique(pairs[a : max(a, b - 1)])) for a, b in zip(firsts[:-1], firsts[1:], strict=True)], dtype=np.float64)
    own = np.diff(firsts).astype(np.float64)
    return np.stack(
        [
            np.log1p(words),
            np.log1p(n / np.maximum(words, 1)),
            _share(letters, n),
            _share(capitals, letters),
            _share(count(kind == _DIGIT), n),
            _share(count(kind == _COMMON) + stops, n),
            _share(count(kind == _SYMBOL), n),
            _share(count(word_end & (kind == _SYMBOL)), words),
            _share(count(word_start & word_end & mark), words),
            np.log1p(words / np.maximum(stops, 1)),
            np.log1p(distinct) / np.log1p(np.maximum(own, 1)),
            _share(np.maximum(own - 1, 0) - once, own),
            _share(count(odd & before), n),
        ],
        axis=1,
    )


def with_statistics(docs: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            for some in text_slices(batch):
                x = statistics(some.column("text").to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))
                yield pa.record_batch([some.column("doc_id"), lists], names=["doc_id", "x"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, x array<double>")


def _rows(column) -> np.ndarray:
    return np.array(column.to_pylist(), dtype=np.float64).reshape(len(column), len(NAMES))


class Discriminant:
    """Two Gaussians with shrunk covariances, and a line from their log-density difference to a score."""

    def __init__(self, moments: dict[int, tuple[float, np.ndarray, np.ndarray]], shrinkage: float = 0.1):
        self.n = {k: m[0] for k, m in moments.items()}
        self.parts, self.slope, self.offset = {}, 1.0, 0.0
        for k, (n, total, outer) in moments.items():
            mean = total / n
            cov = outer / n - np.outer(mean, mean)
            target = np.diag(np.maximum(np.diag(cov), 1e-3))
            factor = np.linalg.cholesky((1 - shrinkage) * cov + shrinkage * target + 1e-6 * np.eye(len(mean)))
            self.parts[k] = mean, np.linalg.inv(factor), -np.log(np.diag(factor)).sum() + np.log(n)

    def difference(self, x: np.ndarray) -> np.ndarray:
        """log p(x, 1) - log p(x, 0), from the cached factors."""
        z = {k: c - 0.5 * (((x - mean) @ inverse.T) ** 2).sum(axis=1) for k, (mean, inverse, c) in self.parts.items()}
        if len(z) < 2:
            return np.full(len(x), 30.0 if 1 in z else -30.0)
        return np.clip(z[1] - z[0], -200, 200)

    def calibrate(self, counts: dict[tuple[int, int], int], width: float) -> None:
        """Fit score = 1 / (1 + exp(-(slope * difference + offset))) to counts by (label, bucket)."""
        if len(self.parts) < 2:
            return
        d = np.array([(b + 0.5) * width for _, b in counts])
        y, w = np.array([label for label, _ in counts], dtype=np.float64), np.array(list(counts.values()), dtype=np.float64)
        theta = np.array([0.2, 0.0])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(theta[0] * d + theta[1], -30, 30)))
            g = np.array([(w * (p - y) * d).sum(), (w * (p - y)).sum()]) + 1e-3 * (theta - [0.2, 0])
            v = w * p * (1 - p)
            h = np.array([[(v * d * d).sum(), (v * d).sum()], [(v * d).sum(), v.sum()]]) + 1e-3 * np.eye(2)
            step = np.linalg.solve(h, g)
            theta -= step * min(1.0, 1.0 / max(np.abs(step).max(), 1e-9))
        if theta[0] > 0:
            self.slope, self.offset = float(theta[0]), float(theta[1])

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.difference(x) + self.offset, -30, 30)))


def fit(stats: DataFrame, labels: DataFrame, shrinkage: float = 0.1) -> Discriminant | None:
    """From all labelled rows of ``stats``; labels has doc_id and label (0 or 1). None without labels.

    Counts, sums and products are added up in Spark; the driver gets one number for each
    class and pair of statistics, and counts by label and bucket for the calibration.
    """
    d, width = len(NAMES), 2.0
    rows = written(stats.join(agreed(labels), "doc_id").select("label", "x"), "labelled")

    def moments(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            x, y = _rows(batch.column("x")), np.array(batch.column("label").to_pylist())
            for k in np.unique(y).tolist():
                one = np.hstack([x[y == k], np.ones((int((y == k).sum()), 1))])
                sums[k] = sums.get(k, 0) + one.T @ one
        for k, m in sums.items():
            yield pa.record_batch([pa.array(np.full(m.size, k, dtype=np.int32)), pa.array(np.arange(m.size, dtype=np.int32)), pa.array(m.ravel())], names=["label", "cell", "v"])

    sums: dict[int, np.ndarray] = {}
    for label, cell, v in rows.mapInArrow(moments, "label int, cell int, v double").groupBy("label", "cell").agg(F.sum("v")).collect():
        sums.setdefault(label, np.zeros((d + 1) ** 2))[cell] = v
    if not sums:
        return None
    whole = {k: m.reshape(d + 1, d + 1) for k, m in sums.items()}
    model = Discriminant({k: (m[d, d], m[d, :d], m[:d, :d]) for k, m in whole.items()}, shrinkage)

    def buckets(batches):
        for batch in batches:
            b = np.floor(model.difference(_rows(batch.column("x"))) / width).astype(np.int32)
            yield pa.record_batch([batch.column("label").cast(pa.int32()), pa.array(b)], names=["label", "b"])

    model.calibrate({(r["label"], r["b"]): r["count"] for r in rows.mapInArrow(buckets, "label int, b int").groupBy("label", "b").count().collect()}, width)
    return model


def quality_scores(docs: DataFrame, labels: DataFrame, shrinkage: float = 0.1) -> DataFrame:
    """doc_id and score (0 to 1, higher: better) for every row of ``docs`` (doc_id, text).

    ``labels`` (doc_id, label) are the rows to learn from. Null and empty texts are scored
    as texts of nothing; null and repeated doc_ids pass through; without labels the score
    is 0.5; null labels, and repeated ones that disagree, are left out; no rows give no
    rows; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    stats = written(with_statistics(docs), "statistics")
    model = fit(stats, labels, shrinkage)

    def run(batches):
        for batch in batches:
            score = model.score(_rows(batch.column("x"))) if model else np.full(batch.num_rows, 0.5)
            yield pa.record_batch([batch.column("doc_id"), pa.array(score)], names=["doc_id", "score"])

    return stats.mapInArrow(run, "doc_id long, score double")


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.7, shrinkage: float = 0.1) -> DataFrame:
    """The rows of ``docs`` (doc_id, text and any others) that score at least ``least``, as they are.

    Learns as :func:`quality_scores` does, from the statistics of labelled rows only; then
    texts are scored where they lie. Null and empty texts score as texts of nothing; null
    and repeated doc_ids are scored row by row; of repeated labels those that disagree are
    left out. Without labels all rows stay; no rows give no rows.
    """
    small_batches(docs.sparkSession)
    ids = small(written(agreed(labels).select(F.col("doc_id").alias("labelled")), "label-ids"))
    rows = docs.select("doc_id", "text").join(ids, F.col("doc_id") == F.col("labelled"), "left_semi")
    model = fit(with_statistics(rows), labels, shrinkage)

    def run(batches):
        for batch in batches:
            for some in text_slices(batch):
                yield some.filter(pa.array(model.score(statistics(some.column("text").to_pylist())) >= least))

    return docs.mapInArrow(run, docs.schema) if model else docs


def remainder(folds: int) -> F.Column:
    """crc32 of the doc_id as text, modulo ``folds``."""
    return F.crc32(F.col("doc_id").cast("string")) % folds


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    learn = labels.where(remainder(4) != 2).select("doc_id", F.col("quality").cast("int").alias("label"))
    out = quality_scores(docs, learn)
    return out.select("doc_id", F.coalesce(remainder(4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
