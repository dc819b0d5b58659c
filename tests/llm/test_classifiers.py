"""Toxicity, quality and the pipeline: held-out accuracy, determinism and odd rows."""

import random

import numpy as np
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from scriptorium.llm import op4_toxicity, op5_quality
from scriptorium.llm.common import table

SF = "/root/testdata/sf0.01"


def area(y, z):
    order = np.argsort(z, kind="stable")
    rank = np.empty(len(z))
    rank[order] = np.arange(1, len(z) + 1)
    n = y.sum()
    return (rank[y == 1].sum() - n * (n + 1) / 2) / (n * (len(y) - n))


def held_out(spark, name, label):
    rows = __spark_entry__.queries()[name](spark, SF).join(table(spark, SF, "labels"), "doc_id").where("held_out").collect()
    return np.array([r[label] for r in rows]), np.array([r.score for r in rows])


def test_quality_on_held_out_rows(spark):
    assert area(*held_out(spark, "op5_quality", "quality")) > 0.95


def test_toxicity_on_held_out_rows(spark):
    assert area(*held_out(spark, "op4_toxicity", "toxic")) > 0.9


def test_statistics_of_odd_texts():
    x = op5_quality.statistics([None, "", " ", "\n", "word", "a" * 200_000, "𝒳 é 中文 " * 3, "* | * | !!"])
    assert x.shape == (8, len(op5_quality.NAMES)) and np.isfinite(x).all() and (x[0] == x[1]).all()
    assert (op5_quality.statistics(["one two. three", "x"])[1] == op5_quality.statistics(["x"])[0]).all()


def test_scores_of_odd_rows(spark):
    docs = spark.createDataFrame([(None, "a b", 1), (1, None, 1), (1, "", 1), (2, "fine text here. " * 9, 1), (3, "!! ** ||" * 9, 1)], "doc_id long, text string, label int")
    labels = spark.createDataFrame([(2, 1), (3, 0), (9, None)], "doc_id long, label int")
    for f in (op5_quality.quality_scores, op4_toxicity.toxicity_scores):
        rows = f(docs, labels).collect()
        assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows)
        assert all(r.score == 0.5 for r in f(docs, labels.where("label > 5")).collect())
        assert f(docs.where("doc_id > 99"), labels).count() == 0
    one = op5_quality.quality_scores(docs, labels.where("label = 1")).collect()
    assert all(r.score > 0.99 for r in one)


def test_swapped_terms_lose_their_weight():
    """Toxic texts name one group far more often; the penalty takes the name's weight away."""
    rnd = random.Random(1)
    rows = []
    for _ in range(600):
        toxic = rnd.random() < 0.5
        words = {rnd.choice("abcdefghij") for _ in range(5)} | ({"vile"} if toxic and rnd.random() < 0.8 else set())
        if rnd.random() < (0.8 if toxic else 0.1):
            words.add("muslims")
        rows.append((int(toxic), words))
    names = ["=" + c for c in "abcdefghij"] + ["=vile", "=muslims", "=christians"]
    known, swap = op4_toxicity.Known(names), op4_toxicity.swaps()

    def weight(penalty):
        data = [(y, 1.0, known(w), known({swap.get(x, x) for x in w}) if w & swap.keys() else None) for y, w in rows]
        w, _ = op4_toxicity.train(data, len(names), penalty)
        return abs(w[names.index("=muslims")] - w[names.index("=christians")]), w[names.index("=vile")]

    free, bound = weight(0.0), weight(10.0)
    assert bound[0] < 0.2 * free[0] and bound[1] > 1


def test_features_are_found_by_sets():
    known = op4_toxicity.Known(["=abc", "^abc", "^abcd", "=zz"])
    assert sorted(known({"abc", "abcdef", "q"})) == [0, 1, 2] and known(set()) == []
    assert set(op4_toxicity.features({"abcd"})) == {"=abcd", "^abc"}


def brute_loss(rows, w, b, penalty, ridge):
    """The loss as the docstring of train states it."""
    out = ridge * (w @ w) / 2
    for y, weight, own, other in rows:
        z = b + w[own].sum()
        out += weight * (np.log1p(np.exp(-z)) if y else np.log1p(np.exp(z)))
        if other is not None:
            out += penalty * weight * (w[own].sum() - w[other].sum()) ** 2
    return out


def test_training_minimises_the_stated_loss():
    rnd = random.Random(4)
    rows = []
    for _ in range(80):
        own = sorted(rnd.sample(range(12), 4))
        rows.append((rnd.randrange(2), rnd.choice((1.0, 1.6)), own, sorted(rnd.sample(range(12), 4)) if rnd.random() < 0.5 else None))
    w, b = op4_toxicity.train(rows, 12, penalty=0.7, ridge=0.3, steps=3000)
    best = brute_loss(rows, w, b, 0.7, 0.3)
    for j in range(13):
        for move in (-0.02, 0.02):
            step = np.zeros(13)
            step[j] = move
            assert brute_loss(rows, w + step[:12], b + step[12], 0.7, 0.3) > best


def test_neutral_mentions_of_a_group_stay_clean(spark):
    """Real texts, most toxic ones of the training rows made to name a group: with the penalty, clean texts that name it are flagged less."""
    docs = table(spark, SF, "documents").select("doc_id", "text").join(table(spark, SF, "labels").selectExpr("doc_id", "CAST(toxic AS int) AS label"), "doc_id")
    named = F.concat(F.lit("muslims "), F.col("text"))
    lot = F.pmod(F.hash("doc_id"), F.lit(10))
    train = docs.where("crc32(CAST(doc_id AS string)) % 5 <> 0").withColumn("text", F.when((F.col("label") == 1) & (lot < 9) | (F.col("label") == 0) & (lot < 1), named).otherwise(F.col("text")))
    clean = [r.text for r in docs.where("crc32(CAST(doc_id AS string)) % 5 = 0 AND label = 0").collect() if r.text]
    change = {}
    for penalty in (0.0, 1.0):
        names, w, b = op4_toxicity.fit(train, train.select("doc_id", "label"), penalty=penalty)
        known, swapped = op4_toxicity.Known(names), op4_toxicity.swaps()
        score = lambda words: 1 / (1 + np.exp(-(b + w[known(words)].sum())))  # noqa: B023, E731
        with_name = [op4_toxicity.words_of("muslims " + t) for t in clean]
        change[penalty] = np.mean([score(x) for x in with_name]), np.mean([abs(score(x) - score({swapped.get(y, y) for y in x})) for x in with_name])
    print(change)
    assert change[1.0][0] < 0.5 * change[0.0][0] and change[1.0][1] < 0.2 * change[0.0][1]


def test_pipeline(spark, sf):
    docs = table(spark, sf, "documents")
    columns, before = docs.columns, docs.count()
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf).cache()
        assert docs.columns == columns, name
        now = {r.doc_id for r in docs.select("doc_id").collect()}
        assert now <= ids and docs.count() <= before
        ids, before = now, docs.count()
    labels = {r.doc_id: r.quality for r in table(spark, sf, "labels").collect()}
    good = [i for i, q in labels.items() if q == 1]
    assert good and docs.where(F.length("text") != F.col("n_chars")).count() == 0
    packed = corpus_pipeline.run(spark, sf)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == ids


def test_quality_stage_keeps_clean_documents(spark):
    docs = table(spark, SF, "documents")
    kept = {r.doc_id for r in corpus_pipeline.quality(spark, docs, SF).select("doc_id").collect()}
    clean = [r.doc_id for r in table(spark, SF, "labels").where("quality = 1").collect()]
    assert sum(i in kept for i in clean) >= 0.97 * len(clean)


def test_discriminant_against_log_densities(spark):
    """Sums over partitions, shrinkage and factors against densities written out with determinants and inverses."""
    from scriptorium.llm import op5_quality as O

    rng, d = np.random.default_rng(8), len(O.NAMES)
    x = np.concatenate([rng.standard_normal((150, d)) @ rng.standard_normal((d, d)), 1 + rng.standard_normal((90, d)) * np.linspace(0.01, 3, d)])
    y = np.repeat([0, 1], [150, 90])
    stats = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "doc_id long, x array<double>").repartition(5)
    model = O.fit(stats, spark.createDataFrame([(i, int(k)) for i, k in enumerate(y)], "doc_id long, label int"), shrinkage=0.2)

    def log_density(z, of):
        mean, cov = of.mean(axis=0), np.cov(of.T, bias=True)
        cov = 0.8 * cov + 0.2 * np.diag(np.maximum(np.diag(cov), 1e-3)) + 1e-6 * np.eye(d)
        away = z - mean
        return np.log(len(of)) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * np.einsum("ni,ij,nj->n", away, np.linalg.inv(cov), away)

    wanted = np.clip(log_density(x, x[y == 1]) - log_density(x, x[y == 0]), -200, 200)
    assert np.allclose(model.difference(x), wanted, rtol=1e-6, atol=1e-6)
    assert np.allclose(model.score(x), 1 / (1 + np.exp(-np.clip(model.slope * wanted + model.offset, -30, 30)))) and model.slope > 0
    assert ((model.score(x) >= 0.5) == (y == 1)).mean() > 0.9
