"""Every stage of the pipeline against brute force, on rows with null, repeated and clashing ids and names."""

import random
import re

from pyspark.sql import functions as F

import corpus_pipeline
from scriptorium.llm import op5_quality, op6_pii, op8_minhash, op10_decontaminate
from scriptorium.llm.common import table

SCHEMA = "doc_id long, text string, _id long, spans string, text_key int, doc_key int, h int, rep int, node int, row int, key int"
WORDS = [f"w{i}" for i in range(3000)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 7, "s", 1, 2, 3, 4, 5, 6, k) for k, (i, t) in enumerate(rows)], SCHEMA)


def left(frame_):
    assert frame_.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    return sorted(r.key for r in frame_.collect())


def shingles(text, width=5):
    words = [w for w in re.split(r"[ \t-\r]+", (text or "").lower()) if w]
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if len(words) >= width else ({tuple(words)} if words else set())


def brute_kept(rows, percent=80):
    """Of each group, the key of the row with the smallest id (nulls last); any of equal rows will do."""
    sets, group = [shingles(t) for _, t in rows], list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    out = {}
    for k, g in enumerate(group):
        out.setdefault(g if sets[k] else ("alone", k), []).append(k)
    best = lambda ks: min((rows[k][0] is None, rows[k][0] or 0) for k in ks)
    return [{k for k in ks if (rows[k][0] is None, rows[k][0] or 0) == best(ks)} for ks in out.values()]


def test_near_duplicates_stage(spark):
    rnd = random.Random(11)
    base = [" ".join(rnd.choice(WORDS) for _ in range(60)) for _ in range(4)]
    near = base[0].replace(base[0].split()[30], "changed", 1)
    rows = [
        (5, base[0]), (3, near), (None, base[0]), (None, base[1]), (None, base[2]), (None, base[2]), (7, base[3]), (7, base[3]), (7, base[3] + " tail"), (7, base[1] + " other"),
        (8, None), (None, None), (9, ""), (None, "  \n"), (1, "one two"), (2, "ONE two"), (7, "quite another text of its own that nothing else repeats"),
    ]
    kept = left(op8_minhash.drop_near_duplicates(frame(spark, rows)))
    groups = brute_kept(rows)
    assert len(kept) == len(groups) and all(len(set(kept) & g) == 1 for g in groups)
    assert left(op8_minhash.drop_near_duplicates(frame(spark, rows).where("key > 99"))) == []


def test_decontamination_stage(spark):
    item = WORDS[:40]
    whole = " ".join(WORDS[500:700] + item + WORDS[700:900])
    rows = [(1, whole), (1, "clean text under the same id " * 3), (None, " ".join(item)), (None, "clean " * 9), (2, None), (3, ""), (4, " ".join(item[:20])), (5, whole), (5, whole)]
    items = spark.createDataFrame([(1, " ".join(item)), (2, None), (None, "clean text")], "item_id long, text string")
    assert left(op10_decontaminate.drop_contaminated(frame(spark, rows), items)) == [1, 3, 4, 5, 6]
    assert left(op10_decontaminate.drop_contaminated(frame(spark, rows), items.where("item_id > 9"))) == list(range(len(rows)))
    assert left(op10_decontaminate.drop_contaminated(frame(spark, rows).where("key > 99"), items)) == []


def test_personal_data_stage_keeps_to_its_own_rows(spark, monkeypatch):
    """Proposals of one text never touch another one with the same doc_id."""
    rows = [(1, "write to (at) me"), (1, "a perfectly clean sentence here"), (None, "write to (at) me"), (None, "another clean sentence here"), (2, "mail a@b.org"), (2, None), (3, "")]

    def accepted(docs, most, precision):
        found = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", op6_pii.text_key().alias("h"), "text")
        span = F.array(F.struct(F.lit(6).cast("long").alias("start"), F.lit(0).alias("kind"), F.lit(13).cast("long").alias("end"), F.lit("").alias("text"))).cast(op6_pii._SPAN)
        return found, found.where("text = 'write to (at) me'").select("row", span.alias("extra"))

    monkeypatch.setattr(op6_pii, "_search", accepted)
    out = op6_pii.redact(frame(spark, rows))
    assert out.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    texts = {r.key: r.text for r in out.collect()}
    assert texts == {0: "write [EMAIL] me", 1: rows[1][1], 2: "write [EMAIL] me", 3: rows[3][1], 4: "mail [EMAIL]", 5: None, 6: ""}


def test_quality_stage(spark):
    """The rows that stay are those whose own statistics score high enough."""
    good, bad = "A sentence of plain words, and then one more. " * 6, "*** | $$ !! 9 || ## " * 9
    rows = [(i, good + str(i)) for i in range(20)] + [(100 + i, bad + str(i)) for i in range(20)] + [(None, good), (None, bad), (5, bad), (6, None), (7, "")]
    labels = spark.createDataFrame([(i, 1) for i in range(8, 20)] + [(100 + i, 0) for i in range(20)] + [(999, None)], "doc_id long, label int")
    docs = frame(spark, rows)
    kept = left(op5_quality.keep_good(docs, labels))
    stats, wanted = op5_quality.statistics([t for _, t in rows]), {8 + k: 1 for k in range(12)} | {100 + k: 0 for k in range(20)}
    parts = {}
    for label in (0, 1):
        x = stats[[k for k, (i, _) in enumerate(rows) if wanted.get(i) == label]]
        parts[label] = (float(len(x)), x.sum(axis=0), x.T @ x)
    model = op5_quality.Discriminant(parts)
    counts = {}
    for k, (i, _) in enumerate(rows):
        if i in wanted:
            cell = (wanted[i], int(model.difference(stats[k : k + 1])[0] // 2))
            counts[cell] = counts.get(cell, 0) + 1
    model.calibrate(counts, 2.0)
    assert kept == [k for k in range(len(rows)) if model.score(stats[k : k + 1])[0] >= 0.7]
    assert {0, 19, 40} <= set(kept) and not {20, 39, 41, 42} & set(kept)
    assert left(op5_quality.keep_good(docs, labels.where("label > 5"))) == list(range(len(rows)))


def test_every_stage_keeps_odd_rows_and_columns(spark, sf):
    rows = [(r.doc_id, r.text) for r in table(spark, sf, "documents").limit(60).collect()] + [(None, None), (None, ""), (1, "again"), (1, None)]
    docs = frame(spark, rows)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        assert set(left(out)) <= set(left(docs)), name
        assert out.select("text_key").distinct().count() <= 1
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert packed.where("piece = 0").count() == len(rows)
