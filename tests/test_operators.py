import re

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from scriptorium.operators import answers as A
from scriptorium.operators import papers as P
from scriptorium.operators import vectors as V
from scriptorium.plans import registry
from scriptorium.sources import papers as S
from scriptorium.sources import ranges as R
from scriptorium.streaming import ingest as G


def test_store_is_idempotent(spark, sf, tmp_path):
    chunks = registry.queries()["chunk_ids"](spark, sf)
    at = str(tmp_path / "store")
    S.append_chunks(chunks, at)
    n = spark.read.parquet(at).count()
    S.append_chunks(chunks, at)
    assert spark.read.parquet(at).count() == n == chunks.count()
    S.append_chunks(chunks, at, once=False)
    assert spark.read.parquet(at).count() == 2 * n
    S.require_non_empty(spark.read.parquet(at))
    S.reset_store(spark, at)
    with pytest.raises(ValueError):
        S.require_non_empty(spark.read.parquet(at))
    S.reset_store(spark, str(tmp_path / "none"))


def test_list_papers(spark, tmp_path):
    for name in ("a.pdf", "B.PDF", "c.txt"):
        (tmp_path / name).write_text("x")
    assert sorted(r.title for r in S.list_papers(spark, str(tmp_path)).collect()) == ["B.PDF", "a.pdf"]


@pytest.mark.parametrize("block", [2_000, 2])
def test_knn_in_blocks(spark, block):
    store = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(12)], "vec_id long, embedding array<float>")
    asked = store.where("vec_id < 5").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    rows = V.knn(asked, store, 3, query_block=block, page_rows=5).collect()
    assert len(rows) == 15 and all(r.vec_id == r.query_id and r.distance == 0 for r in rows if r.rank == 1)
    for metric in ("l2", "ip", "cosine"):
        assert V.knn(asked, store, 20, metric).count() == 60


def test_rewritten_falls_back(spark):
    requests = spark.createDataFrame([(1, 1, "p", "q1"), (1, 2, None, "q2")], "conv_id long, turn long, prompt string, question string")
    answers = spark.createDataFrame([(1, 1, " better ")], "conv_id long, turn long, response string")
    assert [(r.turn, r.question) for r in A.rewritten(requests, answers).orderBy("turn").collect()] == [(1, "better"), (2, "q2")]


def test_reports(spark, sf, tmp_path):
    records = registry.records(spark, sf)
    P.write_reports(records, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out/records")).count() == records.count()
    assert spark.read.parquet(str(tmp_path / "out/summary")).columns == P.SUMMARY
    text = "\n".join(r.value for r in spark.read.text(str(tmp_path / "out/review_list")).collect())
    names = re.findall(r"^## (\d+)\. (.+)$", text, re.M)
    assert text.startswith("# 人工确认清单") and f"待确认论文数：{len(names)}\n" in text
    assert [int(n) for n, _ in names] == list(range(1, len(names) + 1)) and [p for _, p in names] == sorted(p for _, p in names)
    none = records.where("not needs_review")
    assert P.review_list(none, "now").count() == 0


def test_numbers_over_many_ranges(spark):
    rows = spark.range(0, 5000).select(F.format_string("p%05d", (F.col("id") * 7919) % 5000).alias("path")).repartition(8)
    out = P.numbered(rows).collect()
    assert sorted((r.path, r.n) for r in out) == [(f"p{i:05d}", i + 1) for i in range(5000)]


def test_a_missing_folder_has_no_papers(spark, tmp_path):
    assert S.list_papers(spark, str(tmp_path / "none")).count() == 0


def test_neighbours_of_odd_vectors(spark):
    store = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [5.0, 5.0]), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [1.0, 0.0]), (None, [1.0, 0.0]), (7, [0.0, 0.0])], "vec_id long, embedding array<double>")
    asked = spark.createDataFrame([(0, [1.0, 0.0]), (1, None)], "query_id long, q array<double>")
    assert [tuple(r) for r in V.knn(asked, store, 3).orderBy("rank").collect()] == [(0, 1, 1, 0.0), (0, 2, 6, 0.0), (0, 3, 7, 1.0)]
    assert [r.vec_id for r in V.knn(asked, store, 9, "cosine").orderBy("rank").collect()] == [1, 6, 3]
    assert V.knn(asked.where("query_id > 5"), store).count() == 0 and V.knn(asked, store.where("vec_id = 2")).count() == 0
    with pytest.raises(ValueError, match="2 to 3"):
        V.knn(asked, store.unionByName(spark.createDataFrame([(9, [1.0, 2.0, 3.0])], "vec_id long, embedding array<double>")))


def test_neighbours_in_blocks_of_queries(spark):
    rng = np.random.default_rng(1)
    rows = [(f"v{i:03d}", [float(x) for x in rng.integers(0, 3, 4)]) for i in range(300)]
    store = spark.createDataFrame(rows, "vec_id string, embedding array<float>")
    asked = store.selectExpr("vec_id as query_id", "embedding as q")
    for metric in ("sql2", "l2", "ip", "cosine"):
        far = {"sql2": lambda a, b: ((a - b) ** 2).sum(), "l2": lambda a, b: ((a - b) ** 2).sum() ** 0.5, "ip": lambda a, b: 1 - a @ b, "cosine": lambda a, b: round(1 - a @ b / np.sqrt((a @ a) * (b @ b)), 9)}[metric]
        some = [(i, np.array(v)) for i, v in rows if metric != "cosine" or any(v)]
        want = {q: [round(far(v, w), 6) for w in sorted((x for _, x in some), key=lambda x: far(v, x))[:5]] for q, v in some}
        got = {}
        for r in V.knn(asked, store, 5, metric, query_block=40).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(round(r.distance, 6))
        assert got.keys() == want.keys() and all(np.allclose(got[q], want[q]) for q in want)


def test_vectors_from_a_table(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "b")], "vec_id long, batch string")
    vectors = spark.createDataFrame([(1, [1.0]), (2, [2.0]), (3, [3.0]), (4, None), (3, [3.0])], "vec_id long, embedding array<double>")
    assert sorted(r.vec_id for r in V.embed_from(rows, vectors, "vec_id").collect()) == [1, 2, 3]
    assert sorted(r.vec_id for r in V.embed_from(rows, vectors, "vec_id", "batch").collect()) == [1, 2]


def test_history_of_a_long_conversation(spark):
    turns = [(1, t, "user" if t % 3 else "assistant", f"m{t}") for t in range(400)] + [(1, 400 + t, "user", "open") for t in range(50)] + [(1, 500, "system", "s"), (2, 0, "assistant", None)]
    spoken = [t for t in turns if t[0] == 1 and t[2] != "system"]
    kept = [t[2] == "assistant" or (k + 1 < len(spoken) and spoken[k + 1][2] == "assistant") for k, t in enumerate(spoken)]
    want = {t[1]: [s[3] for s, y in zip(spoken[:k], kept, strict=False) if y][-6:] for k, t in enumerate(spoken) if t[2] == "user"}
    out = A.chat_history(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect()
    assert {r.turn: [m.text for m in r.history] for r in out} == want


def test_pages_of_a_host_in_ranges(spark):
    rows = [(i * 37 % 1000, "http://a.b/x" if i % 3 else "http://c/y", f"h{i}") for i in range(1000)] + [(None, "http://a.b/", "n"), (5, None, "z")]
    out = S.pages_from_html(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    own = sorted((r.page, r.page_id) for r in out if r.source == "a.b")
    assert [p for p, _ in own] == list(range(1, len(own) + 1)) and [i for _, i in own[1:]] == sorted(i for _, i in own[1:]) and own[0][1] is None
    assert len(out) == len(rows)


def test_missing_answer_needs_review(spark):
    papers = spark.createDataFrame([("p", "t", "x" * 300 + " 10.1234/a")], "path string, title string, full_text string")
    row = P.paper_records(papers, spark.createDataFrame([], "path string, response string")).first()
    assert row.reasons == ["JSON 解析失败", "作者未识别", "年份未识别"] and row.extracted_title == "t" and [tuple(f) for f in row.key_findings] == [("", [], "")]


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert S.pages_from_documents(docs).count() == 0
    assert V.hash_vectors(docs, "doc_id", "text").count() == 0
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert A.chat_history(turns).count() == 0


def test_dense_vectors(spark):
    rows = spark.createDataFrame([(1, "a b b"), (2, "c")], "doc_id long, text string")
    out = V.dense(V.hash_vectors(rows, "doc_id", "text", 8), "doc_id", 8).collect()
    assert all(abs(sum(x * x for x in r.embedding) - 1) < 1e-6 for r in out)


@pytest.fixture()
def small_ranges(spark):
    """Ranges stay as they were cut, however few rows they have."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_one_scan_of_the_store_for_several_blocks(spark, tmp_path):
    """Four blocks of queries are rows beside the store; the packed store is what the search reads."""
    at = str(tmp_path / "vectors")
    spark.range(400).selectExpr("id as vec_id", "array(float(id % 7), float(id % 11), 1f) as embedding").write.parquet(at)
    store = spark.read.parquet(at)
    asked = store.where("vec_id < 40").selectExpr("vec_id as query_id", "embedding as q")
    found = V.knn(asked, store, 4, query_block=10, page_rows=64)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FlatMapCoGroupsInArrow") == 1 and f"{at}" not in plan
    one = V.knn(asked, store, 4)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, one.collect()))


def test_numbers_within_groups_over_several_ranges(spark, small_ranges):
    """One group holds most rows and lies in several ranges; an outlying key changes no range."""
    rows = [("hot", (i * 7919) % 3000) for i in range(3000)] + [("hot", 10**15), (None, 3), (None, None), ("b", 1)]
    frame = spark.createDataFrame(rows, "host string, id long").repartition(4)
    dealt = R.in_ranges(frame, "host", "id")
    sizes = [r["count"] for r in dealt.groupBy("part").count().collect()]
    assert dealt.where("host = 'hot'").select("part").distinct().count() > 1 and max(sizes) < 2000
    out = R.numbered_within(frame, "host", F.asc_nulls_first("id")).collect()
    hot = sorted((r["n"], r["id"]) for r in out if r["host"] == "hot")
    assert hot == [(i + 1, i) for i in range(3000)] + [(3001, 10**15)]
    assert sorted((r["n"], r["id"]) for r in out if r["host"] is None) == [(1, None), (2, 3)]


def test_history_across_ranges(spark, small_ranges):
    """A conversation with a third of all rows is several ranges'; each range sees what came before it."""
    rng = np.random.default_rng(4)
    turns = [(7, t, ["user", "user", "assistant", "system"][rng.integers(0, 4)], f"m{t}") for t in range(1200)]
    turns += [(c, t, "user" if t % 2 == 0 else "assistant", f"{c} {t}") for c in range(100, 500) for t in range(6)] + [(None, 0, "user", "n"), (None, 1, "assistant", "m"), (None, 2, "user", "o")]
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(4)
    assert R.in_ranges(frame, F.asc_nulls_first("conv_id"), "turn").where("conv_id = 7").select("part").distinct().count() > 1
    want = {}
    for conv in {t[0] for t in turns}:
        spoken = [t for t in turns if t[0] == conv and t[2] != "system"]
        kept = [t[2] == "assistant" or (k + 1 < len(spoken) and spoken[k + 1][2] == "assistant") for k, t in enumerate(spoken)]
        want |= {(conv, t[1]): [s[3] for s, y in zip(spoken[:k], kept, strict=False) if y][-6:] for k, t in enumerate(spoken) if t[2] == "user"}
    out = A.chat_history(frame).collect()
    assert {(r.conv_id, r.turn): [m.text for m in r.history] for r in out} == want and len(out) == len(want)


def test_runs_of_pages_join_in_order(spark):
    pages = spark.createDataFrame([("a", p, f"<{p}>") for p in range(200, 0, -1)] + [("b", 1, "x")], "source string, page int, text string")
    out = {r["source"]: r for r in S.full_text(pages, run=7).collect()}
    assert out["a"]["full_text"] == "".join(f"<{p}>" for p in range(1, 201)) and out["b"]["prompt_text"] == "===== PAGE 1 =====\nx"
    assert out["a"]["prompt_text"] == "\n\n".join(f"===== PAGE {p} =====\n<{p}>" for p in range(1, 201))


def test_batches_of_embeddings(spark):
    rows = spark.createDataFrame([("s", p, p) for p in range(1, 8)] + [("t", 1, 100), ("t", 2, 101)], "source string, page int, vec_id long")
    batched = V.in_batches(rows, "source", "page", most=3)
    assert sorted((r["source"], r["page"], r["batch_no"]) for r in batched.collect())[:7] == [("s", p, (p - 1) // 3 + 1) for p in range(1, 8)]
    vectors = spark.createDataFrame([(i, [1.0, 2.0]) for i in (1, 2, 3, 4, 6, 7, 100)] + [(101, [1.0]), (5, None)], "vec_id long, embedding array<double>")
    report = V.batch_report(batched, vectors, "vec_id", "source")
    assert sorted(tuple(r) for r in report.collect()) == [("s", 1, 3, 0, 3, None), ("s", 2, 3, 1, 0, "missing vectors"), ("s", 3, 1, 0, 1, None), ("t", 1, 2, 0, 0, "mixed lengths")]
    assert tuple(V.batch_totals(report).first()) == (4, 2, 9, 4)
    assert tuple(V.batch_totals(report.limit(0)).first()) == (0, 0, 0, 0)


def test_an_append_reads_the_folders_it_touches(spark, tmp_path):
    """A second, small append opens few of the store's files; a batch of the ledger opens none."""
    at = str(tmp_path / "store")
    chunks = spark.range(400).selectExpr("sha2(string(id), 256) as chunk_id", "string(id) as source", "1 as page", "1 as chunk_no", "'t' as text")
    S.append_chunks(chunks, at, batch="first")
    few = chunks.where("source in ('5', '6', '400')").unionByName(chunks.where("source = '7'").withColumn("chunk_id", F.sha2(F.lit("new"), 256)))
    touched = {r["chunk_id"][:1] for r in few.collect()}
    there = spark.read.schema("chunk_id string, folder string").parquet(at).where(F.col("folder").isin(sorted(touched))).select("chunk_id", F.input_file_name().alias("f"))
    read = {r["f"].split("folder=")[1][0] for r in there.collect()}
    assert len(touched) <= 3 and read <= touched and "PartitionFilters: [folder" in there._jdf.queryExecution().executedPlan().toString()
    S.append_chunks(few, at, batch="second")
    assert S.read_store(spark, at).count() == 401
    S.append_chunks(chunks.withColumn("chunk_id", F.sha2(F.concat("chunk_id", F.lit("x")), 256)), at, batch="first")
    assert S.read_store(spark, at).count() == 401 and S.read_store(spark, at).columns == ["chunk_id", "source", "page", "chunk_no", "text"]


def test_requests_are_sent_again(spark):
    requests = spark.createDataFrame([(i, f"prompt {i}") for i in "abcdef"], "request_id string, prompt string")
    events = [("a", "sent"), ("a", "answered"), ("b", "sent"), ("b", "failed"), ("c", "sent"), *[("d", e) for e in ("sent", "failed") * 3], ("e", "sent"), ("e", "failed"), ("e", "sent"), ("x", "sent")]
    ledger = spark.createDataFrame(events, "request_id string, event string")
    assert {r["request_id"]: r["state"] for r in P.request_state(requests, ledger).collect()} == {"a": "answered", "b": "retry", "c": "pending", "d": "given_up", "e": "pending", "f": "new"}
    assert sorted(r["prompt"] for r in P.requests_to_send(requests, ledger).collect()) == ["prompt b", "prompt f"]
    back = P.answered_events(requests, spark.createDataFrame([("a", '{"x": 1}'), ("b", "no"), ("c", None), ("z", "{}")], "request_id string, response string"))
    assert sorted(tuple(r) for r in back.collect()) == [("a", "answered"), ("b", "failed"), ("c", "failed")]


def test_texts_of_pages_nobody_cites_stay(spark):
    pages = spark.createDataFrame([("s", p, f"text {p}") for p in range(50)], "source string, page int, text string")
    findings = spark.createDataFrame([("s", 1, "text 3", [3, 99]), ("s", 2, "zzz", [4])], "source string, finding int, excerpt string, pages array<int>")
    out = P.evidence_check(findings, pages)
    assert sorted((r["finding"], r["page"], r["verdict"]) for r in out.collect()) == [(1, 3, "ok"), (1, 99, "no_page"), (2, 4, "not_on_page")]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan


def test_a_path_without_papers_is_refused(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x")
    with pytest.raises(ValueError, match="neither"):
        S.require_papers(S.list_papers(spark, str(tmp_path)), str(tmp_path))


def test_late_turns_wait_for_earlier_ones(spark, tmp_path):
    """Micro-batches out of order, a turn that comes twice, and a gap that is never filled."""
    turns = [(1, t, "user" if t % 2 == 0 else "assistant", f"m{t}") for t in range(20)]
    late = [turns[10:20], turns[0:3] + turns[12:14], turns[3:10], [(2, 1, "user", "early")]]
    for number, rows in enumerate(late):
        spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/in/{number}")
    stream = spark.readStream.schema("conv_id long, turn long, role string, text string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    G.stream_chat_memory(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    out = {r["turn"]: r["history"] for r in spark.read.parquet(f"{tmp_path}/out").where("conv_id = 1").collect()}
    assert out == {t: "\n".join(f"{'user' if s % 2 == 0 else 'assistant'}: m{s}" for s in range(max(0, t - 6), t)) for t in range(0, 20, 2)}
    assert spark.read.parquet(f"{tmp_path}/out").where("conv_id = 2").count() == 0


def test_a_gap_is_given_up_after_patience(spark, tmp_path):
    import time

    rows = [(2, 1, "user", "early"), (2, 2, "assistant", "a"), (2, 4, "user", "q")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/in/0")
    stream = spark.readStream.schema("conv_id long, turn long, role string, text string").parquet(f"{tmp_path}/in/*")
    query = G.stream_chat_memory(stream, patience=500).writeStream.format("memory").queryName("patient").option("checkpointLocation", f"{tmp_path}/state").trigger(processingTime="1 second").start()
    until = time.time() + 90
    while spark.table("patient").count() < 2 and time.time() < until:
        time.sleep(1)
    query.stop()
    assert sorted(tuple(r) for r in spark.table("patient").collect()) == [(2, 1, 0, ""), (2, 4, 2, "user: early\nassistant: a")]


class States:
    """State of one conversation, as a processor's handle gives it; counts the calls."""

    def __init__(self):
        self.calls, self.there, self.timers = 0, {}, []

    def _state(self, name, *_):
        return State(self, name)

    getValueState = getListState = getMapState = _state

    def registerTimer(self, at):
        self.timers.append(at)


class State:
    def __init__(self, handle, name):
        self.handle, self.name = handle, name

    def __getattr__(self, call):
        self.handle.calls += 1
        there, name = self.handle.there, self.name
        return {
            "exists": lambda: bool(there.get(name)),
            "get": lambda: there.get(name),
            "put": lambda v: there.update({name: v}),
            "update": lambda v: there.update({name: v}),
            "getValue": lambda k: there.get(name, {}).get(k),
            "containsKey": lambda k: k in there.get(name, {}),
            "updateValue": lambda k, v: there.setdefault(name, {}).update({k: v}),
            "removeKey": lambda k: there[name].pop(k),
            "keys": lambda: iter(list(there.get(name, {}))),
        }[call]


class Now:
    getCurrentProcessingTimeInMs = staticmethod(lambda: 0)


def _talk(n):
    return [Row(conv_id=1, turn=t, role="user" if t % 2 == 0 else "assistant", text=f"m{t}") for t in range(n)]


def _answers(n):
    return [(t, "\n".join(f"{'user' if s % 2 == 0 else 'assistant'}: m{s}" for s in range(max(0, t - 6), t))) for t in range(0, n, 2)]


def test_a_conversation_costs_two_state_calls_a_micro_batch():
    states, memory, turns = States(), G.Memory(6, 0), _talk(8)
    memory.init(states)
    out = []
    for batch in (turns[5:], turns[2:4], turns[:2] + turns[4:5]):
        before = states.calls
        out += memory.handleInputRows((1,), iter(batch), Now)
        assert states.calls - before <= 2
    assert [(r["turn"], r["history"]) for r in out] == _answers(8)


@pytest.mark.parametrize("bounds", [{}, {"few": 3, "held": 7}, {"chars": 20}])
def test_early_turns_of_long_conversations_are_filed(bounds):
    """Turns in any order, each twice; every turn comes out once, and a file that was emptied is not asked again."""
    turns = _talk(600) * 2
    turns = [turns[i] for i in np.random.default_rng(3).permutation(len(turns))]
    states, memory, out = States(), G.Memory(6, 0, **bounds), []
    memory.init(states)
    for k in range(0, len(turns), 150):
        out += memory.handleInputRows((1,), iter(turns[k : k + 150]), Now)
    assert [(r["turn"], r["history"]) for r in out] == _answers(600)
    assert not states.there.get("filed")
    before = states.calls
    assert not list(memory.handleInputRows((1,), iter(_talk(3)), Now)) and states.calls - before == 2


@pytest.mark.parametrize("few", [64, 2])
def test_gaps_are_given_up_whether_turns_are_filed_or_not(few):
    states, memory = States(), G.Memory(6, 500, few=few)
    memory.init(states)
    rows = [r for r in _talk(30) if r["turn"] not in (0, 3, 11, 12)]
    assert not list(memory.handleInputRows((1,), iter(rows[::-1]), Now)) and states.timers == [500]
    out = list(memory.handleExpiredTimer((1,), Now, None))
    assert [r["turn"] for r in out] == [t for t in range(2, 30, 2) if t != 12] and out[-1]["history"] == _answers(30)[14][1]
    assert not states.there.get("filed") and not list(memory.handleExpiredTimer((1,), Now, None))


def test_the_chat_stream_has_four_micro_batches_of_many_files(spark, sf, tmp_path, monkeypatch):
    monkeypatch.setattr(registry.S, "scratch_path", lambda *_: f"{tmp_path}/stream")
    registry.queries()["stream_chat_memory"](spark, sf)
    assert len(list(tmp_path.glob("stream/in/**/part-*"))) > 4
    assert sorted(p.name for p in tmp_path.glob("stream/state/commits/[0-9]*")) == ["0", "1", "2", "3"]


def test_distances_are_held_a_tile_at_a_time():
    import tracemalloc

    rng = np.random.default_rng(1)
    q, e = rng.normal(size=(300, 4)), rng.normal(size=(20_000, 4))
    tracemalloc.start()
    near = V.Nearest(q, 6, "sql2")
    near.see(np.arange(len(e)), e)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    far = np.stack([((x - e) ** 2).sum(axis=1) for x in q])
    got = {}
    for whose, vec in zip(*(near.found(list(range(300)), (V.pa.int64(), V.pa.int64()))[c].to_pylist() for c in ("query_id", "vec_id"))):
        got.setdefault(whose, []).append(vec)
    assert got == {i: np.argsort(row)[:6].tolist() for i, row in enumerate(far)}
    assert peak < 30_000_000


def test_small_blocks_of_queries_do_not_copy_the_store(spark):
    store = spark.range(400).selectExpr("id as vec_id", "array(float(id % 7), float(id % 11), 1f) as embedding")
    asked = store.where("vec_id < 200").selectExpr("vec_id as query_id", "embedding as q")
    plan = V.knn(asked, store, 4, query_block=2, page_rows=64)._jdf.queryExecution().analyzed().toString()
    assert "0" in re.findall(r"explode\(sequence\(0, (\d+)", plan)  # one lot, so one copy of each page


def counting(spark, rows, column):
    """``rows`` whose ``column`` counts each time that it is computed, and the counter."""
    seen = spark.sparkContext.accumulator(0)

    def count(x):
        seen.add(1)
        return x

    return rows.withColumn(column, F.udf(count, rows.schema[column].dataType)(column)), seen


def test_batches_compute_their_rows_once(spark):
    rows, seen = counting(spark, spark.createDataFrame([("a", i, f"t{i}") for i in range(50)], "source string, page int, text string"), "text")
    assert V.in_batches(rows, "source", "page", most=8).where("text is not null").count() == 50 and seen.value == 50


def test_batch_report_joins_lengths_not_vectors(spark):
    rows = spark.createDataFrame([("a", 1, 0), ("a", 1, 1), ("b", 1, 2), ("b", 2, 3)], "source string, batch_no long, vec_id int")
    vectors = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (2, [1.0, 2.0]), (3, None)], "vec_id int, embedding array<double>")
    report = V.batch_report(rows, vectors, "vec_id", "source")
    plan = report._jdf.queryExecution().optimizedPlan().toString()
    assert "embedding" not in plan[plan.index("Join") : plan.index("\n", plan.index("Join"))] and "embedding" not in plan.split("Join")[0]
    assert sorted(map(tuple, report.collect()), key=repr) == [("a", 1, 2, 0, 2, None), ("b", 1, 1, 0, 1, None), ("b", 2, 1, 1, 0, "missing vectors")]


def answered(spark):
    papers = spark.createDataFrame([(f"p{i}.pdf", f"P{i}", "x" * 300) for i in range(20)], "path string, title string, full_text string")
    responses, seen = counting(spark, papers.select("path", F.lit('{"authors": []}').alias("response")), "response")
    return P.paper_records(papers, responses), seen


def test_review_list_reads_answers_once(spark):
    records, seen = answered(spark)
    assert P.review_list(records, "then").count() == 21 and seen.value == 20


def test_reports_read_answers_once(spark, tmp_path):
    records, seen = answered(spark)
    P.write_reports(records, str(tmp_path / "reports"), "then")
    assert spark.read.json(f"{tmp_path}/reports/records").count() == 20 and seen.value == 20


def test_store_steps_make_chunks_once(spark, sf, monkeypatch):
    chunks, seen = counting(spark, registry.doc_chunks(spark, sf), "text")
    n = registry.doc_chunks(spark, sf).count()
    monkeypatch.setattr(registry, "doc_chunks", lambda *_: chunks)
    registry.queries()["store_steps"](spark, sf)
    assert seen.value < 2 * n  # a filter and what it filters compute the column each
