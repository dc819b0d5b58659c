"""Queries over the driver's tables and the SQL that each must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions import records as R
from scriptorium.functions import text as T
from scriptorium.operators import answers as A
from scriptorium.operators import chunks as C
from scriptorium.operators import papers as P
from scriptorium.operators import vectors as V
from scriptorium.plans import fixtures as X
from scriptorium.plans import oracle as O
from scriptorium.sources import papers as S
from scriptorium.sources.scratch import stored
from scriptorium.streaming import ingest as G

SYSTEM = "你是论文分析助手。"
_Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def register(sql: str | None = None):
    """Register a query under its function's name, with its SQL if it has one."""

    def add(f):
        _Q[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return S.spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def doc_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.pages_from_documents(read(spark, sf_dir, "documents"))


def doc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.chunk_pages(doc_pages(spark, sf_dir))


# pages and chunks


@register(f"select source, count(*) as pages, sum(length(text))::bigint as chars from ({O.pages()}) group by source")
def list_sources(spark, sf_dir):
    return doc_pages(spark, sf_dir).groupBy("source").agg(F.count("*").alias("pages"), F.sum(F.length("text")).alias("chars"))


@register(O.pages())
def document_pages(spark, sf_dir):
    return doc_pages(spark, sf_dir)


@register("select regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) as source, row_number() over (partition by regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) order by page_id)::int as page, page_id, html as text from pages")
def html_pages(spark, sf_dir):
    return S.pages_from_html(read(spark, sf_dir, "pages"))


_WHOLE = f"select source, coalesce(string_agg(text, '' order by page), '') as full_text, string_agg('===== PAGE ' || page || ' =====' || chr(10) || text, chr(10) || chr(10) order by page) as prompt_text from ({O.pages()}) group by source"


@register(f"select source, full_text from ({_WHOLE})")
def full_text(spark, sf_dir):
    return S.full_text(doc_pages(spark, sf_dir)).select("source", "full_text")


@register(f"select source, prompt_text from ({_WHOLE})")
def prompt_text(spark, sf_dir):
    return S.full_text(doc_pages(spark, sf_dir)).select("source", "prompt_text")


_REQUEST = P.REQUEST.format(topic="topic", fields="\n".join(f"- {k}：{v}" for k, v in P.FIELD_HELP.items()))


@register(f"select sha256(source) as request_id, source as path, {O.lit(P.SYSTEM)} as system_prompt, {O.lit(_REQUEST)} || source || chr(10) || '内容：' || chr(10) || prompt_text as prompt from ({_WHOLE}) where length({O.strip('full_text')}) >= 200")
def request_prompts(spark, sf_dir):
    whole = S.full_text(doc_pages(spark, sf_dir))
    return P.request_prompts(whole.withColumnsRenamed({"source": "path"}).withColumn("title", F.col("path")), "topic")


# what became of requests: documents' numbers say how often each was sent and failed, and which were answered
_EVENTS = """(select doc_id, unnest(list_concat(list_resize(['sent'], greatest(doc_id % 5, 1), 'sent'), list_resize(['failed'], greatest(doc_id % 4, 1), 'failed'), case when doc_id % 7 = 3 then ['answered'] else [] end)) as event
  from documents where doc_id % 6 <> 0)"""
_STATE = f"""select sha256(doc_id::varchar) as request_id, doc_id, count(*) filter (event = 'sent') as sent, count(*) filter (event = 'failed') as failed,
  case when count(*) filter (event = 'answered') > 0 then 'answered' when count(*) filter (event = 'failed') >= 3 then 'given_up' when count(*) filter (event = 'sent') > count(*) filter (event = 'failed') then 'pending'
    when count(*) filter (event = 'failed') > 0 then 'retry' else 'new' end as state from (select doc_id from documents) left join {_EVENTS} using (doc_id) group by doc_id"""


def _ledger(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Requests, and a ledger of events that was written and read back."""
    docs = read(spark, sf_dir, "documents").select("doc_id")
    requests = docs.select(F.sha2(F.col("doc_id").cast("string"), 256).alias("request_id"), "doc_id")
    times = lambda word, n: F.array_repeat(F.lit(word), F.greatest(F.col("doc_id") % n, F.lit(1)).cast("int"))
    events = F.concat(times("sent", 5), times("failed", 4), F.when(F.col("doc_id") % 7 == 3, F.array(F.lit("answered"))).otherwise(F.array().cast("array<string>")))
    at = S.scratch_path(spark, "ledger")
    P.append_events(requests.where("doc_id % 6 <> 0").select("request_id", F.explode(events).alias("event")), at)
    return requests, spark.read.parquet(at)


@register(f"select request_id, sent, failed, state from ({_STATE})")
def request_state(spark, sf_dir):
    return P.request_state(*_ledger(spark, sf_dir))


@register(f"select request_id, doc_id from ({_STATE}) where state in ('new', 'retry')")
def requests_to_send(spark, sf_dir):
    return P.requests_to_send(*_ledger(spark, sf_dir))


@register(f"select sha256(path) as request_id, case when j is not null then 'answered' else 'failed' end as event from ({O.answers(X.ANSWERED)})")
def answered_events(spark, sf_dir):
    papers = X.papers(spark, sf_dir).withColumn("request_id", F.sha2("path", 256))
    return P.answered_events(papers.select("request_id"), papers.select("request_id", "response"))


@register(f"select doc_id, {O.clean('body')} as text from ({X.CAPTIONED})")
def clean_pages(spark, sf_dir):
    return X.derived(spark, sf_dir, X.CAPTIONED).select("doc_id", T.clean_text(F.col("body")).alias("text"))


@register(f"select page_id, {O.sub('html', '<[^>]+>', '')} as text from pages")
def strip_tags(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", T.strip_tags(F.col("html")).alias("text"))


@register(O.chunks())
def chunk_pages(spark, sf_dir):
    return doc_chunks(spark, sf_dir)


def _measures(c: str) -> str:
    return f"""length({c})::int as chars, {O.chars(c, T.DIGIT)}::int as digits, {O.chars(c, "[" + chr(92) + "p{L}]")}::int as letters, {O.chars(c, T.CJK)}::int as cjk, {O.english(c)}::int as english,
  {O.pieces(c, "[.!?。！？]+", 10)}::int as sentences, len({O.filled(c)})::int as lines, (len(string_split({c}, '<br>')) - 1)::int as breaks, {O.short_lines(c)} as short_lines"""


@register(f"select doc_id, {_measures('t')} from (select doc_id, {O.clean('body')} as t from ({X.CAPTIONED}))")
def chunk_measures(spark, sf_dir):
    t = F.col("t")
    rows = X.derived(spark, sf_dir, X.CAPTIONED).select("doc_id", T.clean_text(F.col("body")).alias("t"))
    return rows.select(
        "doc_id", F.length(t).alias("chars"), T.digits(t).alias("digits"), T.count_chars(t, r"[\p{L}]").alias("letters"), T.count_chars(t, T.CJK).alias("cjk"), T.english_words(t).alias("english"),
        T.pieces(t, ".!?。！？", 10).alias("sentences"), T.line_count(t).alias("lines"), T.breaks(t).alias("breaks"), T.too_many_short_lines(t).alias("short_lines"),
    )


@register(f"select doc_id, {O.caption('t')} as caption, {O.reason('t')} as reason from (select doc_id, {O.clean('body')} as t from ({X.CAPTIONED}))")
def caption_flags(spark, sf_dir):
    rows = X.derived(spark, sf_dir, X.CAPTIONED).select("doc_id", T.clean_text(F.col("body")).alias("t"))
    return rows.select("doc_id", T.is_figure_caption(F.col("t")).alias("caption"), T.reject_reason(F.col("t")).alias("reason"))


@register(f"select {O.reason('text')} as reason, count(*) as chunks from ({O.chunks()}) group by 1")
def quality_funnel(spark, sf_dir):
    return C.with_reason(doc_chunks(spark, sf_dir)).groupBy("reason").agg(F.count("*").alias("chunks"))


@register(O.kept())
def kept_chunks(spark, sf_dir):
    return C.kept_chunks(doc_chunks(spark, sf_dir))


@register(f"select distinct source from ({O.pages()}) where source not in (select source from ({O.kept()}))")
def papers_without_chunks(spark, sf_dir):
    return C.papers_without_chunks(doc_pages(spark, sf_dir))


@register(f"select count(*) as papers, count(n) as papers_with_chunks, coalesce(sum(n), 0)::bigint as chunks from (select distinct source from ({O.pages()})) left join (select source, count(*) as n from ({O.kept()}) group by source) using (source)")
def ingest_totals(spark, sf_dir):
    return C.ingest_totals(doc_pages(spark, sf_dir))


@register(f"select sha256(source || '|' || page || '|' || chunk_no || '|' || text) as chunk_id, source, page, chunk_no, text from ({O.kept()})")
def chunk_ids(spark, sf_dir):
    return C.with_ids(C.kept_chunks(doc_chunks(spark, sf_dir)))


# vectors and answers


@register(
    """with t as (select doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}_]+'), lambda x: x <> '')) as t from documents where text is not null),
c as (select doc_id, (('0x' || substr(md5(t), 1, 8))::bigint % 64)::int as bucket, count(*) as n from t group by 1, 2)
select doc_id, bucket, round(n / sqrt(sum(n * n) over (partition by doc_id)::double), 9) as weight from c"""
)
def hash_vectors(spark, sf_dir):
    return V.hash_vectors(read(spark, sf_dir, "documents"), "doc_id", "text").withColumn("weight", F.round("weight", 9))


@register("select min(len(embedding))::int as shortest, max(len(embedding))::int as longest, count(*) filter (embedding is null) as missing, count(*) as vectors from embeddings")
def vector_profile(spark, sf_dir):
    return V.vector_profile(read(spark, sf_dir, "embeddings"))


def _knn_sql(distance: str, k: int = 6) -> str:
    return f"""select query_id, rank::int as rank, vec_id, round(d, 4) + 0.0 as distance from (select query_id, vec_id, d, row_number() over (partition by query_id order by d, vec_id) as rank from (
  select q.vec_id as query_id, e.vec_id, {distance} as d from (select * from embeddings where vec_id % 100 = 0) q, embeddings e)) where rank <= {k}"""


_DIFF = "list_sum(list_transform(range(1, len(e.embedding) + 1), lambda i: (q.embedding[i]::double - e.embedding[i]::double) * (q.embedding[i]::double - e.embedding[i]::double)))"
_DOT = "list_sum(list_transform(range(1, len(e.embedding) + 1), lambda i: {0}.embedding[i]::double * {1}.embedding[i]::double))"


def _hits(spark, sf_dir, metric: str) -> DataFrame:
    store = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    asked = store.where(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return V.knn(asked, store, 6, metric)


@register(_knn_sql(_DIFF))
def knn_top6(spark, sf_dir):
    return _hits(spark, sf_dir, "sql2").withColumn("distance", F.round("distance", 4) + F.lit(0.0))


@register(_knn_sql(f"1 - {_DOT.format('q', 'e')} / (sqrt({_DOT.format('q', 'q')}) * sqrt({_DOT.format('e', 'e')}))"))
def knn_cosine(spark, sf_dir):
    return _hits(spark, sf_dir, "cosine").withColumn("distance", F.round("distance", 4) + F.lit(0.0))


_ODD = "case when vec_id % 7 = 3 then null when vec_id % 7 = 4 then list_transform(embedding, lambda x, i: case when i = 2 then null else x end) else embedding end"


@register(
    _knn_sql(_DIFF).replace("from embeddings where", f"from (select vec_id, {_ODD} as embedding from embeddings where vec_id % 7 not in (3, 4)) where").replace(", embeddings e", f", (select vec_id, {_ODD} as embedding from embeddings where vec_id % 7 not in (3, 4)) e")
)
def knn_odd_vectors(spark, sf_dir):
    """As knn_top6 where two of seven vectors are null or hold a null: they take no part."""
    odd = F.when(F.col("vec_id") % 7 == 4, F.transform("embedding", lambda x, i: F.when(i != 1, x))).when(F.col("vec_id") % 7 != 3, F.col("embedding"))
    store = read(spark, sf_dir, "embeddings").select("vec_id", odd.alias("embedding"))
    asked = store.where(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return V.knn(asked, store, 6).withColumn("distance", F.round("distance", 4) + F.lit(0.0))


@register(_knn_sql(_DIFF))
def knn_blocks(spark, sf_dir):
    """As knn_top6 with queries in blocks beside the store: more than one block at any size."""
    store = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    asked = store.where(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return V.knn(asked, store, 6, query_block=2, page_rows=256).withColumn("distance", F.round("distance", 4) + F.lit(0.0))


# a chunk's vector is that of row (chunk_id's first digits) % 500, where there is one; some calls fail
_ASKED = f"""(select source, page, chunk_no, (('0x' || substr(sha256(source || '|' || page || '|' || chunk_no || '|' || text), 1, 7))::bigint % 500) as vec_id,
  ((row_number() over (partition by source order by page, chunk_no) - 1) // 8 + 1)::bigint as batch_no from ({O.kept()}))"""
_ANSWERS = "(select vec_id, max(embedding) as embedding from embeddings where vec_id % 37 <> 5 and embedding is not null group by vec_id)"
_REPORT = f"""select source, batch_no, count(*) as sent, count(*) filter (e.embedding is null) as missing, case when count(*) filter (e.embedding is null) > 0 or min(len(e.embedding)) <> max(len(e.embedding)) then 0 else count(*) end as stored,
  case when count(*) filter (e.embedding is null) > 0 then 'missing vectors' when min(len(e.embedding)) <> max(len(e.embedding)) then 'mixed lengths' end as failure from {_ASKED} a left join {_ANSWERS} e using (vec_id) group by source, batch_no"""


def _asked(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Kept chunks, without their texts, in batches of 8 a source, each with the number of its vector; and the vectors that came back."""
    chunks = C.with_ids(C.kept_chunks(doc_chunks(spark, sf_dir)))
    number = F.conv(F.substring("chunk_id", 1, 7), 16, 10).cast("long") % 500
    return V.in_batches(chunks.select("source", "page", "chunk_no", number.alias("vec_id")), "source", "page", "chunk_no", most=8), read(spark, sf_dir, "embeddings").where("vec_id % 37 <> 5")


@register(f"select source, batch_no, page, chunk_no, embedding[1] as first from {_ASKED} join {_ANSWERS} using (vec_id) semi join (select source, batch_no from ({_REPORT}) where failure is null) using (source, batch_no)")
def embedded_chunks(spark, sf_dir):
    """Kept chunks of whole batches with their vectors."""
    chunks, vectors = _asked(spark, sf_dir)
    whole = chunks.withColumn("call", F.concat_ws("|", "source", "batch_no"))
    return V.embed_from(whole, vectors, "vec_id", "call").select("source", "batch_no", "page", "chunk_no", F.get("embedding", F.lit(0)).alias("first"))


@register(_REPORT)
def embedding_batches(spark, sf_dir):
    return V.batch_report(*_asked(spark, sf_dir), "vec_id", "source")


@register(f"select count(*) as batches, count(failure) as failed_batches, coalesce(sum(sent), 0)::bigint as sent, coalesce(sum(stored), 0)::bigint as stored from ({_REPORT})")
def embedding_totals(spark, sf_dir):
    return V.batch_totals(V.batch_report(*_asked(spark, sf_dir), "vec_id", "source"))


_FOUND = f"select h.query_id, h.rank, d.doc_id::varchar as source, 1 as page, d.text, h.distance from ({_knn_sql(_DIFF)}) h join documents d on d.doc_id = h.vec_id"
_CONTEXT = f"""select query_id, string_agg('[片段 ' || rank || '] 来源: ' || source || ', 页码: ' || page || ', distance: ' || printf('%.4f', distance) || chr(10) || '片段内容: ' || {O.sub('text', '<[^>]+>', '')}, chr(10) || chr(10) order by rank) as context
from ({_FOUND}) group by query_id"""


def found(spark, sf_dir) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), "text")
    hits = _hits(spark, sf_dir, "sql2").withColumn("distance", F.round("distance", 4) + F.lit(0.0))
    return hits.join(docs, "vec_id").select("query_id", "rank", F.col("vec_id").cast("string").alias("source"), F.lit(1).alias("page"), "text", "distance")


@register(_CONTEXT)
def context_blocks(spark, sf_dir):
    return A.context_blocks(found(spark, sf_dir))


@register(f"select query_id, {O.lit(A.RULES)} || context as system_prompt from ({_CONTEXT})")
def answer_prompts(spark, sf_dir):
    return A.answer_prompts(A.context_blocks(found(spark, sf_dir)))


@register(f"select query_id, rank, case when length(text) > 300 then substr(text, 1, 300) || '...' else text end as preview from ({_FOUND})")
def hit_previews(spark, sf_dir):
    return A.hit_previews(found(spark, sf_dir))


_HISTORY = """select conv_id, turn, question, list_slice(h, greatest(len(h) - 5, 1), len(h)) as history from (
  select conv_id, turn, role, text as question, coalesce(list(case when role = 'assistant' or nxt = 'assistant' then {'role': role, 'text': text} end) filter (role = 'assistant' or nxt = 'assistant')
    over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding), []) as h
  from (select *, lead(role) over (partition by conv_id order by turn) as nxt from conversations where role in ('user', 'assistant'))) where role = 'user'"""
_SPOKEN = "coalesce(array_to_string(list_transform(history, lambda m: (case when m.role = 'user' then '用户: ' else '助手: ' end) || m.text || chr(10)), ''), '')"


def _history(spark, sf_dir) -> DataFrame:
    return A.chat_history(read(spark, sf_dir, "conversations"))


@register(f"select conv_id, turn, len(history)::int as n_history, {_SPOKEN} as history from ({_HISTORY})")
def chat_history(spark, sf_dir):
    return _history(spark, sf_dir).select("conv_id", "turn", F.size("history").alias("n_history"), A.spoken_lines(F.col("history")).alias("history"))


@register(f"select conv_id, turn, case when len(history) > 0 then {O.lit(A.REWRITE)} || {_SPOKEN} || chr(10) || '最新问题：' || question end as prompt, question from ({_HISTORY})")
def rewrite_requests(spark, sf_dir):
    return A.rewrite_requests(_history(spark, sf_dir))


@register(f"select conv_id, turn, case when len(history) > 0 and turn % 3 <> 1 then trim(case turn % 3 when 0 then '  ' || question || ' (whole) ' else question || '?' end) else question end as question from ({_HISTORY})")
def rewritten(spark, sf_dir):
    """Requests of two turns of three are answered."""
    requests = A.rewrite_requests(_history(spark, sf_dir))
    asked = requests.where("prompt IS NOT NULL AND turn % 3 <> 1")
    text = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("  "), "question", F.lit(" (whole) "))).otherwise(F.concat("question", F.lit("?")))
    return A.rewritten(requests, asked.select("conv_id", "turn", text.alias("response")))


@register(f"select conv_id, turn, (len(history) + 2)::int as messages, 'system: {SYSTEM}' || chr(10) || coalesce(array_to_string(list_transform(history, lambda m: m.role || ': ' || m.text || chr(10)), ''), '') || 'user: ' || question as joined from ({_HISTORY})")
def chat_messages(spark, sf_dir):
    rows = A.chat_messages(_history(spark, sf_dir), SYSTEM)
    return rows.select("conv_id", "turn", F.size("messages").alias("messages"), F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(": "), m["text"])), "\n").alias("joined"))


# papers and their answers

_ANS = O.answers(X.ANSWERED)


@register(f"select path, scan, case when scan then '疑似扫描版（提取文本仅 ' || length({O.strip('body')}) || ' 字符）' end as reason from ({_ANS})")
def scan_gate(spark, sf_dir):
    t = F.col("full_text")
    reason = F.concat(F.lit("疑似扫描版（提取文本仅 "), F.length(T.strip(t)).cast("string"), F.lit(" 字符）"))
    return X.papers(spark, sf_dir).select("path", P.is_scan(t).alias("scan"), F.when(P.is_scan(t), reason).alias("reason"))


@register(f"select path, ({O.dois('body')})[1] as doi, {O.doi_status('body')} as doi_status, len(list_distinct({O.dois('body')}))::int as n_distinct_doi from ({X.ANSWERED})")
def doi(spark, sf_dir):
    t = F.col("full_text")
    return X.papers(spark, sf_dir).select("path", T.doi(t).alias("doi"), T.doi_status(t).alias("doi_status"), F.size(F.array_distinct(T.dois(t))).alias("n_distinct_doi"))


def _parsed(spark, sf_dir) -> DataFrame:
    return X.papers(spark, sf_dir).select("path", "response", R.parse_response(F.col("response")).alias("v"))


@register(f"select path, j is not null as parsed, json_extract_string(j, '$.extracted_title') as title, json_extract_string(j, '$.year') as year from ({_ANS})")
def response_json(spark, sf_dir):
    return _parsed(spark, sf_dir).select("path", F.col("v").isNotNull().alias("parsed"), R.text(F.col("v"), "extracted_title").alias("title"), R.text(F.col("v"), "year").alias("year"))


@register(f"select path, array_to_string({O.string_list('j', 'authors')}, '|') as authors, array_to_string({O.string_list('j', 'research_question')}, '|') as question from ({_ANS}) where j is not null")
def string_lists(spark, sf_dir):
    lists = [F.array_join(R.string_list(R.field(F.col("v"), f)), "|") for f in ("authors", "research_question")]
    return _parsed(spark, sf_dir).where("v IS NOT NULL").select("path", lists[0].alias("authors"), lists[1].alias("question"))


@register(
    f"""select path, case json_type(j, '$.research_method') when 'OBJECT' then coalesce(json_extract_string(j, '$.research_method.text'), '') when 'VARCHAR' then json_extract_string(j, '$.research_method') else '' end as text,
  array_to_string({O.page_list('j', '$.research_method.evidence_pages')}, ',') as pages, coalesce(json_extract_string(j, '$.research_method.evidence_excerpt'), '') as excerpt from ({_ANS}) where j is not null"""
)
def evidence_single(spark, sf_dir):
    e = R.evidence(R.field(F.col("v"), "research_method"))
    return _parsed(spark, sf_dir).where("v IS NOT NULL").select("path", e["text"].alias("text"), F.array_join(e["evidence_pages"].cast("array<string>"), ",").alias("pages"), e["evidence_excerpt"].alias("excerpt"))


_FINDINGS = f"""select path, i::int as finding, case when json_type(e) = 'OBJECT' then coalesce(json_extract_string(e, '$.text'), '') else json_extract_string(e, '$') end as text,
  array_to_string({O.page_list('e', '$.evidence_pages')}, ',') as pages, coalesce(json_extract_string(e, '$.evidence_excerpt'), '') as excerpt
from (select path, unnest(es) as e, unnest(range(1, len(es) + 1)) as i from (select path, list_filter(case json_type(j, '$.key_findings') when 'ARRAY' then json_extract(j, '$.key_findings[*]')
  when 'VARCHAR' then [json_extract(j, '$.key_findings')] else []::json[] end, lambda e: json_type(e) in ('OBJECT', 'VARCHAR')) as es from ({_ANS}) where j is not null))"""


@register(_FINDINGS)
def evidence_list(spark, sf_dir):
    rows = _parsed(spark, sf_dir).where("v IS NOT NULL").select("path", F.posexplode(R.evidence_list(R.field(F.col("v"), "key_findings"))).alias("i", "e"))
    return rows.select("path", (F.col("i") + 1).alias("finding"), F.col("e.text").alias("text"), F.array_join(F.col("e.evidence_pages").cast("array<string>"), ",").alias("pages"), F.col("e.evidence_excerpt").alias("excerpt"))


@register(f"select path, array_to_string(case when len({O.string_list('j', 'limitations_reported')}) = 0 then {O.string_list('j', 'limitations')} else {O.string_list('j', 'limitations_reported')} end, '|') as limitations from ({_ANS}) where j is not null")
def legacy_limitations(spark, sf_dir):
    return _parsed(spark, sf_dir).where("v IS NOT NULL").select("path", F.array_join(R.limitations(F.col("v")), "|").alias("limitations"))


def _known(c: str) -> str:
    return f"case when {O.strip(c)} in ('', 'null', 'None', '未识别', '未明确提及') then null else {c} end"


@register(f"select path, {_known(chr(34) + 'y' + chr(34))} as year, {_known('jo')} as journal from (select path, json_extract_string(j, '$.year') as y, json_extract_string(j, '$.journal') as jo from ({_ANS}) where j is not null)")
def null_tokens(spark, sf_dir):
    v = F.col("v")
    return _parsed(spark, sf_dir).where("v IS NOT NULL").select("path", R.known_or_null(R.text(v, "year")).alias("year"), R.known_or_null(R.text(v, "journal")).alias("journal"))


_RECORD = f"""select path, scan, j, response, body, not scan and j is null as failed, case when scan or j is null then path else json_extract_string(j, '$.extracted_title') end as title,
  case when scan or j is null then []::varchar[] else {O.string_list('j', 'authors')} end as authors, case when scan or j is null then null else {_known("json_extract_string(j, '$.year')")} end as year,
  {O.doi_status('body')} as doi_status, ({O.dois('body')})[1] as doi from ({_ANS})"""
_REASONS = f"""select *, case when scan then ['疑似扫描版（提取文本仅 ' || length({O.strip('body')}) || ' 字符）'] else list_filter([case when failed then 'JSON 解析失败' end,
  case when coalesce(title, '') in ('', '未识别', '未明确提及') then '标题未识别' end, case when len(authors) = 0 then '作者未识别' end, case when year is null then '年份未识别' end,
  case when doi_status = '未找到' then 'DOI 未找到' end], lambda x: x is not null) end as reasons from ({_RECORD})"""


def records(spark, sf_dir) -> DataFrame:
    papers = X.papers(spark, sf_dir)
    return P.paper_records(papers.drop("response"), papers.select("path", "response"))


@register(f"select path, array_to_string(reasons, '|') as reasons, len(reasons) > 0 as needs_review from ({_REASONS})")
def review_reasons(spark, sf_dir):
    return records(spark, sf_dir).select("path", F.array_join("reasons", "|").alias("reasons"), "needs_review")


@register(f"select reason, count(*) as n from (select unnest(reasons) as reason from ({_REASONS})) group by 1")
def review_reason_counts(spark, sf_dir):
    return P.review_reason_counts(records(spark, sf_dir))


@register(f"select count(*) as total, count(*) filter (len(reasons) = 0) as normal, count(*) filter (len(reasons) > 0) as review from ({_REASONS})")
def run_summary(spark, sf_dir):
    return P.run_summary(records(spark, sf_dir))


@register(
    f"""select path, path as original_filename, title as extracted_title, array_to_string(authors, '|') as authors, year, doi, doi_status, case when scan then substr(body, 1, 500) end as raw_text,
  case when failed then substr(response, 1, 1000) end as raw_llm_response, len(reasons) > 0 as needs_review from ({_REASONS})"""
)
def paper_records(spark, sf_dir):
    rows = records(spark, sf_dir).withColumn("authors", F.array_join("authors", "|"))
    return rows.select("path", "original_filename", "extracted_title", "authors", "year", "doi", "doi_status", "raw_text", "raw_llm_response", "needs_review")


def _numbered(path: str) -> str:
    x = O.string_list("j", path)
    return f"case when scan or j is null then '' else coalesce(array_to_string(list_transform({x}, lambda v, i: i || '. ' || v), chr(10)), '') end"


def _evidence_sql(name: str) -> str:
    """Markdown of one evidence field: text, pages, excerpt."""
    at = f"$.{name}"
    text = f"case json_type(j, '{at}') when 'OBJECT' then coalesce(json_extract_string(j, '{at}.text'), '') when 'VARCHAR' then json_extract_string(j, '{at}') else '' end"
    pages, excerpt = O.page_list("j", f"{at}.evidence_pages"), f"json_extract_string(j, '{at}.evidence_excerpt')"
    shown = f"({text}) || case when len({pages}) > 0 then chr(10) || '   - 证据页码：第 ' || array_to_string({pages}, ', ') || ' 页' else '' end || case when {excerpt} <> '' then chr(10) || '   - 原文依据：' || {excerpt} else '' end"
    return f"case when scan or j is null then '' else {shown} end"


def _or(c: str, other: str) -> str:
    return f"coalesce(nullif({c}, ''), {O.lit(other)})"


_SECTIONS = [
    ("研究背景", _numbered("research_background")), ("研究问题", _numbered("research_question")), ("研究目标", _numbered("research_objective")), ("研究方法", _evidence_sql("research_method")),
    ("模型或理论框架", _numbered("model_or_framework")), ("数据来源", _evidence_sql("data_source")), ("实验或研究设计", _numbered("experimental_design")), ("分析流程", _numbered("analysis_process")),
    ("主要发现", "case when failed then '1. ' when scan then '' else coalesce(g.md, '') end"), ("研究贡献", _numbered("contributions")),
]
_LIMITS = f"case when scan or j is null then '' else coalesce(array_to_string(list_transform(case when len({O.string_list('j', 'limitations_reported')}) = 0 then {O.string_list('j', 'limitations')} else {O.string_list('j', 'limitations_reported')} end, lambda v, i: i || '. ' || v), chr(10)), '') end"
_BREAK = " || chr(10) || chr(10) || "
_HEAD = " || chr(10) || ".join(
    f"'- {k}：' || {v}"
    for k, v in (("作者", _or("array_to_string(authors, '、')", "未识别")), ("年份", _or("year", "未识别")), ("期刊/来源", _or("journal", "未识别")), ("DOI", _or("doi", "—")), ("DOI 状态", "doi_status"))
)
_CARD = _BREAK.join(
    ["'# ' || coalesce(title, path)", f"'## 一、基本信息'{_BREAK}{_HEAD}"]
    + [f"'## {k}' || chr(10) || {v}" for k, v in _SECTIONS]
    + ["'## 研究局限'", f"'### 作者明确提出的局限' || chr(10) || {_or(_LIMITS, '未识别到作者明确陈述的研究局限。')}", f"'### 模型基于论文内容推断的局限' || chr(10) || {_or(_numbered('limitations_inferred'), '暂无推断内容。')}"]
    + ["'> 注意：以上推断内容不是论文作者的直接表述，正式引用前需要核对原文。'", f"'## 相关性评分' || chr(10) || {_numbered('relevance_score')}", "'## 文件路径' || chr(10) || path || chr(10)"]
)


def _cell(name: str) -> str:
    """One evidence field as a cell: text, and pages in brackets."""
    at = f"$.{name}"
    text = f"case json_type(j, '{at}') when 'OBJECT' then coalesce(json_extract_string(j, '{at}.text'), '') when 'VARCHAR' then json_extract_string(j, '{at}') else '' end"
    pages = O.page_list("j", f"{at}.evidence_pages")
    return f"case when scan or j is null then '' else ({text}) || case when len({pages}) > 0 then '（第' || array_to_string({pages}, ', ') || '页）' else '' end end"


_JOURNAL = f"case when scan or j is null then null else {_known("json_extract_string(j, '$.journal')")} end"
_COLUMNS = ", ".join(
    {"original_filename": "r.path as original_filename", "extracted_title": "title as extracted_title", "authors": "array_to_string(authors, '；') as authors", "journal": f"{_JOURNAL} as journal", "path": "r.path",
     "limitations_reported": f"{_LIMITS} as limitations_reported", "key_findings": "case when failed then '1. ' when scan then '' else coalesce(g.cell, '') end as key_findings"}.get(c)
    or (c if c in ("year", "doi", "doi_status") else f"{_cell(c) if c in ('research_method', 'data_source') else _numbered(c)} as {c}")
    for c in P.SUMMARY
)


@register(
    f"""with f as ({_FINDINGS}), g as (select path, string_agg(finding || '. ' || text || case when pages <> '' then '（第' || replace(pages, ',', ', ') || '页）' else '' end, chr(10) order by finding) as cell from f group by path)
select {_COLUMNS} from ({_REASONS}) r left join g using (path)"""
)
def summary_rows(spark, sf_dir):
    return P.summary_rows(records(spark, sf_dir))


@register(
    f"""with f as ({_FINDINGS}), g as (select path, string_agg(finding || '. ' || text || case when pages <> '' then chr(10) || '   - 证据页码：第 ' || replace(pages, ',', ', ') || ' 页' else '' end ||
    case when excerpt <> '' then chr(10) || '   - 原文依据：' || excerpt else '' end, chr(10) order by finding) as md from f group by path),
r as (select *, case when scan or j is null then null else {_known("json_extract_string(j, '$.journal')")} end as journal from ({_REASONS})),
c as (select path, substr({O.sub("coalesce(nullif(title, ''), path)", T.UNSAFE, "-")}, 1, 100) || '.md' as file_name, {_CARD} as markdown from r left join g using (path))
select file_name, arg_max(markdown, path) as markdown from c group by file_name"""
)
def markdown_cards(spark, sf_dir):
    return P.markdown_cards(records(spark, sf_dir))


@register(
    f"""select row_number() over (order by path) as n, path, '## ' || row_number() over (order by path) || '. ' || path || chr(10) || chr(10) || '**触发原因：**' || chr(10) || array_to_string(list_transform(reasons, lambda r: '- ' || r), chr(10)) || chr(10) || chr(10) ||
  case when scan and body <> '' then '**原始内容（前 500 字符）：**' || chr(10) || '```' || chr(10) || substr(body, 1, 500) || chr(10) || '```'
    when failed then '**原始内容（前 500 字符）：**' || chr(10) || '```' || chr(10) || substr(response, 1, 500) || chr(10) || '```' else '**原始内容：** 无' end as entry
from ({_REASONS}) where len(reasons) > 0"""
)
def review_entries(spark, sf_dir):
    return P.review_entries(records(spark, sf_dir))


@register(
    f"""select 0::bigint as n, '# 人工确认清单' || chr(10) || chr(10) || '生成时间：then' || chr(10) || '待确认论文数：' || count(*) || chr(10) || chr(10) || '---' || chr(10) as text from ({_SQL['review_entries']}) having count(*) > 0
union all select n, entry || chr(10) || chr(10) || '---' || chr(10) from ({_SQL['review_entries']})"""
)
def review_list(spark, sf_dir):
    return P.review_list(records(spark, sf_dir), "then")


def _width(column: str) -> str:
    wide = lambda c: f"length({c}) + length(regexp_replace({c}, '[\\x00-\\x7f]+', '', 'g'))"
    return f"select {O.lit(column)} as \"column\", least(greatest(greatest(coalesce(max({wide(f'coalesce({column}::varchar, {chr(39)}{chr(39)})')}), 0), {len(column)}) + 2, 10), 60)::int as width from documents"


@register(" union all ".join(_width(c) for c in ("doc_id", "lang", "source", "text")))
def column_widths(spark, sf_dir):
    return P.column_widths(read(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text"))


_WANTED = "[" + ", ".join(O.lit(f) for f in R.FIELDS) + "]"


@register(
    f"""select path, array_to_string(list_sort(list_filter({_WANTED}, lambda f: not list_contains(json_keys(j), f))), ',') as missing,
  array_to_string(list_sort(list_filter(json_keys(j), lambda f: not list_contains({_WANTED}, f))), ',') as extra from ({_ANS}) where j is not null"""
)
def contract_check(spark, sf_dir):
    return P.contract_check(X.papers(spark, sf_dir))


_CITED = """select source, v as finding, case v when 2 then substr(text || repeat('x', 81), 1, 81) when 3 then 'zz not there zz' else substr(text, 1, 40) end as excerpt, case v when 1 then 100000 else 1 end as page
  from (select source, text, unnest(range(0, 4))::int as v from ({0}) where page = 1)"""


@register(
    f"""select c.source, finding, c.page, case when p.text is null then 'no_page' when length(excerpt) > 80 then 'long_excerpt' when not contains(p.text, excerpt) then 'not_on_page' else 'ok' end as verdict
from ({_CITED.format(O.pages())}) c left join ({O.pages()}) p on c.source = p.source and c.page = p.page"""
)
def evidence_check(spark, sf_dir):
    pages = doc_pages(spark, sf_dir)
    made = pages.where("page = 1").select("source", "text", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("finding"))
    excerpt = F.when(F.col("finding") == 2, F.substring(F.concat("text", F.repeat(F.lit("x"), 81)), 1, 81)).when(F.col("finding") == 3, "zz not there zz").otherwise(F.substring("text", 1, 40))
    return P.evidence_check(made.select("source", "finding", excerpt.alias("excerpt"), F.array(F.when(F.col("finding") == 1, 100000).otherwise(1)).alias("pages")), pages)


_ANSWERED = f"select query_id, string_agg('见 [片段' || rank || '，第' || (1 + vec_id % 2) || '页]', '；' order by rank) || '，另见 [片段' || (7 + query_id % 3) || '，第1页]。' as answer from ({_knn_sql(_DIFF)}) group by query_id"


@register(
    f"""select c.query_id, c.rank, c.page from (select query_id, regexp_extract(m, '片段([0-9]+)', 1)::int as rank, regexp_extract(m, '第([0-9]+)页', 1)::int as page
  from (select query_id, unnest(list_distinct(regexp_extract_all(answer, '\\[片段[0-9]+，第[0-9]+页\\]'))) as m from ({_ANSWERED}))) c
where not exists (select 1 from ({_knn_sql(_DIFF)}) h where h.query_id = c.query_id and h.rank = c.rank and c.page = 1)"""
)
def citation_check(spark, sf_dir):
    """Answers cite every hit, of odd vectors on a page that was not given, and one rank beyond the hits."""
    hits = _hits(spark, sf_dir, "sql2")
    mark = lambda rank, page: F.concat(F.lit("[片段"), rank.cast("string"), F.lit("，第"), page.cast("string"), F.lit("页]"))
    cited = F.struct("rank", F.concat(F.lit("见 "), mark(F.col("rank"), 1 + F.col("vec_id") % 2)).alias("m"))
    text = F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(cited)), lambda x: x["m"]), "；"), F.lit("，另见 "), mark(7 + F.col("query_id") % 3, F.lit(1)), F.lit("。"))
    return P.citation_check(hits.groupBy("query_id").agg(text.alias("answer")), hits.select("query_id", "rank", F.lit(1).alias("page")))


@register(f"select try_cast(regexp_extract(({O.string_list('j', 'relevance_score')})[1], '^[^0-9]*([0-9]+)', 1) as int) as score, count(*) as n from ({_ANS}) where not scan and j is not null and try_cast(regexp_extract(({O.string_list('j', 'relevance_score')})[1], '^[^0-9]*([0-9]+)', 1) as int) between 1 and 10 group by 1")
def relevance_scores(spark, sf_dir):
    return P.relevance_scores(records(spark, sf_dir))


@register(f"select path, title as extracted_title, len(reasons) > 0 as needs_review, array_to_string(reasons, '|') as reasons from ({_REASONS})")
def reports_read_back(spark, sf_dir):
    """The JSON sink: records written and read again."""
    at = S.scratch_path(spark, "reports")
    P.write_reports(records(spark, sf_dir), at, "then")
    back = spark.read.schema("path string, extracted_title string, needs_review boolean, reasons array<string>").json(f"{at}/records")
    return back.select("path", "extracted_title", "needs_review", F.array_join("reasons", "|").alias("reasons"))


# the store: appended, appended again, reset, begun anew

_PART = f"(select count(*) from ({O.kept()}) where source::bigint % 2 = 0)"
_WHOLE_STORE = f"(select count(*) from ({O.kept()}))"


@register(f"select * from (values (1, {_PART}), (2, {_WHOLE_STORE}), (3, {_WHOLE_STORE}), (4, 0), (5, {_PART})) t(step, chunks)")
def store_steps(spark, sf_dir):
    """Chunks of a store after half was appended, all, the first half again, after a reset, and after half anew."""
    at = S.scratch_path(spark, "store")
    chunks = stored(C.with_ids(C.kept_chunks(doc_chunks(spark, sf_dir))), "chunks")  # four appends read them
    half = chunks.where(F.col("source").cast("long") % 2 == 0)
    counts = []
    for step, new in enumerate((half, chunks, half, None, half), 1):
        if new is None:
            S.reset_store(spark, at)
        else:
            S.append_chunks(new, at)
            S.require_non_empty(S.read_store(spark, at))
        counts.append(S.read_store(spark, at).agg(F.count("*").alias("chunks")).withColumn("step", F.lit(step)).first())
    return spark.createDataFrame([(r["step"], r["chunks"]) for r in counts], "step int, chunks long")


@register(f"select source, page, chunk_no, text from ({O.kept()})")
def chunk_store(spark, sf_dir):
    """A store appended in two batches, one of which comes twice."""
    at = S.scratch_path(spark, "store")
    chunks = C.with_ids(C.kept_chunks(doc_chunks(spark, sf_dir)))
    for batch, rest in (("even", 0), ("odd", 1), ("even", 0)):
        S.append_chunks(chunks.where(F.col("source").cast("long") % 2 == rest), at, batch=batch)
    return S.read_store(spark, at).select("source", "page", "chunk_no", "text")


# streams: the same rows as in batch


@register(f"select sha256(source || '|' || page || '|' || chunk_no || '|' || text) as chunk_id, source, page, chunk_no, text from ({O.kept()})")
def stream_ingest(spark, sf_dir):
    at, docs = S.scratch_path(spark, "stream"), spark.read.parquet(f"{sf_dir}/documents.parquet")
    G.stream_ingest(spark, f"{sf_dir}/documents.parquet*", docs.schema, f"{at}/store", f"{at}/state")
    return S.read_store(spark, f"{at}/store")


@register(f"select conv_id, turn, len(history)::int as n_history, coalesce(array_to_string(list_transform(history, lambda m: m.role || ': ' || m.text), chr(10)), '') as history from ({_HISTORY})")
def stream_chat_memory(spark, sf_dir):
    """Turns come in four micro-batches that cut through conversations, late ones before early ones."""
    at, rows = S.scratch_path(spark, "stream"), spark.read.parquet(f"{sf_dir}/conversations.parquet")
    turns = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    files = max(rows.rdd.getNumPartitions(), spark.sparkContext.defaultParallelism)  # of a micro-batch
    turns.repartition(4 * files, "conv_id", "turn").write.parquet(f"{at}/in")
    stream = spark.readStream.schema(turns.schema).option("maxFilesPerTrigger", files).parquet(f"{at}/in")
    G.stream_chat_memory(stream).writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{at}/out")
