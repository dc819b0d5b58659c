"""Answers about papers to typed records, reviews and reports."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions import records as R
from scriptorium.functions import text as T
from scriptorium.sources.papers import scratch_path
from scriptorium.sources.scratch import stored

SCAN = 200
#: Names of cited pages that are broadcast at most; more of them meet the pages by shuffle.
CITED = 500_000
# Columns of the summary table, in order.
SUMMARY = (
    "original_filename extracted_title authors year journal doi doi_status research_background research_question research_objective research_method model_or_framework "
    "data_source experimental_design analysis_process key_findings contributions limitations_reported limitations_inferred relevance_score path"
).split()

SYSTEM = "你阅读学术论文并填写结构化记录。除标题外一律用中文；只写论文里有的内容，读不出的写“未识别”；只输出一个 JSON 对象，不加代码块标记。"
REQUEST = """为下面的论文填写一个 JSON 对象，主题：{topic}

字段（一个不多，一个不少）：
{fields}

证据：
- 页码只取自正文中的 ===== PAGE n ===== 标记，不推算；定位不到就给空列表。
- 原文片段逐字抄录，最多 80 字；没有就给空字符串。
- limitations_reported 只收作者写明的局限，推断的写进 limitations_inferred，措辞留有余地。

题目："""
FIELD_HELP = {
    "extracted_title": "正文里的完整标题", "authors": "作者列表，按正文顺序", "year": "年份，读不出为 null", "journal": "期刊或来源，读不出为 null",
    "research_background": "背景与动机", "research_question": "核心问题", "research_objective": "要达到的目标",
    "research_method": "总体方法（范式或工具），对象：text、evidence_pages、evidence_excerpt",
    "model_or_framework": "理论、模型、指标体系或技术路线", "data_source": "数据与样本，用原文专名，对象，同上",
    "experimental_design": "具体做法：变量、分组、指标、检验", "analysis_process": "主要步骤", "key_findings": "结论列表，每条是对象，同上",
    "contributions": "创新与价值", "limitations_reported": "列表", "limitations_inferred": "列表", "relevance_score": "与主题的相关性，1 到 10 分，附简短理由",
}


def is_scan(text: Column) -> Column:
    return F.length(T.strip(text)) < SCAN


def request_prompts(papers: DataFrame, topic: str) -> DataFrame:
    """(request_id, path, system_prompt, prompt) for papers with enough text: path, title, full_text, prompt_text in.

    The prompt names every field of the record and the rules for evidence. request_id is a
    hash of the path, so that asking again gives the same id.
    """
    parts = [F.lit(REQUEST.format(topic=topic, fields="\n".join(f"- {k}：{v}" for k, v in FIELD_HELP.items()))), F.col("title"), F.lit("\n内容：\n"), F.col("prompt_text")]
    return papers.where(~is_scan(F.col("full_text"))).select(F.sha2("path", 256).alias("request_id"), "path", F.lit(SYSTEM).alias("system_prompt"), F.concat(*parts).alias("prompt"))


def write_requests(requests: DataFrame, folder: str) -> None:
    """Requests as JSON lines, for whatever sends them."""
    requests.write.json(folder)


def request_state(requests: DataFrame, ledger: DataFrame, most: int = 3) -> DataFrame:
    """(request_id, sent, failed, state) of each request, from a ledger of what became of it.

    ledger: (request_id, event), any number of rows of ``sent``, ``failed`` or ``answered``
    in any order; events of unknown requests are left out. A request is answered, pending
    (sent without an outcome), given_up (failed ``most`` times), retry or new.
    """
    events = ledger.groupBy("request_id").agg(*(F.count_if(F.col("event") == e).alias(e) for e in ("sent", "failed", "answered")))
    known = requests.select("request_id").distinct().join(events, "request_id", "left")
    sent, failed, answered = (F.coalesce(c, F.lit(0)) for c in ("sent", "failed", "answered"))
    state = F.when(answered > 0, "answered").when(failed >= most, "given_up").when(sent > failed, "pending").when(failed > 0, "retry").otherwise("new")
    return known.select("request_id", sent.alias("sent"), failed.alias("failed"), state.alias("state"))


def requests_to_send(requests: DataFrame, ledger: DataFrame, most: int = 3) -> DataFrame:
    """The requests that are new or to be tried again: those without an answer, an open attempt or ``most`` failures.

    The ledger is counted first and only names meet the requests, so prompts of requests
    that need nothing are dropped where they lie.
    """
    events = ledger.groupBy("request_id").agg(*(F.count_if(F.col("event") == e).alias(e) for e in ("sent", "failed", "answered")))
    done = events.where((F.col("answered") > 0) | (F.col("failed") >= most) | (F.col("sent") > F.col("failed")))
    return requests.join(done.select("request_id"), "request_id", "left_anti")


def answered_events(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """(request_id, event) of what came back: answered where a response is a JSON object, failed where it is null or none.

    responses: (request_id, response). Rows of requests that were not sent are left out.
    """
    known = responses.join(requests.select("request_id").distinct(), "request_id", "left_semi")
    return known.select("request_id", F.when(R.parse_response(F.col("response")).isNotNull(), "answered").otherwise("failed").alias("event"))


def append_events(events: DataFrame, path: str) -> None:
    """Add events to the ledger at ``path``."""
    events.select("request_id", "event").write.mode("append").parquet(path)


def paper_records(papers: DataFrame, responses: DataFrame) -> DataFrame:
    """One typed record for each paper (path, title, full_text), with its review reasons.

    A paper with too little text gets a stub and one reason; an answer that is missing or
    no JSON object gets a stub, the answer's first 1000 characters, one empty finding and
    the reasons that follow from having nothing.
    """
    joined = papers.join(responses.select("path", "response"), "path", "left").withColumn("scan", is_scan(F.col("full_text"))).withColumn("v", R.parse_response(F.col("response")))
    # columns of their own, so that a text is measured and an answer parsed once a row
    joined = joined.withColumn("v", F.when(~F.col("scan"), F.col("v")))
    scan, v = F.col("scan"), F.col("v")
    failed = ~scan & v.isNull()
    none = F.array().cast("array<string>")
    lists = {f: F.when(v.isNull(), none).otherwise(R.string_list(R.field(v, f))) for f in [*R.LIST_FIELDS, "authors"]}
    title = F.when(v.isNull(), F.col("title")).otherwise(R.text(v, "extracted_title"))
    year, journal = R.known_or_null(R.text(v, "year")), R.known_or_null(R.text(v, "journal"))
    one_empty = F.array(F.struct(F.lit("").alias("text"), F.array().cast("array<int>").alias("evidence_pages"), F.lit("").alias("evidence_excerpt"))).cast(f"array<{R.EVIDENCE}>")
    columns = {
        "original_filename": F.col("title"),
        "extracted_title": title,
        "year": year,
        "journal": journal,
        "doi": T.doi(F.col("full_text")),
        "doi_status": T.doi_status(F.col("full_text")),
        **lists,
        "limitations_reported": F.when(v.isNull(), none).otherwise(R.limitations(v)),
        "research_method": R.evidence(R.field(v, "research_method")),
        "data_source": R.evidence(R.field(v, "data_source")),
        "key_findings": F.when(failed, one_empty).when(scan, F.array().cast(f"array<{R.EVIDENCE}>")).otherwise(R.evidence_list(R.field(v, "key_findings"))),
        "raw_text": F.when(scan, F.substring("full_text", 1, 500)),
        "raw_llm_response": F.when(failed, F.substring("response", 1, 1000)),
        "scanned": F.when(scan, F.length(T.strip(F.col("full_text")))),
        "failed": failed,
    }
    out = joined.select("path", *(c.alias(n) for n, c in columns.items()))
    unknown = F.coalesce(F.col("extracted_title"), F.lit("")).isin("", "未识别", "未明确提及")
    reasons = F.array_compact(
        F.array(
            F.when(F.col("failed"), "JSON 解析失败"),
            F.when(unknown, "标题未识别"),
            F.when(F.size("authors") == 0, "作者未识别"),
            F.when(F.col("year").isNull(), "年份未识别"),
            F.when(F.col("doi_status") == "未找到", "DOI 未找到"),
        )
    )
    scanned = F.array(F.concat(F.lit("疑似扫描版（提取文本仅 "), F.col("scanned").cast("string"), F.lit(" 字符）")))
    out = out.withColumn("reasons", F.when(F.col("scanned").isNotNull(), scanned).otherwise(reasons))
    return out.withColumn("needs_review", F.size("reasons") > 0).drop("scanned", "failed")


def run_summary(records: DataFrame) -> DataFrame:
    return records.agg(F.count("*").alias("total"), F.count_if(~F.col("needs_review")).alias("normal"), F.count_if("needs_review").alias("review"))


def review_reason_counts(records: DataFrame) -> DataFrame:
    return records.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def summary_rows(records: DataFrame) -> DataFrame:
    """The 21 columns of the summary table, lists as numbered text."""
    as_text = {f: T.numbered(F.col(f)) for f in [*R.LIST_FIELDS, "limitations_reported"]}
    as_text |= {"authors": F.array_join("authors", "；"), "research_method": T.evidence_cell(F.col("research_method")), "data_source": T.evidence_cell(F.col("data_source")), "key_findings": T.evidence_list_cell(F.col("key_findings"))}
    return records.select(*(as_text.get(c, F.col(c)).alias(c) for c in SUMMARY))


def markdown_cards(records: DataFrame) -> DataFrame:
    """(file_name, markdown): a card for each title; of equal file names the last path wins."""
    title = F.coalesce(F.when(F.col("extracted_title") != "", F.col("extracted_title")), "original_filename")
    listed = lambda f: T.numbered(F.col(f))
    or_else = lambda c, x: F.coalesce(F.when(c != "", c), F.lit(x))
    # Headings and stand-ins of a card, in order.
    head = [("作者", or_else(F.array_join("authors", "、"), "未识别")), ("年份", or_else(F.col("year"), "未识别")), ("期刊/来源", or_else(F.col("journal"), "未识别")), ("DOI", or_else(F.col("doi"), "—")), ("DOI 状态", F.col("doi_status"))]
    body = [
        ("研究背景", listed("research_background")), ("研究问题", listed("research_question")), ("研究目标", listed("research_objective")), ("研究方法", T.evidence_markdown(F.col("research_method"))),
        ("模型或理论框架", listed("model_or_framework")), ("数据来源", T.evidence_markdown(F.col("data_source"))), ("实验或研究设计", listed("experimental_design")), ("分析流程", listed("analysis_process")),
        ("主要发现", T.evidence_list_markdown(F.col("key_findings"))), ("研究贡献", listed("contributions")),
    ]
    parts = [F.concat(F.lit("# "), F.coalesce("extracted_title", title)), F.concat(F.lit("## 一、基本信息\n\n"), F.concat_ws("\n", *(F.concat(F.lit(f"- {k}："), c) for k, c in head)))]
    parts += [F.concat(F.lit(f"## {k}\n"), c) for k, c in body]
    parts += [
        F.lit("## 研究局限"),
        F.concat(F.lit("### 作者明确提出的局限\n"), or_else(listed("limitations_reported"), "未识别到作者明确陈述的研究局限。")),
        F.concat(F.lit("### 模型基于论文内容推断的局限\n"), or_else(listed("limitations_inferred"), "暂无推断内容。")),
        F.lit("> 注意：以上推断内容不是论文作者的直接表述，正式引用前需要核对原文。"),
        F.concat(F.lit("## 相关性评分\n"), listed("relevance_score")),
        F.concat(F.lit("## 文件路径\n"), F.col("path"), F.lit("\n")),
    ]
    cards = records.select("path", F.concat(T.safe_name(title), F.lit(".md")).alias("file_name"), F.concat_ws("\n\n", *parts).alias("markdown"))
    # the aggregate keeps one card a name before the shuffle, however many share it
    return cards.groupBy("file_name").agg(F.max_by("markdown", "path").alias("markdown"))


def review_entries(records: DataFrame) -> DataFrame:
    """(n, path, entry): what the review list says of each record that needs one, numbered in order of path.

    Entries are written before any is left out or numbered: a filter would be pushed down
    to the answers and parse each a second time, and ranges are cut by a pass of its own.
    """
    raw = F.coalesce(F.when(F.col("raw_text") != "", F.col("raw_text")), F.when(F.col("raw_llm_response") != "", F.col("raw_llm_response")))
    shown = F.when(raw.isNotNull(), F.concat(F.lit("**原始内容（前 500 字符）：**\n```\n"), F.substring(raw, 1, 500), F.lit("\n```"))).otherwise(F.lit("**原始内容：** 无"))
    reasons = F.array_join(F.transform("reasons", lambda r: F.concat(F.lit("- "), r)), "\n")
    rest = F.concat(F.coalesce("original_filename", F.lit("未知文件")), F.lit("\n\n**触发原因：**\n"), reasons, F.lit("\n\n"), shown)
    entries = stored(records.select("path", "needs_review", F.when(F.col("needs_review"), rest).alias("rest")), "entries")
    return numbered(entries.where("needs_review").select("path", "rest")).select("n", "path", F.concat(F.lit("## "), F.col("n").cast("string"), F.lit(". "), F.col("rest")).alias("entry"))


def numbered(rows: DataFrame, key: str = "path") -> DataFrame:
    """``rows`` with ``n``, from 1 in order of ``key``: sorted ranges, each offset by the rows before it.

    The ranges are written first, since a range partitioning that is computed twice need
    not cut at the same places.
    """
    spark = rows.sparkSession
    at = scratch_path(spark, "numbered")
    ranged = rows.repartitionByRange(key).sortWithinPartitions(key).withColumns({"_p": F.spark_partition_id(), "_i": F.monotonically_increasing_id()})
    ranged.write.parquet(at)
    own = spark.read.schema(ranged.schema).parquet(at)
    # one row a range
    before = own.groupBy("_p").agg(F.count("*").alias("c")).select("_p", F.coalesce(F.sum("c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    place = F.col("_before") + F.col("_i") - F.shiftleft(F.col("_p").cast("long"), 33) + 1
    return own.join(F.broadcast(before), "_p").select(place.alias("n"), *rows.columns)


def review_list(records: DataFrame, when: str) -> DataFrame:
    """(n, text): the review list as one document in pieces: a head with the time and the count, then each entry and a rule."""
    entries = review_entries(records)
    head = entries.agg(F.count("*").alias("c")).where("c > 0").select(F.lit(0).cast("long").alias("n"), F.concat(F.lit(f"# 人工确认清单\n\n生成时间：{when}\n待确认论文数："), F.col("c").cast("string"), F.lit("\n\n---\n")).alias("text"))
    return head.unionByName(entries.select("n", F.concat("entry", F.lit("\n\n---\n")).alias("text")))


def write_reports(records: DataFrame, folder: str, when: str | None = None) -> None:
    """All records as JSON lines, the summary table as Parquet and CSV, cards, and the review list where there is one.

    The review list is text in order; its part files one after another are the document.
    Records are computed once, and written to a table that all of these read.
    """
    records = stored(records, "records")
    records.write.json(f"{folder}/records")
    rows = summary_rows(records)
    rows.write.parquet(f"{folder}/summary")
    rows.write.option("header", True).option("quoteAll", True).option("escape", '"').csv(f"{folder}/summary_csv")
    markdown_cards(records).write.parquet(f"{folder}/cards")
    listed = review_list(records, when or f"{datetime.now():%Y-%m-%d %H:%M:%S}")
    if not listed.isEmpty():
        listed.orderBy("n").select("text").write.text(f"{folder}/review_list")


def column_widths(rows: DataFrame) -> DataFrame:
    """(column, width): the widest header or value, wide characters twice, two more, from 10 to 60."""
    wide = lambda c: F.length(c) + F.length(F.regexp_replace(c, r"[\x{0}-\x{7f}]+", ""))
    widest = rows.agg(*(F.max(wide(F.coalesce(F.col(c).cast("string"), F.lit("")))).alias(c) for c in rows.columns))
    pairs = F.array(*(F.struct(F.lit(c).alias("column"), F.greatest(F.coalesce(F.col(c), F.lit(0)), wide(F.lit(c))).alias("w")) for c in rows.columns))
    return widest.select(F.inline(pairs)).select("column", F.least(F.greatest(F.col("w") + 2, F.lit(10)), F.lit(60)).alias("width"))


def contract_check(responses: DataFrame) -> DataFrame:
    """(path, missing, extra): fields that an object lacks, or has beyond the contract."""
    keys = F.json_object_keys(T.clean_json_text(F.col("response")))
    wanted = F.array(*(F.lit(f) for f in R.FIELDS))
    parsed = responses.where(R.parse_response(F.col("response")).isNotNull())
    return parsed.select("path", F.array_join(F.array_sort(F.array_except(wanted, keys)), ",").alias("missing"), F.array_join(F.array_sort(F.array_except(keys, wanted)), ",").alias("extra"))


def evidence_check(findings: DataFrame, pages: DataFrame, longest: int = 80) -> DataFrame:
    """(source, finding, page, verdict) for every page a finding cites: ok, no_page, long_excerpt or not_on_page.

    The cited pages' names go to the pages first; texts of pages that nobody cites are not
    shuffled.
    """
    cited = findings.select("source", "finding", "excerpt", F.explode("pages").alias("page"))
    names = cited.select("source", "page").distinct()
    if names.limit(CITED + 1).count() <= CITED:
        names = F.broadcast(names)
    wanted = pages.select("source", "page", "text").join(names, ["source", "page"], "left_semi")
    joined = cited.join(wanted, ["source", "page"], "left")
    verdict = F.when(F.col("text").isNull(), "no_page").when(F.length("excerpt") > longest, "long_excerpt").when(~F.contains("text", "excerpt"), "not_on_page").otherwise("ok")
    return joined.select("source", "finding", "page", verdict.alias("verdict"))


def citation_check(answers: DataFrame, hits: DataFrame) -> DataFrame:
    """(query_id, rank, page) that an answer cites without having been given it."""
    marks = F.explode(F.array_distinct(F.regexp_extract_all("answer", F.lit("\\[片段[0-9]+，第[0-9]+页\\]"), 0))).alias("m")
    cited = answers.select("query_id", marks).select("query_id", F.regexp_extract("m", "片段([0-9]+)", 1).cast("int").alias("rank"), F.regexp_extract("m", "第([0-9]+)页", 1).cast("int").alias("page"))
    return cited.join(hits.select("query_id", "rank", "page"), ["query_id", "rank", "page"], "left_anti")


def relevance_scores(records: DataFrame) -> DataFrame:
    """(score, n): scores from 1 to 10 that start the relevance text."""
    score = F.regexp_extract(F.coalesce(F.get("relevance_score", F.lit(0)), F.lit("")), "^[^0-9]*([0-9]+)", 1).try_cast("int")
    return records.select(score.alias("score")).where("score BETWEEN 1 AND 10").groupBy("score").agg(F.count("*").alias("n"))
