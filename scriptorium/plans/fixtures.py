"""Texts and answers derived from the documents table; the same SQL in Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.sources.papers import spread

_FULL = (
    """{"extracted_title":"T'||doc_id||'","authors":["A","B"],"year":"2024","journal":"J","research_question":"q","research_method":{"text":"m","evidence_pages":[1,3],"evidence_excerpt":"e"},"""
    """"key_findings":[{"text":"f1","evidence_pages":[1],"evidence_excerpt":"x"},{"text":"f2","evidence_pages":["2","z"],"evidence_excerpt":""}],"limitations_reported":["r1"],"relevance_score":"得分 '||(doc_id%13)||' 分"}"""
)
INJECTED = """select doc_id, text, text || chr(10) || case doc_id % 10
  when 0 then 'high' || chr(173) || 'tech evalu-' || chr(10) || 'ate well- known'
  when 1 then '12 34.5, 6' || chr(10) || '*** --- !!!'
  when 2 then 'ab' || chr(10) || '中文段落内容很长。中文段落内容很长。中文段落内容很长。中文段落内容很长。中文段落内容很长。中文段落内容很长。中文段落内容很长。'
  when 3 then 'x <!-- Start of picture text --> y'
  when 4 then '<!-- note --> z. '
  when 5 then 'a<br>b<br>c<br>d<br>e<br>f<br>g'
  when 6 then 'end of Picture Text here'
  when 7 then '　abc ' || chr(160) || 'def　'
  when 8 then chr(10) || chr(10) || chr(10) || 'tail line'
  else '' end as body
from documents"""
CAPTIONED = f"""select doc_id, case
  when doc_id % 3 = 0 then 'Figure ' || doc_id || ' title' || chr(10) || 'short'
  when doc_id % 3 = 1 then 'Table ' || doc_id || chr(10) || text
  else body end as body
from ({INJECTED}) i"""
ANSWERED = f"""select doc_id, cast(doc_id as varchar(20)) || '.pdf' as path,
  text || case doc_id % 4 when 0 then '' when 1 then ' doi:10.1234/ab.' || doc_id || ').'
    when 2 then ' 10.1000/a 10.1000/a;' else ' 10.123/short' end as body,
  case doc_id % 8
    when 0 then '{_FULL}'
    when 1 then '```json' || chr(10) || '{_FULL}' || chr(10) || '```'
    when 2 then 'Sure: {_FULL} done'
    when 3 then '{{"extracted_title":"T' || doc_id || '","authors":["A"'
    when 4 then '{{"extracted_title":"T","authors":"A","year":2023,"journal":null,"research_method":"old m","key_findings":["k1","k2"],"limitations":"lim"}}'
    when 5 then '{{"extracted_title":"T","authors":[],"year":null,"key_findings":[]}}'
    when 6 then '{{"extracted_title":"T","authors":"[' || chr(39) || 'A' || chr(39) || ', ' || chr(39) || 'B' || chr(39) || ']","year":"未识别","research_method":{{"text":"m","evidence_pages":5}}}}'
    else '{{"extracted_title":"未识别","authors":["A"],"year":"2020","key_findings":"one"}}' end as response
from documents"""


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def derived(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    documents(spark, sf_dir).createOrReplaceTempView("documents")
    return spark.sql(sql)


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, title, full_text, response for each document."""
    return derived(spark, sf_dir, ANSWERED).select("path", F.col("path").alias("title"), F.col("body").alias("full_text"), "response")
