"""Typed fields out of a model's JSON answer, held as VARIANT."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scriptorium.functions.text import clean_json_text, strip

EVIDENCE = "struct<text:string,evidence_pages:array<int>,evidence_excerpt:string>"
# The record's fields, and what stands for a missing value.
FIELDS = (
    "extracted_title authors year journal research_background research_question research_objective research_method model_or_framework data_source "
    "experimental_design analysis_process key_findings contributions limitations_reported limitations_inferred relevance_score"
).split()
LIST_FIELDS = "research_background research_question research_objective model_or_framework experimental_design analysis_process contributions limitations_inferred relevance_score".split()
MISSING = ("", "null", "None", "未识别", "未明确提及")


def parse_response(c: Column) -> Column:
    """VARIANT of an answer's object; null where it is no JSON object."""
    v = F.try_parse_json(clean_json_text(c))
    return F.when(F.schema_of_variant(v).startswith("OBJECT"), v)


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def _is_string(v: Column) -> Column:
    return _kind(v) == "STRING"


def _is_list(v: Column) -> Column:
    return _kind(v).startswith("ARRAY")


def _empty(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def field(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", "variant")


def text(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", "string")


def string_list(v: Column) -> Column:
    """array<string> of a list, a list written as text, a text or another scalar."""
    s = strip(F.try_variant_get(v, "$", "string"))
    inner = F.when(s.rlike(r"(?s)^\(.*,.*\)\z"), F.concat(F.lit("["), F.substr(s, F.lit(2), F.length(s) - 2), F.lit("]"))).when(s.rlike(r"(?s)^\[.*\]\z"), s)
    parsed = F.from_json(inner, "array<string>", {"allowSingleQuotes": "true", "allowUnquotedFieldNames": "false", "mode": "PERMISSIVE"})
    written = F.when(F.exists(F.coalesce(parsed, _empty("string")), lambda x: x.isNull()), F.lit(None)).otherwise(parsed)
    return (
        F.when(v.isNull() | (_kind(v) == "VOID"), _empty("string"))
        .when(_is_list(v), F.transform(F.try_variant_get(v, "$", "array<string>"), lambda x: F.coalesce(x, F.lit("None"))))
        .when(_is_string(v) & (s == ""), _empty("string"))
        .when(_is_string(v), F.coalesce(written, F.array(s)))
        .otherwise(F.array(F.try_variant_get(v, "$", "string")))
    )


def page_list(v: Column) -> Column:
    """array<int> of a whole number or of the elements that are numbers; else empty."""
    number = lambda e: F.when(_is_string(e), F.when(F.try_variant_get(e, "$", "string").rlike(r"^\s*[+-]?[0-9]+\s*\z"), strip(F.try_variant_get(e, "$", "string")).try_cast("int"))).otherwise(F.try_variant_get(e, "$", "int"))
    return (
        F.when(_is_list(v), F.filter(F.transform(F.try_variant_get(v, "$", "array<variant>"), number), lambda n: n.isNotNull()))
        .when(_kind(v) == "BIGINT", F.array(F.try_variant_get(v, "$", "int")))
        .otherwise(_empty("int"))
    )


def evidence(v: Column) -> Column:
    """One evidence value: an object's parts, a text alone, or nothing."""
    part = lambda n: F.coalesce(text(v, n), F.lit(""))
    whole = F.struct(part("text").alias("text"), F.coalesce(page_list(field(v, "evidence_pages")), _empty("int")).alias("evidence_pages"), part("evidence_excerpt").alias("evidence_excerpt"))
    only = lambda t: F.struct(t.alias("text"), _empty("int").alias("evidence_pages"), F.lit("").alias("evidence_excerpt"))
    return F.when(_kind(v).startswith("OBJECT"), whole).when(_is_string(v), only(F.try_variant_get(v, "$", "string"))).otherwise(only(F.lit(""))).cast(EVIDENCE)


def evidence_list(v: Column) -> Column:
    """A list of evidence: objects and texts of a list; a text, even an empty one, alone."""
    known = F.filter(F.try_variant_get(v, "$", "array<variant>"), lambda e: _is_string(e) | _kind(e).startswith("OBJECT"))
    return F.when(_is_list(v), F.transform(known, evidence)).when(_is_string(v), F.array(evidence(v))).otherwise(_empty(EVIDENCE))


def limitations(v: Column) -> Column:
    """limitations_reported, or the older limitations where that is empty."""
    now = string_list(field(v, "limitations_reported"))
    return F.when(F.size(now) == 0, string_list(field(v, "limitations"))).otherwise(now)


def known_or_null(c: Column) -> Column:
    return F.when(~strip(c).isin(*MISSING), c)
