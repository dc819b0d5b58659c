"""DuckDB SQL fragments that say what the column functions of scriptorium.functions mean."""

from __future__ import annotations

from scriptorium.functions import text as T


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sub(c: str, pattern: str, to: str) -> str:
    return f"regexp_replace({c}, {lit(pattern)}, {lit(to)}, 'g')"


def strip(c: str) -> str:
    return sub(c, T.STRIP, "")


def clean(c: str) -> str:
    c = f"replace({c}, chr(173), '')"
    c = sub(sub(c, T.HYPHEN_LINE, r"\1\2"), T.HYPHEN_BLANK, r"\1\2")
    c = sub(sub(c, "[ \t]+", " "), "\n{3,}", "\n\n")
    lines = f"list_transform(string_split({c}, chr(10)), lambda x: {strip('x')})"
    good = f"length(x) >= 3 and not regexp_matches(x, {lit(T.NUMBERS_ONLY)}) and not regexp_matches(x, {lit(T.MARKS_ONLY)}) and not contains(x, {lit(T.PICTURE)})"
    return f"coalesce(array_to_string(list_filter({lines}, lambda x: {good}), chr(10)), '')"


def chars(c: str, kind: str) -> str:
    return f"length({sub(c, '[^' + kind[1:-1] + ']+', '')})"


def english(c: str) -> str:
    return f"len(regexp_extract_all({c}, '[a-zA-Z]+'))"


def pieces(c: str, marks: str, longer: int) -> str:
    return f"len(list_filter(regexp_split_to_array({c}, {lit(marks)}), lambda s: length({strip('s')}) > {longer}))"


def filled(c: str) -> str:
    return f"list_filter(list_transform(string_split({c}, chr(10)), lambda x: {strip('x')}), lambda x: x <> '')"


def short_lines(c: str) -> str:
    return f"(case when len({filled(c)}) = 0 then true else len(list_filter({filled(c)}, lambda x: length(x) < 15)) / len({filled(c)}) > 0.5 end)"


def caption(c: str) -> str:
    rest = strip(f"coalesce(array_to_string(list_slice(string_split({c}, chr(10)), 2, NULL), chr(10)), '')")
    labels = f"len(list_filter(string_split({rest}, chr(10)), lambda x: length({strip('x')}) >= 20)) = 0"
    return f"((regexp_matches({c}, {lit(T.CAPTION)}) and (length({rest}) < 80 or {labels})) or len(string_split({c}, '<br>')) - 1 > 5 or regexp_matches({c}, '(?i)picture text'))"


def reason(c: str) -> str:
    cjk = chars(c, T.CJK)
    return f"""case when length({c}) < 120 then 'short'
  when {chars(c, T.DIGIT)} / length({c}) > 0.2 then 'digits'
  when ({chars(c, "[" + chr(92) + "p{L}]")} + {cjk}) / length({c}) < 0.5 then 'letters'
  when {english(c)} < 25 and {cjk} < 50 then 'words'
  when {pieces(c, "[.!?。！？]+", 10)} < 2 then 'sentences'
  when {short_lines(c)} then 'shortlines'
  when {caption(c)} then 'caption'
  when contains({c}, '<!--') and {pieces(c, "[.!?]+", 15)} < 3 and {cjk} < 80 then 'note'
  else 'ok' end"""


def pages(lines_per_page: int = 10) -> str:
    n = lines_per_page
    return f"""select source, (p + 1)::int as page, array_to_string(list_slice(l, p * {n} + 1, p * {n} + {n}), chr(10)) as text
  from (select doc_id::varchar as source, string_split(text, chr(10)) as l, unnest(range(0, ((len(string_split(text, chr(10))) + {n} - 1) // {n})::bigint)) as p from documents where text is not null)"""


def chunks() -> str:
    cut = f"select source, page, string_split({clean('text')}, chr(10) || chr(10)) as ps from ({pages()})"
    rows = f"select source, page, unnest(range(1, len(ps) + 1))::int as chunk_no, ps from ({cut})"
    return f"select source, page, chunk_no, {strip('ps[chunk_no]')} as text from ({rows}) where {strip('ps[chunk_no]')} <> ''"


def kept() -> str:
    return f"select * from ({chunks()}) where ({reason('text')}) = 'ok'"


def dois(c: str) -> str:
    return f"list_transform(regexp_extract_all({c}, {lit(T.DOI)}), lambda m: regexp_replace(m, '[.,;)]+$', ''))"


def doi_status(c: str) -> str:
    n = f"len(regexp_extract_all({c}, {lit(T.DOI)}))"
    return f"case when {n} = 0 then '未找到' when {n} = 1 then '已找到' else '待确认' end"


def json_text(c: str) -> str:
    x = f"regexp_replace(regexp_replace({strip(c)}, {lit(T.FENCE_OPEN)}, ''), {lit(T.FENCE_CLOSE)}, '')"
    return f"(case when regexp_matches({x}, {lit(T.OBJECT)}) then regexp_extract({x}, {lit(T.OBJECT)}) else {x} end)"


def string_list(j: str, path: str) -> str:
    v, t = f"json_extract({j}, '$.{path}')", f"json_type({j}, '$.{path}')"
    s = strip(f"json_extract_string({j}, '$.{path}')")
    inner = f"replace(case when regexp_matches({s}, '(?s)^\\(.*,.*\\)$') then '[' || substr({s}, 2, length({s}) - 2) || ']' else {s} end, chr(39), chr(34))"
    return f"""(case when {t} is null or {t} = 'NULL' then []::varchar[]
  when {t} = 'ARRAY' then json_extract_string({v}, '$[*]')
  when {t} = 'VARCHAR' and {s} = '' then []::varchar[]
  when {t} = 'VARCHAR' and regexp_matches({s}, '(?s)^[\\[(]') and json_valid({inner}) then json_extract_string({inner}, '$[*]')
  when {t} = 'VARCHAR' then [{s}] else [json_extract_string({j}, '$.{path}')] end)"""


def page_list(j: str, path: str) -> str:
    v, t = f"json_extract({j}, '{path}')", f"json_type({j}, '{path}')"
    return f"""(case when {t} = 'ARRAY' then list_filter(list_transform(json_extract({v}, '$[*]'), lambda e: try_cast(json_extract_string(e, '$') as int)), lambda n: n is not null)
  when {t} in ('UBIGINT', 'BIGINT') then [json_extract_string({v}, '$')::int] else []::int[] end)"""


#: Answered papers: path, body, response, j (the object or null) and scan.
ANSWERS = "select *, case when json_valid(jt) and json_type(case when json_valid(jt) then jt end) = 'OBJECT' then jt end as j from (select *, length({strip}) < 200 as scan, {jt} as jt from ({answered}))"


def answers(answered: str) -> str:
    return ANSWERS.format(strip=strip("body"), jt=json_text("response"), answered=answered)
