"""Queries from regions to Markdown and JSON, with the same rows in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.functions import labels
from quire.operators import formatting as O
from quire.sources import derived as S

QUERIES, SQL = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _re(c: str, pattern: str, to: str, flags: str = "") -> str:
    return f"regexp_replace({c}, '{pattern}', '{to}'" + (f", '{flags}')" if flags else ")")


def _left(c: str) -> str:
    return _re(c, r"\A\s+", "")


def _right(c: str) -> str:
    return _re(c, r"\s+\z", "")


def _trim(c: str) -> str:
    return _right(_left(c))


_HTML = lambda c: f"regexp_matches({_trim(c)}, '\\A<(?:div|p|span)')"
_HASH = lambda c: _re(c, r"\A#*\s*", "")
_F = lambda c: f"substr({_trim(c)}, 3, length({_trim(c)}) - 4)"
_ALG = "CASE WHEN starts_with(c, '```html') AND NOT (contains(lower(c), '<html') OR contains(lower(c), '<body') OR contains(lower(c), '<div')) AND (contains(lower(c), '</') OR contains(lower(c), '/>') OR contains(lower(c), '<weblogic') OR contains(lower(c), '<local-')) THEN '```xml' || substr(c, 8) ELSE c END"
_PARA = "CASE WHEN regexp_matches(c, '\\A[-*] ') THEN " + _left("substr(c, 3)") + " ELSE c END"
_NUM, _PAREN = r"\A([0-9]+|[A-Za-z])([.)）])", r"\A[(（]([0-9]+|[A-Za-z])[)）]"


def _steps(source: str) -> str:
    """Common table expressions from ``source``(.., native_label, content) to ``fc`` with kind and formatted content."""
    clean = _left(_re("content", r"\A(?:\\t)+", ""))
    clean = _right(_re(clean, r"(?:\\t)+\z", ""))
    for run, three in ((r"\.{4,}", "..."), ("·{4,}", "···"), ("_{4,}", "___"), (r"(?:\\_){4,}", r"\\_\\_\\_")):
        clean = _re(clean, run, three, "g")
    formula = f"chr(36) || chr(36) || chr(10) || CASE WHEN length({_trim('c')}) >= 4 AND ((starts_with({_trim('c')}, '$$') AND ends_with({_trim('c')}, '$$')) OR (starts_with({_trim('c')}, '\\[') AND ends_with({_trim('c')}, '\\]')) OR (starts_with({_trim('c')}, '\\(') AND ends_with({_trim('c')}, '\\)'))) THEN {_trim(_F('c'))} ELSE {_trim('c')} END || chr(10) || '$$'"
    lists = f"CASE WHEN regexp_matches(b, '{_PAREN}') THEN '(' || regexp_extract(b, '{_PAREN}', 1) || ') ' || {_left(_re('b', _PAREN, ''))} WHEN regexp_matches(b, '{_NUM}') THEN regexp_extract(b, '{_NUM}', 1) || replace(regexp_extract(b, '{_NUM}', 2), '）', ')') || ' ' || {_left(_re('b', _NUM, ''))} ELSE b END"
    # A single newline is one between two other characters or at an end; two passes, as matches may share a character.
    double = _re(_re("l", r"([^\n])\n([^\n])", r"\1\n\n\2", "g").replace(r"\1\n\n\2", "\\1' || chr(10) || chr(10) || '\\2"), r"([^\n])\n([^\n])", r"\1\n\n\2", "g").replace(r"\1\n\n\2", "\\1' || chr(10) || chr(10) || '\\2")
    return f"""{labels.sql_dims()},
s1 AS (SELECT r.*, coalesce(k.kind, 'unknown') AS kind, {_trim(clean)} AS c FROM {source} r LEFT JOIN dim_label k USING (native_label)),
s2 AS (SELECT * EXCLUDE (c), CASE native_label WHEN 'doc_title' THEN CASE WHEN {_HTML('c')} THEN c ELSE '# ' || {_HASH('c')} END
  WHEN 'paragraph_title' THEN CASE WHEN {_HTML(_PARA)} THEN {_PARA} ELSE '## ' || {_left(_HASH(_PARA))} END WHEN 'algorithm' THEN {_ALG} ELSE c END AS c FROM s1),
s3 AS (SELECT *, CASE WHEN regexp_matches(c, '\\A(?:[·•]|\\* )') THEN '- ' || {_left('substr(c, 2)')} ELSE c END AS b FROM s2),
s4 AS (SELECT *, {lists} AS l FROM s3),
fc AS (SELECT * EXCLUDE (b, l, c, content), CASE WHEN kind = 'formula' THEN {formula} WHEN kind = 'text' THEN {double} ELSE c END AS content FROM s4)"""


_FMT = f"{S.SQL_REGIONS}, {_steps('reg')}, kept AS (SELECT * EXCLUDE (idx), CAST(row_number() OVER (PARTITION BY doc_id, page_index ORDER BY idx) - 1 AS INT) AS idx FROM fc WHERE content IS NULL OR {_trim('content')} <> '')"
_OUT = "doc_id, page_index, idx, native_label, kind, content"


def _num(c: str) -> str:
    t = _trim(f"coalesce({c}, '')")
    return f"CASE WHEN regexp_matches({t}, '(?s)\\A(?:\\(.*\\)|（.*）)\\z') THEN substr({t}, 2, length({t}) - 2) ELSE {t} END"


def _tag(f: str, n: str) -> str:
    return f"CASE WHEN ends_with({f}, chr(10) || '$$') THEN substr({f}, 1, length({f}) - 3) || ' \\tag{{' || {_num(n)} || '}}' || chr(10) || '$$' ELSE {f} END"


_MERGED = f"""pr AS (SELECT *, lead(content) OVER p AS yc, lead(kind) OVER p AS yk, lead(native_label) OVER p AS yl, lead(x1) OVER p AS yx1, lead(y1) OVER p AS yy1, lead(x2) OVER p AS yx2, lead(y2) OVER p AS yy2 FROM kept WINDOW p AS (PARTITION BY doc_id, page_index ORDER BY idx)),
ab AS (SELECT *, native_label = 'formula_number' AS num, coalesce(native_label = 'formula_number' AND yk = 'formula', false) AS ahead, coalesce(native_label <> 'formula_number' AND kind = 'formula' AND yl = 'formula_number', false) AS behind FROM pr),
fold AS (SELECT doc_id, page_index, idx, false AS skipped, ahead OR behind AS skip FROM ab WHERE idx = 0
  UNION ALL SELECT a.doc_id, a.page_index, a.idx, f.skip, NOT f.skip AND (a.ahead OR a.behind) FROM fold f JOIN ab a ON a.doc_id = f.doc_id AND a.page_index = f.page_index AND a.idx = f.idx + 1),
fn AS (SELECT a.doc_id, a.page_index, CAST(row_number() OVER (PARTITION BY a.doc_id, a.page_index ORDER BY a.idx) - 1 AS INT) AS idx,
  CASE WHEN ahead THEN yl ELSE native_label END AS native_label, CASE WHEN ahead THEN yk ELSE kind END AS kind,
  CASE WHEN ahead THEN {_tag('yc', 'content')} WHEN behind THEN {_tag('content', 'yc')} ELSE content END AS content,
  CASE WHEN ahead THEN yx1 ELSE x1 END AS x1, CASE WHEN ahead THEN yy1 ELSE y1 END AS y1, CASE WHEN ahead THEN yx2 ELSE x2 END AS x2, CASE WHEN ahead THEN yy2 ELSE y2 END AS y2
  FROM ab a JOIN fold f USING (doc_id, page_index, idx) WHERE NOT f.skipped AND (ahead OR NOT num))"""

_HYPHEN = f"""hx AS (SELECT *, kind = 'text' AND ends_with({_right('content')}, '-') AS dash, kind = 'text' AND regexp_matches({_left('content')}, '\\A\\p{{Ll}}') AS low FROM fn),
hy AS (SELECT a.*, b.idx AS j, {_left('b.content')} AS other, substr({_right('a.content')}, 1, length({_right('a.content')}) - 1) AS head
  FROM hx a LEFT JOIN hx b ON a.dash AND b.doc_id = a.doc_id AND b.page_index = a.page_index AND b.low AND b.idx = (SELECT min(c.idx) FROM hx c WHERE c.doc_id = a.doc_id AND c.page_index = a.page_index AND c.low AND c.idx > a.idx)),
hm AS (SELECT *, coalesce(dash AND j IS NOT NULL AND regexp_extract(head, '(\\S+)\\s*\\z', 1) <> '' AND regexp_matches(regexp_extract(head, '(\\S+)\\s*\\z', 1) || regexp_extract(other, '\\A(\\S+)', 1), '\\A[\\p{{L}}\\p{{M}}]{{1,64}}\\z'), false) AS merges FROM hy),
hf AS (SELECT doc_id, page_index, idx, false AS skipped, CASE WHEN merges THEN [j] ELSE CAST([] AS INT[]) END AS gone FROM hm WHERE idx = 0
  UNION ALL SELECT a.doc_id, a.page_index, a.idx, list_contains(f.gone, a.idx), CASE WHEN a.merges AND NOT list_contains(f.gone, a.idx) THEN list_append(f.gone, a.j) ELSE f.gone END FROM hf f JOIN hm a ON a.doc_id = f.doc_id AND a.page_index = f.page_index AND a.idx = f.idx + 1),
hn AS (SELECT h.doc_id, h.page_index, CAST(row_number() OVER (PARTITION BY h.doc_id, h.page_index ORDER BY h.idx) - 1 AS INT) AS idx, native_label, kind, x1, y1, x2, y2, CASE WHEN merges THEN head || other ELSE content END AS content
  FROM hm h JOIN hf USING (doc_id, page_index, idx) WHERE NOT hf.skipped)"""

_BULLET = """bu AS (SELECT * EXCLUDE (content), CASE WHEN native_label = 'text' AND NOT starts_with(content, '- ') AND lag(native_label) OVER p = 'text' AND lead(native_label) OVER p = 'text'
  AND starts_with(lag(content) OVER p, '- ') AND starts_with(lead(content) OVER p, '- ') AND abs(lag(x1) OVER p - x1) <= 10 AND abs(lead(x1) OVER p - x1) <= 10 THEN '- ' || content ELSE content END AS content
  FROM {0} WINDOW p AS (PARTITION BY doc_id, page_index ORDER BY idx))"""
_ALL = f"WITH RECURSIVE {_FMT}, {_MERGED}, {_HYPHEN}, {_BULLET.format('hn')}"
_PLACE = "'![](page=' || page_index || ',bbox=[' || x1 || ',' || y1 || ',' || x2 || ',' || y2 || '])'"
_PAGE = f"pg AS (SELECT doc_id, page_index, coalesce(string_agg(b, chr(10) || chr(10) ORDER BY idx), '') AS markdown FROM (SELECT *, CASE WHEN kind = 'image' THEN {_PLACE} ELSE nullif(content, '') END AS b FROM bu) GROUP BY 1, 2)"


def _cols(df: DataFrame) -> DataFrame:
    return df.select("doc_id", "page_index", "idx", "native_label", "kind", "content")


@query(f"WITH {_FMT} SELECT {_OUT} FROM kept")
def format_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1 to F10 and the drop of blank contents."""
    return _cols(O.format_content(S.regions(spark, sf_dir)))


@query(f"WITH RECURSIVE {_FMT}, {_MERGED} SELECT {_OUT} FROM fn")
def formula_number_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cols(O.merge_formula_numbers(O.format_content(S.regions(spark, sf_dir))))


@query(f"WITH RECURSIVE {_FMT}, {_MERGED}, {_HYPHEN} SELECT {_OUT} FROM hn")
def hyphen_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cols(O.merge_hyphens(O.merge_formula_numbers(O.format_content(S.regions(spark, sf_dir)))))


@query(f"WITH {_FMT}, {_BULLET.format('kept')} SELECT {_OUT} FROM bu")
def bullet_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cols(O.infill_bullets(O.format_content(S.regions(spark, sf_dir))))


@query(f"{_ALL}, {_PAGE} SELECT * FROM pg")
def page_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.page_markdown(O.format_pages(S.regions(spark, sf_dir)))


@query(f"{_ALL}, {_PAGE} SELECT doc_id, string_agg(markdown, chr(10) || chr(10) ORDER BY page_index) AS markdown FROM pg GROUP BY 1")
def document_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.document_markdown(page_markdown(spark, sf_dir))


_ITEM = "{'index': idx, 'label': CASE WHEN kind = 'unknown' THEN 'text' ELSE kind END, 'content': coalesce(content, ''), 'bbox_2d': [x1, y1, x2, y2]}"


@query(f"{_ALL}, it AS (SELECT doc_id, page_index, list({_ITEM} ORDER BY idx) AS items FROM bu GROUP BY 1, 2) SELECT doc_id, CAST(to_json(list(items ORDER BY page_index)) AS VARCHAR) AS blocks FROM it GROUP BY 1")
def block_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.block_list(O.format_pages(S.regions(spark, sf_dir)))


_REGION = """'{"bbox":' || to_json({'x1': x1, 'x2': x2, 'y1': y1, 'y2': y2}) || coalesce(',"content":' || to_json(content), '') || ',"index":' || idx || ',"kind":"' || kind || '","nativeLabel":"' || native_label || '"}'"""


@query(f"""{_ALL}, it AS (SELECT doc_id, page_index, string_agg({_REGION}, ',' ORDER BY idx) AS items FROM bu GROUP BY 1, 2)
SELECT doc_id, '{{"pages":[' || string_agg('{{"index":' || page_index || ',"regions":[' || items || ']}}', ',' ORDER BY page_index) || ']}}' AS document FROM it GROUP BY 1""")
def document_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.document_json(O.format_pages(S.regions(spark, sf_dir)))


@query(f"{_ALL}, {_PAGE}, im AS (SELECT doc_id, page_index, idx, row_number() OVER (PARTITION BY doc_id, page_index ORDER BY idx) - 1 AS n FROM bu WHERE kind = 'image'), b2 AS (SELECT bu.*, n FROM bu LEFT JOIN im USING (doc_id, page_index, idx)) SELECT doc_id, page_index, CAST(count(n) AS INT) AS n_refs, coalesce(string_agg(CASE WHEN kind = 'image' THEN '![Image ' || page_index || '-' || n || '](imgs/cropped_page' || page_index || '_idx' || n || '.jpg)' ELSE nullif(content, '') END, chr(10) || chr(10) ORDER BY idx), '') AS markdown FROM b2 GROUP BY 1, 2")
def image_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.image_refs(page_markdown(spark, sf_dir))
