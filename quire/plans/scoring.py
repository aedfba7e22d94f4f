"""Queries of block alignment, text differences and rule checks, with the same rows in DuckDB where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import scoring as O
from quire.sources import derived as S

QUERIES, SQL = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# Expected blocks are a page's regions; of the actual ones some are dropped, some cut, some of another kind.
_KIND = "CASE WHEN native_label IN ('doc_title', 'paragraph_title') THEN 'heading' WHEN native_label = 'display_formula' THEN 'formula' WHEN native_label = 'algorithm' THEN 'code' WHEN content LIKE '- %' THEN 'list_item' ELSE 'paragraph' END"
_KEPT = "(doc_id * 5 + page_index + idx * 3) % 7 <> 0"
_CUT = "CASE WHEN (doc_id + idx) % 4 = 0 THEN substring(text, 9) ELSE text END"
_OTHER = "CASE WHEN (doc_id + idx) % 9 = 0 THEN 'paragraph' ELSE kind END"


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = S.regions(spark, sf_dir).withColumns({"kind": F.expr(_KIND), "text": F.coalesce("content", F.lit(""))})
    block = lambda kind, text: F.struct("idx", kind.alias("kind"), text.alias("text"))
    listed = lambda x: F.array_sort(F.collect_list(x))
    return r.groupBy("doc_id", "page_index").agg(listed(block(F.col("kind"), F.col("text"))).alias("expected"), listed(F.when(F.expr(_KEPT), block(F.expr(_OTHER), F.expr(_CUT)))).alias("actual"))


_ALIGNED = f"""WITH RECURSIVE {S.SQL_REGIONS}, kinds AS (SELECT *, {_KIND} AS kind, coalesce(content, '') AS text FROM reg),
e AS (SELECT doc_id, page_index, row_number() OVER (PARTITION BY doc_id, page_index ORDER BY idx) AS j, kind, list_distinct(regexp_extract_all(text, '[^ \\t\\n\\r\\f\\x0B]+')) AS w FROM kinds),
a AS (SELECT doc_id, page_index, row_number() OVER (PARTITION BY doc_id, page_index ORDER BY idx) AS i, {_OTHER} AS kind, list_distinct(regexp_extract_all({_CUT}, '[^ \\t\\n\\r\\f\\x0B]+')) AS w FROM kinds WHERE {_KEPT}),
sizes AS (SELECT doc_id, page_index, count(*) AS m, coalesce(max(n), 0) AS n FROM e LEFT JOIN (SELECT doc_id, page_index, count(*) AS n FROM a GROUP BY 1, 2) USING (doc_id, page_index) GROUP BY 1, 2),
pairs AS (SELECT a.doc_id, a.page_index, a.i, e.j, a.kind AS ak, e.kind AS ek, CASE WHEN len(a.w) + len(e.w) = 0 THEN 1000000 ELSE 2000000 * len(list_intersect(a.w, e.w)) // (len(a.w) + len(e.w)) END AS alike FROM a JOIN e USING (doc_id, page_index)),
gains AS (SELECT doc_id, page_index, i, list(alike + CASE WHEN ak = ek THEN 200000 ELSE 0 END ORDER BY j) AS s FROM pairs GROUP BY 1, 2, 3),
best AS (
  SELECT doc_id, page_index, CAST(0 AS BIGINT) AS i, n, list_transform(range(0, m + 1), lambda j: CAST(-400000 * j AS BIGINT)) AS r FROM sizes
  UNION ALL
  SELECT doc_id, page_index, i, n, list_transform(range(0, len(t)), lambda j: list_max(t[1 : j + 1]) - 400000 * j) FROM (
    SELECT b.doc_id, b.page_index, g.i, b.n, list_prepend(b.r[1] - 400000, list_transform(range(1, len(b.r)), lambda j: greatest(b.r[j] + g.s[j], b.r[j + 1] - 400000) + 400000 * j)) AS t
    FROM best b JOIN gains g ON g.doc_id = b.doc_id AND g.page_index = b.page_index AND g.i = b.i + 1)),
walk AS (
  SELECT doc_id, page_index, n AS i, m AS j, CAST(NULL AS INTEGER) AS move, CAST(NULL AS BIGINT) AS ai, CAST(NULL AS BIGINT) AS ej, 0 AS k FROM sizes
  UNION ALL
  SELECT doc_id, page_index, i - (move <> 2)::INT, j - (move <> 1)::INT, move, CASE WHEN move <> 2 THEN i END, CASE WHEN move <> 1 THEN j END, k + 1 FROM (
    SELECT w.doc_id, w.page_index, w.i, w.j, w.k, CASE WHEN w.i > 0 AND w.j > 0 AND c.r[w.j + 1] = p.r[w.j] + g.s[w.j] THEN 0 WHEN w.i > 0 AND c.r[w.j + 1] = p.r[w.j + 1] - 400000 THEN 1 ELSE 2 END AS move
    FROM walk w JOIN best c ON c.doc_id = w.doc_id AND c.page_index = w.page_index AND c.i = w.i
    LEFT JOIN best p ON p.doc_id = w.doc_id AND p.page_index = w.page_index AND p.i = w.i - 1
    LEFT JOIN gains g ON g.doc_id = w.doc_id AND g.page_index = w.page_index AND g.i = w.i WHERE w.i > 0 OR w.j > 0)),
steps AS (
  SELECT w.doc_id, w.page_index, CAST(max(w.k) OVER (PARTITION BY w.doc_id, w.page_index) - w.k AS INTEGER) AS step, CASE move WHEN 0 THEN 'paired' WHEN 1 THEN 'extra_actual' ELSE 'missing_expected' END AS status,
         CAST(ai - 1 AS INTEGER) AS actual_index, CAST(ej - 1 AS INTEGER) AS expected_index, a.kind AS actual_kind, e.kind AS expected_kind, coalesce(CASE WHEN move = 0 THEN p.alike END, 0) / 1000000.0::DOUBLE AS score
  FROM walk w LEFT JOIN a ON a.doc_id = w.doc_id AND a.page_index = w.page_index AND a.i = w.ai LEFT JOIN e ON e.doc_id = w.doc_id AND e.page_index = w.page_index AND e.j = w.ej
  LEFT JOIN pairs p ON p.doc_id = w.doc_id AND p.page_index = w.page_index AND p.i = w.ai AND p.j = w.ej WHERE w.k > 0)"""


@query(f"{_ALIGNED} SELECT * FROM steps")
def block_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.align_blocks(_blocks(spark, sf_dir)).select("doc_id", "page_index", F.inline("steps"))


@query(f"""{_ALIGNED}, v AS (SELECT *, CASE coalesce(expected_kind, actual_kind) WHEN 'code' THEN 1.25 WHEN 'heading' THEN 1.15 WHEN 'formula' THEN 1.1 ELSE 1.0 END::DOUBLE AS weight FROM steps)
SELECT doc_id, page_index, count(*) AS n_steps, CAST(sum(CASE WHEN status = 'paired' THEN 1 ELSE 0 END) AS BIGINT) AS n_paired, round(sum(weight * score) / sum(weight), 9) AS aligned_score FROM v GROUP BY 1, 2""")
def aligned_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = O.align_blocks(_blocks(spark, sf_dir))
    paired = F.size(F.filter("steps", lambda s: s["status"] == "paired")).cast("long")
    return a.select("doc_id", "page_index", F.size("steps").cast("long").alias("n_steps"), paired.alias("n_paired"), F.round("aligned_score", 9).alias("aligned_score"))


@query(None)
def text_hunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document against itself with lines dropped, doubled and changed: one row a hunk. Few large row groups would be few tasks, so rows are dealt out."""
    lines = F.split("text", "\n")
    changed = F.flatten(F.transform(lines, lambda x, i: F.when((F.col("doc_id") + i) % 11 == 3, F.array().cast("array<string>")).when((F.col("doc_id") + i) % 13 == 5, F.array(x, x)).when((F.col("doc_id") + i) % 17 == 7, F.array(F.concat(x, F.lit(" more")))).otherwise(F.array(x))))
    dealt = S.table(spark, sf_dir, "documents").select("doc_id", "text").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    d = dealt.select("doc_id", F.array_join(lines, "\n").alias("expected"), F.when(F.col("doc_id") % 19 != 0, F.array_join(changed, "\n")).alias("actual"))
    found = O.compare_texts(d)
    return found.select("doc_id", "status", F.round("similarity", 9).alias("similarity"), F.posexplode_outer("hunks").alias("hunk", "h")).select("doc_id", "status", "similarity", "hunk", "h.header", F.array_join("h.lines", "").alias("lines"))


# Pages are PAGE lines of a document. Rules ask for words that stand there, or do so in one case of three only.
_LINES = f"SELECT doc_id, CAST(pos // {S.PAGE} AS INTEGER) + 1 AS page, string_agg(line, chr(10) ORDER BY pos) AS text FROM ln GROUP BY 1, 2"
_SQUEEZED = lambda x: f"trim(regexp_replace({x}, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), ' ')"
_TYPES = ["contains", "page_start", "page_end", "continuation", "page_length"]
_SPEC = {
    "check_id": "concat('r', CAST(k AS VARCHAR(9)))",
    "check_type": "CASE k " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(_TYPES)) + " END",
    "severity": "CASE (doc_id + k) % 3 WHEN 0 THEN 'critical' WHEN 1 THEN 'major' ELSE 'warn' END",
    "page": "CAST(1 + doc_id % 3 AS INT)",
    "phrase": "CASE WHEN (doc_id + k) % 3 = 0 THEN 'no such words' WHEN (doc_id + k) % 10 = 4 THEN NULL WHEN k = 1 THEN substring(text, 1, 40) ELSE substring(text, greatest(length(text) - 30, 1), 31) END",
    "next_phrase": "substring(after, 1, 25)",
}


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = S.table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n")
    return lines.groupBy("doc_id", F.expr(f"CAST(pos div {S.PAGE} AS INT) + 1").alias("page")).agg(text.alias("text"))


def _checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _pages(spark, sf_dir)
    first = pages.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("page", "text"))).alias("m"))
    at = lambda n: F.try_element_at("m", n)
    n = F.expr(_SPEC["page"])
    given = first.select("doc_id", F.coalesce(at(n), at(F.lit(1))).alias("text"), at(n + 1).alias("after"), F.explode(F.sequence(F.lit(0), F.lit(len(_TYPES) - 1))).alias("k"))
    rules = given.select("doc_id", *[F.expr(v.replace("VARCHAR(9)", "STRING")).alias(k) for k, v in _SPEC.items()])
    return O.check_rules(pages.where("doc_id % 17 <> 0"), rules)


_RULES = f"""{S.SQL_REGIONS}, pages AS ({_LINES}),
docs AS (SELECT DISTINCT doc_id FROM pages), given AS (
  SELECT d.doc_id, coalesce(p.text, f.text) AS text, n.text AS after, k FROM docs d LEFT JOIN pages p ON p.doc_id = d.doc_id AND p.page = 1 + d.doc_id % 3
  LEFT JOIN pages f ON f.doc_id = d.doc_id AND f.page = 1 LEFT JOIN pages n ON n.doc_id = d.doc_id AND n.page = 2 + d.doc_id % 3, (SELECT unnest(range(0, {len(_TYPES)})) AS k)),
rules AS (SELECT doc_id, {', '.join(f'{v} AS {k}' for k, v in _SPEC.items())} FROM given),
sq AS (SELECT doc_id, page, {_SQUEEZED("coalesce(text, '')")} AS text FROM pages WHERE doc_id % 17 <> 0),
whole AS (SELECT doc_id, string_agg(text, ' ' ORDER BY page) AS whole FROM sq GROUP BY 1),
j AS (SELECT r.*, {_SQUEEZED('phrase')} AS ph, {_SQUEEZED('next_phrase')} AS nx, w.whole, left(p.text, 400) AS st, right(p.text, 400) AS en, left(n.text, 400) AS ns
  FROM rules r LEFT JOIN whole w ON w.doc_id = r.doc_id LEFT JOIN sq p ON p.doc_id = r.doc_id AND p.page = r.page LEFT JOIN sq n ON n.doc_id = r.doc_id AND n.page = r.page + 1),
good AS (SELECT *, CASE check_type WHEN 'contains' THEN contains(whole, ph) WHEN 'page_start' THEN contains(st, ph) WHEN 'page_end' THEN contains(en, ph) WHEN 'continuation' THEN contains(en, ph) AND contains(ns, nx) END AS ok FROM j),
checked AS (SELECT doc_id, check_id, check_type, severity, CASE WHEN ok THEN 'pass' WHEN NOT ok THEN 'fail' ELSE 'error' END AS status,
  CASE WHEN ok IS NULL THEN CASE WHEN check_type = 'page_length' THEN 'Unknown check type.' WHEN whole IS NULL THEN 'No document.' ELSE 'No such page or phrase.' END
    WHEN check_type = 'contains' THEN CASE WHEN ok THEN 'Found required phrase for ' || check_id || '.' ELSE 'Missing required phrase: ''' || ph || '''.' END
    WHEN check_type = 'continuation' THEN 'Continuation across pages ' || page || ' -> ' || (page + 1) || CASE WHEN ok THEN ' matched.' ELSE ' broken.' END
    ELSE 'Page ' || page || CASE check_type WHEN 'page_start' THEN ' start ' ELSE ' end ' END || CASE WHEN ok THEN 'matched expected content.' ELSE 'doesn''t hold ''' || ph || '''.' END END AS message FROM good)"""


@query(f"WITH {_RULES} SELECT * FROM checked")
def rule_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _checked(spark, sf_dir)


@query(f"WITH {_RULES} SELECT doc_id, count(*) AS n_rules, count(*) FILTER (status = 'fail') AS n_failed, count(*) FILTER (status = 'error') AS n_error, round(sum(CASE WHEN status = 'pass' THEN w ELSE 0 END) / sum(w), 9) AS pass_rate FROM (SELECT *, CASE severity WHEN 'critical' THEN 3.0 WHEN 'major' THEN 2.0 ELSE 1.0 END::DOUBLE AS w FROM checked) GROUP BY 1")
def rule_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.rule_totals(_checked(spark, sf_dir)).withColumn("pass_rate", F.round("pass_rate", 9))
