"""Queries of inputs, arguments, lanes, outcomes, freshness and signals, with the same rows in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import config as C
from quire.operators import evaluate as E
from quire.operators import runs as R
from quire.sources import derived as S

QUERIES, SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


_URI = "CASE WHEN page_id % 9 = 0 THEN url ELSE concat('file:///in/', CAST(page_id AS VARCHAR(20)), '.pdf') END"
_PAGE = "CAST(page_id % 6 - 1 AS INT)"
_DIR = "CASE WHEN page_id % 5 = 0 THEN NULL WHEN page_id % 7 = 0 THEN true ELSE false END"


@query(f"SELECT page_id, CASE WHEN u IS NOT NULL AND NOT starts_with(u, 'file://') THEN 'invalid url' WHEN p < 1 THEN 'invalid page' WHEN d IS NULL THEN 'not found' WHEN d THEN 'directory' END AS problem FROM (SELECT page_id, {_URI} AS u, {_PAGE} AS p, {_DIR} AS d FROM pages)")
def input_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = [F.expr(x.replace("VARCHAR(20)", "STRING")) for x in (_URI, _PAGE, _DIR)]
    return S.table(spark, sf_dir, "pages").select("page_id", R.input_problem(*e).alias("problem"))


_ARGS = {
    "max_new_tokens": "CASE WHEN o_orderkey % 37 = 0 THEN 0 ELSE 10 END",
    "pages": "CASE o_custkey % 11 WHEN 0 THEN ' ' WHEN 1 THEN '1-3' WHEN 2 THEN 'x' ELSE NULL END",
    "layout": "o_orderkey % 5 = 0",
    "no_layout": "o_orderkey % 7 = 0",
    "emit_json": "CASE o_custkey % 6 WHEN 0 THEN '' WHEN 1 THEN 'a.json' ELSE NULL END",
    "emit_document": "CASE o_custkey % 13 WHEN 0 THEN '  ' WHEN 1 THEN 'b.json' ELSE NULL END",
    "download_only": "o_orderkey % 17 = 0",
    "dev_forward": "o_orderkey % 19 = 0",
    "input": "CASE o_orderkey % 8 WHEN 0 THEN NULL WHEN 1 THEN 'd.PDF' WHEN 2 THEN ' d.pdf' WHEN 3 THEN 'x/.pdf' ELSE 'p.png' END",
    "is_dir": "CASE o_custkey % 9 WHEN 0 THEN NULL WHEN 1 THEN true ELSE false END",
    "pages_problem": "CASE o_custkey % 11 WHEN 2 THEN 'not a page' ELSE NULL END",
}
_ASKED = "(pages IS NOT NULL AND trim(pages) <> '')"


@query(
    "WITH a AS (SELECT o_orderkey, " + ", ".join(f"{v} AS {k}" for k, v in _ARGS.items()) + " FROM orders), b AS (SELECT *, emit_json IS NOT NULL OR emit_document IS NOT NULL AS emits, NOT (download_only OR dev_forward) AS runs, coalesce(lower(trim(input)) = 'd.pdf', false) AS pdf FROM a) "
    "SELECT o_orderkey, layout OR (NOT no_layout AND pdf) AS enabled, CASE WHEN max_new_tokens <= 0 THEN '--max-new-tokens must be > 0' WHEN pages = ' ' THEN '--pages must be non-empty' WHEN layout AND no_layout THEN 'Pass at most one of --layout or --no-layout' WHEN emit_json = '' THEN '--emit-json path must be non-empty' WHEN emit_document = '  ' THEN '--emit-ocrdocument-json path must be non-empty' "
    "WHEN NOT runs THEN CASE WHEN emits THEN '--emit-json/--emit-ocrdocument-json require running inference' END WHEN input IS NULL THEN '--input is required unless --download-only or --dev-forward-pass is set' WHEN is_dir IS NULL THEN 'Input not found: ' || trim(input) WHEN is_dir THEN 'Input is a directory: ' || trim(input) "
    f"WHEN {_ASKED} AND NOT pdf THEN '--pages is only valid for PDF inputs' WHEN pdf AND pages_problem IS NOT NULL THEN '--pages: ' || pages_problem WHEN emits AND NOT (layout OR (NOT no_layout AND pdf)) THEN '--emit-json/--emit-ocrdocument-json require layout mode (pass --layout for non-PDF inputs)' END AS problem FROM b"
)
def argument_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = {k: F.expr(v) for k, v in _ARGS.items()}
    enabled = R.layout_enabled(F.trim(a["input"]), a["layout"], a["no_layout"])
    return S.table(spark, sf_dir, "orders").select("o_orderkey", enabled.alias("enabled"), R.argument_problem(a).alias("problem"))


_STATE = "CASE {0} % {1} WHEN 0 THEN 'missing' WHEN 1 THEN 'diff' ELSE 'match' END"


@query(
    f"WITH o AS (SELECT DISTINCT o_custkey AS k FROM orders), l AS (SELECT k, lane FROM o, (VALUES ('parity'), ('quality')) AS v(lane)) SELECT lane, k, CASE WHEN (k + length(lane)) % 8 = 0 THEN 'missing' ELSE {_STATE.format('(k + length(lane))', 5)} END AS markdown, CASE WHEN k % 10 = 0 THEN 'missing' ELSE {_STATE.format('k', 4)} END AS images, CASE WHEN lane = 'parity' THEN CASE WHEN k % 6 = 0 THEN 'missing' ELSE {_STATE.format('k', 7)} END END AS json FROM l"
)
def lane_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both lanes' rows for each customer with orders; comparisons that weren't made are missing."""
    names = S.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")).distinct()
    both = names.select("k", F.explode(F.array(F.lit("parity"), F.lit("quality"))).alias("lane"))
    state = lambda n, k: F.expr(_STATE.format(n, k)).alias("status")
    markdown = both.where("(k + length(lane)) % 8 <> 0").select("lane", "k", state("(k + length(lane))", 5))
    images = both.where("k % 10 <> 0").select("lane", "k", state("k", 4))
    return R.lane_reports(names, "k", markdown, images, names.where("k % 6 <> 0").select("k", state("k", 7)))


_PATH = "concat('in/', event_type, '/', CAST(event_id AS VARCHAR(20)), CASE event_id % 5 WHEN 0 THEN '.PDF' WHEN 1 THEN '.png' WHEN 2 THEN '.txt' WHEN 3 THEN '.jpeg' ELSE '' END)"


@query("WITH e AS (SELECT event_type, CASE WHEN event_id % 5 IN (2, 4) THEN 'skipped' WHEN event_id % 3 <> 0 AND event_id % 7 <> 0 THEN 'succeeded' ELSE 'failed' END AS outcome FROM events) SELECT event_type, count(*) FILTER (outcome = 'succeeded') AS succeeded, count(*) FILTER (outcome = 'skipped') AS skipped, count(*) FILTER (outcome = 'failed') AS failed, CASE WHEN bool_or(outcome = 'failed') THEN 'failed' ELSE 'ok' END AS status FROM e GROUP BY 1")
def batch_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = S.table(spark, sf_dir, "events").select("event_id", "event_type", F.expr(_PATH.replace("VARCHAR(20)", "STRING")).alias("path"))
    results = e.where("event_id % 3 <> 0").select("path", (F.col("event_id") % 7 != 0).alias("ok"))
    return R.run_status(R.outcomes(e, results), "event_type")


@query("SELECT CASE WHEN p_partkey % 6 = 0 THEN '._' ELSE '' END || 'p' || p_partkey || '.v1.pdf' AS name FROM part WHERE p_partkey % 6 <> 0 AND (p_partkey % 4 = 0 OR p_partkey % 9 = 0)")
def incomplete_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources without a Markdown or a JSON file."""
    p = S.table(spark, sf_dir, "part").select("p_partkey", F.expr("concat(CASE WHEN p_partkey % 6 = 0 THEN '._' ELSE '' END, 'p', p_partkey, '.v1.pdf')").alias("name"))
    file = lambda e: F.concat(R.stem(F.col("name")), F.lit("/"), R.stem(F.col("name")), F.lit(e)).alias("path")
    return R.incomplete(p, p.where("p_partkey % 4 <> 0").select(file(".md")).unionByName(p.where("p_partkey % 9 <> 0").select(file(".json"))))


@query("SELECT doc_id, doc_id % 11 = 0 OR NOT (doc_id % 7 <> 0 AND doc_id % 5 > 1 AND doc_id % 3 <> 0) AS refresh FROM documents")
def stale_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose results are made anew; some have no fingerprint, some an old one or none stored."""
    now = F.when(F.col("doc_id") % 7 != 0, F.sha2("text", 256)).otherwise("")
    stored = F.when(F.col("doc_id") % 5 == 0, F.lit(None)).when(F.col("doc_id") % 5 == 1, "old").otherwise(F.sha2("text", 256))
    return S.table(spark, sf_dir, "documents").where("text is not null").select("doc_id", R.needs_refresh(now, stored, F.col("doc_id") % 3 != 0, F.col("doc_id") % 11 == 0).alias("refresh"))


# A report of each customer; scores have five decimals.
_H = lambda k: f"CAST(c_custkey * {k * 997} % 100001 AS DOUBLE) / 100000.0"
_BLOCKS = [
    ("'paired'", f"CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE {_H(23)} END"),
    ("CASE c_custkey % 3 WHEN 0 THEN 'missing' ELSE 'paired' END", _H(24)),
    ("CASE c_custkey % 4 WHEN 0 THEN '' ELSE 'paired' END", _H(25)),
]
_RULE = "CASE (c_custkey + {0}) % 3 WHEN 0 THEN 'fail' WHEN 1 THEN 'pass' ELSE 'error' END"
_SCORE = lambda v: f"printf('%.4f', {v})"


# What isn't a number, or not an object, is put in front of each map and list; it changes no line.
ODD = {'"final_dimensions":{': '"note":"x","low":"0.1",', '"components":{': '"bad":"0.1",', '"tables":[': '"x",', '"blocks":[': '"x",7,null,', '"rules":[': '"fail",'}


def _report():
    h, lit = (lambda k: F.expr(_H(k).replace("100000.0", "100000.0D"))), F.lit
    style = lambda a, b: F.struct(F.expr(a).alias("center_wrappers"), F.expr(b).alias("bold_markers"))
    block = lambda i, s, v: F.struct(lit(i).alias("index"), F.expr(s).alias("status"), F.expr(v.replace("100000.0", "100000.0D")).alias("score"), lit("p").alias("actual_kind"), lit("h").alias("expected_kind"))
    details = F.struct(
        F.struct(style("c_custkey % 3", "CASE WHEN c_custkey % 4 <> 0 THEN c_custkey % 5 END").alias("actual"), style("c_custkey % 2", "1").alias("expected")).alias("style"),
        F.struct((F.col("c_custkey") % 8 != 0).alias("available"), F.struct(h(7).alias("order"), h(13).alias("bbox")).alias("components")).alias("json"),
        F.struct(F.array(F.struct(lit(0).alias("index"), h(3).alias("score")), F.struct(lit(1).alias("index"), F.when(F.col("c_custkey") % 5 != 0, h(17)).alias("score"))).alias("tables")).alias("tables"),
        h(19).alias("block_shape"),
        F.struct(F.array(*[block(i, s, v) for i, (s, v) in enumerate(_BLOCKS)]).alias("blocks")).alias("text"),
    )
    parity = F.struct((F.col("c_custkey") % 11 != 0).alias("available"), F.when(F.col("c_custkey") % 2 == 0, "no file").alias("missing_reason"), details.alias("details"))
    rules = F.array(*[F.struct(F.expr(_RULE.format(i)).alias("status"), lit(f"r{i}").alias("check_id"), lit("count").alias("check_type"), F.concat(lit("m"), F.col("c_custkey").cast("string")).alias("message")) for i in range(2)])
    out = F.to_json(F.struct(parity.alias("parity"), F.struct(h(31).alias("text"), h(37).alias("structure"), h(41).alias("style")).alias("final_dimensions"), rules.alias("rules")))
    for at, odd in ODD.items():
        out = F.replace(out, F.lit(at), F.lit(at + odd))
    return out


_PAIR = "CASE WHEN s <> 'paired' OR v < 0.5 THEN {'v': v, 'i': i, 't': '(idx=' || i || ', status=' || s || ', actual=p, expected=h, score=' || printf('%.4f', v) || ')'} END"


@query(
    "WITH b AS (SELECT c_custkey, i, s, coalesce(v, 0.0)::DOUBLE AS v FROM (" + " UNION ALL ".join(f"SELECT c_custkey, {i} AS i, {s} AS s, ({v})::DOUBLE AS v FROM customer" for i, (s, v) in enumerate(_BLOCKS)) + ")), "
    f"low AS (SELECT c_custkey, string_agg('(idx=' || i || ', status=' || s || ', actual=p, expected=h, score=' || {_SCORE('v')} || ')', ', ' ORDER BY v, i) AS low FROM b WHERE s <> 'paired' OR v < 0.5 GROUP BY 1), "
    "st AS (SELECT c_custkey, string_agg(s || '=' || n, ', ' ORDER BY s) AS st FROM (SELECT c_custkey, CASE WHEN s = '' THEN 'unknown' ELSE s END AS s, count(*) AS n FROM b GROUP BY 1, 2) GROUP BY 1), "
    "named AS (SELECT c_custkey, 'd' AS g, unnest(['text', 'structure', 'style']) AS k, unnest([0, 1, 2]) AS i, unnest([" + ", ".join(f"({_H(k)})::DOUBLE" for k in (31, 37, 41)) + "]) AS v FROM customer UNION ALL SELECT c_custkey, 'c', unnest(['order', 'bbox']), unnest([0, 1]), unnest([" + ", ".join(f"({_H(k)})::DOUBLE" for k in (7, 13)) + f"]) FROM customer WHERE c_custkey % 8 <> 0 UNION ALL SELECT c_custkey, 't', unnest(['#0', '#1']), unnest([0, 1]), unnest([({_H(3)})::DOUBLE, (CASE WHEN c_custkey % 5 <> 0 THEN {_H(17)} END)::DOUBLE]) FROM customer), "
    f"agg AS (SELECT c_custkey, arg_min(k, (v, i)) FILTER (g = 'd') AS dk, min(v) FILTER (g = 'd') AS dv, string_agg(k || '=' || {_SCORE('v')}, ', ' ORDER BY v, i) FILTER (g = 'c' AND v < 0.98) AS parts, string_agg(k || '=' || {_SCORE('v')}, ', ' ORDER BY i) FILTER (g = 't' AND v < 0.98) AS tabs FROM named GROUP BY 1), "
    f"x AS (SELECT c.c_custkey, ({_H(19)})::DOUBLE AS shape, c_custkey % 3 <> c_custkey % 2 AS cd, c_custkey % 4 <> 0 AND c_custkey % 5 <> 1 AS bd, {_RULE.format(0)} AS r0, {_RULE.format(1)} AS r1 FROM customer c) "
    "SELECT x.c_custkey, CASE WHEN x.c_custkey % 11 = 0 THEN '- parity: unavailable (' || CASE WHEN x.c_custkey % 2 = 0 THEN 'no file' ELSE 'missing parity score' END || ')' ELSE "
    f"concat_ws(chr(10), '- lowest dimension: `' || dk || '` = ' || {_SCORE('dv')}, CASE WHEN cd THEN '- style.center_wrappers: actual=' || (x.c_custkey % 3) || ', expected=' || (x.c_custkey % 2) END, CASE WHEN bd THEN '- style.bold_markers: actual=' || (x.c_custkey % 5) || ', expected=1' END, '- json components < 0.98: ' || parts, '- tables < 0.98: ' || tabs, CASE WHEN shape < 0.98 THEN '- block_shape: ' || {_SCORE('shape')} END, '- text blocks: ' || st, '- lowest text pairs: ' || low, "
    "CASE WHEN r0 <> 'pass' OR r1 <> 'pass' THEN '- rules failed: ' || ((r0 <> 'pass')::INT + (r1 <> 'pass')::INT) || ' (first: ' || CASE WHEN r0 <> 'pass' THEN 'r0' ELSE 'r1' END || ' / count / m' || x.c_custkey || ')' END, "
    "'- fix_hints: ' || nullif(concat_ws(', ', " + ", ".join(f"CASE WHEN {t} THEN '{R.HINTS[k]}' END" for k, t in {"style": "cd OR bd", "json": "parts IS NOT NULL", "blocks": "shape < 0.98 OR low IS NOT NULL", "tables": "tabs IS NOT NULL", "rules": "r0 <> 'pass' OR r1 <> 'pass'"}.items()) + "), '')) END AS signals FROM x JOIN agg USING (c_custkey) JOIN st USING (c_custkey) LEFT JOIN low USING (c_custkey)"
)
def report_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports are long to read, so that their rows are dealt out."""
    dealt = S.table(spark, sf_dir, "customer").select("c_custkey").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    return dealt.select("c_custkey", F.array_join(R.signals(_report()), "\n").alias("signals"))


# A report of each lane for some of the customers; JSON is compared in the parity lane only.
_STATUS = lambda k: f"CASE (c_custkey * {k}) % 5 WHEN 0 THEN 'missing' WHEN 1 THEN 'diff' ELSE 'match' END"


@query(f"""WITH p AS (SELECT c_custkey, {_STATUS(7)} AS md, CASE WHEN c_custkey % 4 <> 0 THEN {_STATUS(11)} END AS js, {_STATUS(13)} AS im FROM customer WHERE c_custkey % 3 <> 0),
q AS (SELECT c_custkey, {_STATUS(17)} AS md, {_STATUS(19)} AS im FROM customer WHERE c_custkey % 5 <> 0)
SELECT c_custkey, '| `' || c_custkey || '` | ' || concat_ws(' | ', coalesce(p.md, '—'), coalesce(p.js, '—'), coalesce(p.im, '—'), coalesce(q.md, '—'), coalesce(q.im, '—')) || ' |' AS line,
  '{{"name":"' || c_custkey || '"' || coalesce(',"parity":{{"markdown":"' || p.md || '"' || coalesce(',"json":"' || p.js || '"', '') || ',"images":"' || p.im || '"}}', '') || coalesce(',"quality":{{"markdown":"' || q.md || '","images":"' || q.im || '"}}', '') || '}}' AS entry
FROM p FULL JOIN q USING (c_custkey)""")
def combined_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = S.table(spark, sf_dir, "customer")
    status = lambda k: F.expr(_STATUS(k))
    parity = c.where("c_custkey % 3 <> 0").select(F.lit("parity").alias("lane"), "c_custkey", status(7).alias("markdown"), status(13).alias("images"), F.when(F.col("c_custkey") % 4 != 0, status(11)).alias("json"))
    quality = c.where("c_custkey % 5 <> 0").select(F.lit("quality").alias("lane"), "c_custkey", status(17).alias("markdown"), status(19).alias("images"), F.lit(None).cast("string").alias("json"))
    return E.combined_rows(parity.unionByName(quality), "c_custkey")


# Settings of each part as JSON, some broken, some of the wrong type.
_SETTINGS = """CASE WHEN p_partkey % 13 = 0 THEN 'no json' ELSE concat('{"do_resize": ', CASE p_partkey % 5 WHEN 0 THEN 'false' WHEN 1 THEN '"yes"' WHEN 2 THEN 'null' ELSE 'true' END,
 CASE p_partkey % 4 WHEN 0 THEN ', "size": {"height": 800, "width": 600}' WHEN 1 THEN concat(', "size": {"shortest_edge": ', CAST(100 + p_size * 16 AS VARCHAR(9)), ', "longest_edge": 1333}') WHEN 2 THEN ', "size": {"height": 0, "width": 5.5}' ELSE '' END,
 CASE p_partkey % 3 WHEN 0 THEN ', "image_mean": [0.1, 0.2, 0.3], "image_std": [1, 2, 3]' WHEN 1 THEN ', "image_mean": [0.1]' ELSE '' END, ', "other": [1]}') END"""
_SIDES = "greatest(1, p_partkey % 1900)::DOUBLE AS w, greatest(1, p_size * 37)::DOUBLE AS h"


@query(f"""WITH t AS (SELECT p_partkey, {_SETTINGS} AS t, {_SIDES} FROM part),
j AS (SELECT *, CASE WHEN t = 'no json' THEN 'not a JSON object' WHEN json_type(t, '$.do_resize') = 'VARCHAR' THEN 'bad field do_resize' WHEN json_type(t, '$.size.width') = 'DOUBLE' THEN 'bad field size.width' END AS problem, CASE WHEN t <> 'no json' THEN CAST(t AS JSON) END AS o FROM t),
f AS (SELECT *, coalesce(CASE WHEN problem IS NULL THEN CAST(json_extract_string(o, '$.do_resize') AS BOOLEAN) END, problem IS NULL) AS doit, CAST(json_extract_string(o, '$.size.shortest_edge') AS DOUBLE) AS short, json_array_length(o, '$.image_mean') = 3 AND coalesce(json_array_length(o, '$.image_std'), 3) = 3 AS own FROM j),
e AS (SELECT *, floor(w * (short / least(w, h)) + 0.5::DOUBLE) AS a, floor(h * (short / least(w, h)) + 0.5::DOUBLE) AS b FROM f),
l AS (SELECT *, CASE WHEN greatest(a, b) > 1333 THEN 1333.0::DOUBLE / greatest(a, b) END AS s FROM e)
SELECT p_partkey, problem, CAST(CASE WHEN doit AND problem IS NULL THEN CASE p_partkey % 4 WHEN 0 THEN 600 WHEN 1 THEN greatest(1, coalesce(floor(a * s + 0.5::DOUBLE), a)) END END AS INT) AS w, CAST(CASE WHEN doit AND problem IS NULL THEN CASE p_partkey % 4 WHEN 0 THEN 800 WHEN 1 THEN greatest(1, coalesce(floor(b * s + 0.5::DOUBLE), b)) END END AS INT) AS h,
  CASE WHEN problem IS NULL THEN CASE WHEN coalesce(own, false) THEN '0.1,0.2,0.3' ELSE '0.5,0.5,0.5' END END AS mean FROM l""")
def preprocessor_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = S.table(spark, sf_dir, "part").withColumn("c", C.read_config(F.expr(_SETTINGS.replace("VARCHAR(9)", "STRING")), C.PREPROCESSOR))
    size = C.resized(F.col("c.config"), F.col("p_partkey") % 1900, F.col("p_size") * 37)
    mean = F.array_join(F.transform(C.mean_and_std(F.col("c.config"))["mean"], lambda x: x.cast("string")), ",")
    return p.select("p_partkey", "c.problem", size["w"].alias("w"), size["h"].alias("h"), F.when(F.col("c.config").isNotNull(), mean).alias("mean"))
