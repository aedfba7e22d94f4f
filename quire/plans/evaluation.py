"""Queries of the evaluation loop, with the same rows in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import values as V
from quire.operators import evaluate as E
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


# Blocks of an order are its lines; the actual side loses, moves and relabels some by rule.
_POS = "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1"
_EXP = {"page": "CAST(pos // 4 AS INT)", "idx": "CAST(pos % 4 AS INT)", "label": "CASE l_partkey % 5 WHEN 0 THEN 'image' WHEN 1 THEN 'table' ELSE 'text' END", "content": "CASE WHEN l_partkey % 5 = 0 THEN '' ELSE l_returnflag || l_linestatus END", "x": "CAST(l_suppkey % 900 AS INT)"}


def _blocks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    t = S.table(spark, sf_dir, "lineitem").withColumn("pos", F.expr(_POS).cast("int"))
    cols = {k: F.expr(v.replace("//", "div")) for k, v in _EXP.items()}
    base = t.select("l_orderkey", "l_partkey", "l_suppkey", cols["page"].alias("page"), cols["idx"].alias("pos"), cols["idx"].alias("index"), cols["label"].alias("label"), cols["content"].alias("content"), cols["x"].alias("x"))
    box = lambda d: F.array(F.col("x") + d, F.col("x"), F.col("x") + 50, F.col("x") + 90)
    expected = base.withColumn("bbox", box(F.lit(0)))
    actual = base.where("l_orderkey % 11 <> 0 and not (l_orderkey % 7 = 0 and page = 1) and not (l_orderkey % 13 = 0 and page = 0 and pos = 3)").withColumn("bbox", box(F.expr("cast(l_suppkey % 23 as int)")))
    actual = actual.withColumns({"label": F.expr("case when l_partkey % 97 = 0 then 'formula' else label end"), "content": F.expr("case when l_partkey % 89 = 0 then ' ' when l_partkey % 5 > 0 and l_partkey % 3 = 0 then concat(content, ' ', char(13), char(10)) when l_partkey % 83 = 0 then 'other' else content end")})
    return actual, expected


_BASE = f"b0 AS (SELECT *, {_POS} AS pos FROM lineitem), bs AS (SELECT l_orderkey, l_partkey, l_suppkey, {', '.join(f'{v} AS {k}' for k, v in _EXP.items())} FROM b0), ac AS (SELECT l_orderkey, page, idx, x, CAST(l_suppkey % 23 AS INT) AS d, CASE WHEN l_partkey % 97 = 0 THEN 'formula' ELSE label END AS label, CASE WHEN l_partkey % 89 = 0 THEN ' ' WHEN l_partkey % 5 > 0 AND l_partkey % 3 = 0 THEN content || ' ' || chr(13) || chr(10) WHEN l_partkey % 83 = 0 THEN 'other' ELSE content END AS content FROM bs WHERE l_orderkey % 11 <> 0 AND NOT (l_orderkey % 7 = 0 AND page = 1) AND NOT (l_orderkey % 13 = 0 AND page = 0 AND idx = 3))"
_NORM = r"trim(regexp_replace(regexp_replace({0}, '\r\n?', chr(10), 'g'), '[ \t]+\n', chr(10), 'g'), ' ' || chr(9) || chr(10))"
_CMP = f"""WITH {_BASE},
j AS (SELECT e.l_orderkey AS k, e.page AS p, e.idx AS i, a.page IS NOT NULL AS m, e.label AS el, a.label AS al, a.d, {_NORM.format('e.content')} AS ec, {_NORM.format('a.content')} AS xc FROM bs e LEFT JOIN ac a ON a.l_orderkey = e.l_orderkey AND a.page = e.page AND a.idx = e.idx),
n AS (SELECT *, max(p) OVER (PARTITION BY k) + 1 AS pe, max(CASE WHEN m THEN p END) OVER (PARTITION BY k) + 1 AS pa, count(*) OVER (PARTITION BY k, p) <> count(CASE WHEN m THEN 1 END) OVER (PARTITION BY k, p) AS odd,
  CASE WHEN m THEN CAST(al <> el AS INT) + CAST(d > 15 AS INT) ELSE 0 END AS s,
  CASE WHEN NOT m THEN 0 WHEN el = 'image' THEN CAST(ec <> '' OR xc <> '' AS INT) ELSE CAST(ec = '' OR xc = '' OR ec <> xc AS INT) END AS c FROM j),
u AS (SELECT *, CAST(odd AND i = 0 AS INT) AS u FROM n WHERE p < least(pe, pa) AND pa IS NOT NULL),
w AS (SELECT *, CAST(pe <> pa AS INT) + coalesce(sum(u + s + c) OVER (PARTITION BY k ORDER BY p, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bf FROM u),
v AS (SELECT *, first_value(bf) OVER (PARTITION BY k, p ORDER BY i) < 20 AS pg FROM w),
g AS (SELECT k, any_value(pe) AS pe, any_value(pa) AS pa, count(*) FILTER (pg) AS be, count(*) FILTER (pg AND m) AS ba, coalesce(max(d) FILTER (pg AND bf + u < 20 AND m), 0) AS md, CAST(any_value(CAST(pe <> pa AS INT)) + coalesce(sum(u) FILTER (pg), 0) + coalesce(sum(s) FILTER (pg AND bf + u < 20), 0) AS BIGINT) AS ns, CAST(coalesce(sum(c) FILTER (pg AND bf + u < 20), 0) AS BIGINT) AS nc FROM v GROUP BY k)
SELECT o.k AS l_orderkey, CASE WHEN g.k IS NULL THEN 'missing' WHEN ns + nc = 0 THEN 'match' ELSE 'diff' END AS status, ns = 0 AS structural_ok, nc = 0 AS content_ok, md AS max_bbox_delta, pe AS pages_expected, pa AS pages_actual, CASE WHEN pe = pa THEN be END AS blocks_expected, CASE WHEN pe = pa THEN ba END AS blocks_actual, ns + nc AS n_problems FROM (SELECT DISTINCT k FROM j) o LEFT JOIN g ON g.k = o.k"""


@query(_CMP)
def eval_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.compare_blocks(*_blocks(spark, sf_dir), "l_orderkey").drop("details")


@query(f"SELECT status, structural_ok, count(*) AS n, max(max_bbox_delta) AS worst, CAST(sum(n_problems) AS BIGINT) AS problems FROM ({_CMP}) GROUP BY 1, 2")
def eval_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = E.compare_blocks(*_blocks(spark, sf_dir), "l_orderkey")
    return b.groupBy("status", "structural_ok").agg(F.count("*").alias("n"), F.max("max_bbox_delta").alias("worst"), F.sum("n_problems").alias("problems"))


# Two runs: scores are whole cents of the balance, so sums are exact.
_SC = "CAST(c_custkey * 7919 % 10000 AS DOUBLE) / 10000.0"
_BF = "CAST((c_custkey * 7919 + CASE c_custkey % 5 WHEN 0 THEN 25 WHEN 1 THEN -25 WHEN 2 THEN 5 ELSE 0 END) % 10000 AS DOUBLE) / 10000.0"


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = S.table(spark, sf_dir, "customer")
    now = c.select("c_custkey", F.expr(_SC.replace("10000.0", "10000.0D")).alias("score"))
    before = c.where("c_custkey % 13 <> 0").select("c_custkey", F.expr(_BF.replace("10000.0", "10000.0D")).alias("score"))
    return E.baseline_delta(now, before, "c_custkey")


_DELTA = f"WITH n AS (SELECT c_custkey, {_SC}::DOUBLE AS score, CASE WHEN c_custkey % 13 <> 0 THEN {_BF}::DOUBLE END AS before FROM customer), d AS (SELECT *, score - before AS delta FROM n) SELECT c_custkey, score, before, delta, CASE WHEN delta IS NULL THEN 'new' WHEN delta < -0.001::DOUBLE THEN 'regression' WHEN delta > 0.001::DOUBLE THEN 'improvement' ELSE 'same' END AS change FROM d"
_DELTA_TEXT = f"SELECT *, coalesce(printf('%+.4f', delta), '') AS delta_text FROM ({_DELTA})"


@query(_DELTA_TEXT)
def eval_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _runs(spark, sf_dir)


@query(f"SELECT change, count(*) AS n, round(avg(score), 4) AS mean, round(min(delta), 4) AS worst FROM ({_DELTA}) GROUP BY 1")
def eval_delta_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _runs(spark, sf_dir).groupBy("change").agg(F.count("*").alias("n"), F.round(F.avg("score"), 4).alias("mean"), F.round(F.min("delta"), 4).alias("worst"))


@query(f"SELECT c_custkey, score, delta FROM ({_DELTA}) WHERE score < 0.05::DOUBLE OR coalesce(delta < -0.001::DOUBLE, false)")
def eval_focus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.focus(_runs(spark, sf_dir), "c_custkey", low=0.05).select("c_custkey", "score", "delta")


_DIM = lambda k: f"CAST((c_custkey * {k}) % 1001 AS DOUBLE) / 1000.0"


@query(f"WITH d AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE {_DIM(31)}::DOUBLE END AS al, {_DIM(37)}::DOUBLE AS wh, {_DIM(41)}::DOUBLE AS st, {_DIM(43)}::DOUBLE AS sy, {_DIM(47)}::DOUBLE AS rg, {_DIM(53)}::DOUBLE AS ug FROM customer), t AS (SELECT *, CASE WHEN al IS NULL THEN wh ELSE 0.35::DOUBLE * al + 0.65::DOUBLE * wh END AS fid FROM d) SELECT c_custkey, round(fid, 6) AS fidelity, round(0.6::DOUBLE * fid + 0.35::DOUBLE * st + 0.05::DOUBLE * sy, 6) AS overall, round(st + CASE WHEN abs(0.25::DOUBLE * (rg - ug)) < 0.02::DOUBLE THEN 0 ELSE 0.25::DOUBLE * (rg - ug) END, 6) AS final FROM t")
def eval_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = lambda k: F.expr(_DIM(k).replace("1000.0", "1000.0D"))
    d = S.table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 != 0, v(31)).alias("al"), v(37).alias("wh"), v(41).alias("st"), v(43).alias("sy"), v(47).alias("rg"), v(53).alias("ug"))
    d = d.withColumn("fid", E.text_fidelity(F.col("al"), F.col("wh")))
    return d.select("c_custkey", F.round("fid", 6).alias("fidelity"), F.round(E.overall(F.col("fid"), F.col("st"), F.col("sy")), 6).alias("overall"), F.round(E.final_dimension(F.col("st"), F.col("rg"), F.col("ug")), 6).alias("final"))


@query("SELECT p_partkey, round(1 - (least(abs(a - 100), 15) + least(abs(b - 200), 15) + least(abs(c - 300), 15) + least(abs(d - 400), 15)) / 15.0::DOUBLE / 4, 6) AS bbox FROM (SELECT p_partkey, 100 + p_partkey % 19 AS a, 200 - p_size % 23 AS b, 300 + p_partkey % 3 AS c, 400 AS d FROM part)")
def eval_bbox_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.array(*[F.expr(x).cast("int") for x in ("100 + p_partkey % 19", "200 - p_size % 23", "300 + p_partkey % 3", "400")])
    return S.table(spark, sf_dir, "part").select("p_partkey", F.round(E.bbox_score(a, F.array(*[F.lit(x) for x in (100, 200, 300, 400)])), 6).alias("bbox"))


@query("WITH e AS (SELECT l_orderkey, 'img' || (l_linenumber) AS n, max(l_partkey % 3) AS h FROM lineitem WHERE l_orderkey % 5 > 0 GROUP BY 1, 2), a AS (SELECT l_orderkey, 'img' || (l_linenumber) AS n, max(l_suppkey % 2 + l_partkey % 3 * (l_orderkey % 2)) AS h FROM lineitem WHERE l_partkey % 4 > 0 GROUP BY 1, 2), k AS (SELECT DISTINCT l_orderkey FROM lineitem), j AS (SELECT coalesce(e.l_orderkey, a.l_orderkey) AS l_orderkey, coalesce(e.n, a.n) AS n, e.n IS NOT NULL AS ie, a.n IS NOT NULL AS ia, e.h <> a.h AS df FROM e FULL JOIN a ON e.l_orderkey = a.l_orderkey AND e.n = a.n), g AS (SELECT k.l_orderkey, coalesce(string_agg(n, ',' ORDER BY n) FILTER (ie AND NOT ia), '') AS missing, coalesce(string_agg(n, ',' ORDER BY n) FILTER (ia AND NOT ie), '') AS extra, coalesce(string_agg(n, ',' ORDER BY n) FILTER (ia AND ie AND df), '') AS mismatch, coalesce(bool_or(ie), false) AS has_any FROM k LEFT JOIN j ON j.l_orderkey = k.l_orderkey GROUP BY 1) SELECT l_orderkey, CASE WHEN NOT has_any THEN 'match' WHEN missing <> '' THEN 'missing' WHEN extra <> '' OR mismatch <> '' THEN 'diff' ELSE 'match' END AS status, missing, extra, mismatch FROM g")
def image_set_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = S.table(spark, sf_dir, "lineitem").withColumn("n", F.concat(F.lit("img"), F.col("l_linenumber").cast("string")))
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<bigint>"))

    def side(where: str, value: str, name: str) -> DataFrame:
        named = t.where(where).groupBy("l_orderkey", "n").agg(F.max(F.expr(value)).alias("h"))
        return named.groupBy("l_orderkey").agg(F.map_from_entries(F.collect_list(F.struct("n", "h"))).alias(name))

    e, a = side("l_orderkey % 5 > 0", "l_partkey % 3", "e"), side("l_partkey % 4 > 0", "l_suppkey % 2 + l_partkey % 3 * (l_orderkey % 2)", "a")
    both = t.select("l_orderkey").distinct().join(e, "l_orderkey", "left").join(a, "l_orderkey", "left")
    r = both.withColumn("r", E.compare_images(F.coalesce("e", empty), F.coalesce("a", empty)))
    return r.select("l_orderkey", "r.status", *[F.array_join(f"r.{x}", ",").alias(x) for x in ("missing", "extra", "mismatch")])


_LANE = "CASE WHEN o_orderkey % 7 = 0 THEN 'missing' WHEN o_custkey % 3 = 0 THEN 'diff' ELSE 'match' END"


@query(f"WITH p AS (SELECT o_orderkey, {_LANE} AS parity FROM orders WHERE o_orderkey % 4 <> 1), q AS (SELECT o_orderkey, CASE WHEN o_custkey % 5 = 0 THEN 'missing' ELSE 'match' END AS quality FROM orders WHERE o_orderkey % 4 <> 2) SELECT coalesce(p.o_orderkey, q.o_orderkey) AS o_orderkey, parity, quality, coalesce(parity <> 'match', false) OR coalesce(quality = 'missing', false) AS fails FROM p FULL JOIN q ON p.o_orderkey = q.o_orderkey")
def lane_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = S.table(spark, sf_dir, "orders")
    p = o.where("o_orderkey % 4 <> 1").select("o_orderkey", F.expr(_LANE).alias("status"))
    q = o.where("o_orderkey % 4 <> 2").select("o_orderkey", F.expr("CASE WHEN o_custkey % 5 = 0 THEN 'missing' ELSE 'match' END").alias("status"))
    return E.lane_summary(p, q, "o_orderkey")


@query("SELECT doc_id, sha256(text) AS fingerprint FROM documents")
def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("fingerprint"))


_RAW = "CASE event_id % 6 WHEN 0 THEN CAST(event_id AS VARCHAR(20)) WHEN 1 THEN event_id || '.0' WHEN 2 THEN event_id || '.5' WHEN 3 THEN 'true' WHEN 4 THEN ' No ' ELSE event_type END"


@query(f"SELECT event_id, CASE WHEN TRY_CAST(r AS DOUBLE) = floor(TRY_CAST(r AS DOUBLE)) THEN TRY_CAST(TRY_CAST(r AS DOUBLE) AS BIGINT) END AS as_int, CASE WHEN lower(trim(r)) IN ('1', 'true', 'yes', 'on') THEN true WHEN lower(trim(r)) IN ('0', 'false', 'no', 'off') THEN false END AS as_bool, regexp_replace(r, '[^\\p{{L}}\\p{{M}}\\p{{N}}_-]', '_', 'g') AS name, lpad(CAST(event_id % 1000 AS VARCHAR), 3, '0') AS number FROM (SELECT event_id, event_type, {_RAW} AS r FROM events)")
def scalar_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = S.table(spark, sf_dir, "events").withColumn("r", F.expr(_RAW.replace("VARCHAR(20)", "STRING")))
    return e.select("event_id", V.as_int(F.col("r")).alias("as_int"), V.as_bool(F.col("r")).alias("as_bool"), V.safe_name(F.col("r")).alias("name"), F.format_string("%03d", F.col("event_id") % 1000).alias("number"))


@query(None)
def eval_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formatted pages against the raw ones; the ratio is procedural, so no SQL."""
    raw = S.regions(spark, sf_dir)
    a = O.document_markdown(O.page_markdown(O.format_regions(raw)))
    plain = raw.where("content is not null").withColumn("kind", F.lit("text"))
    return E.compare_markdown(a, O.document_markdown(O.page_markdown(plain)), "doc_id")


@query(f"SELECT c_custkey, score, delta FROM ({_DELTA}) WHERE score >= 0.95::DOUBLE AND coalesce(delta >= 0, true) ORDER BY score, c_custkey LIMIT 3")
def eval_focus_worst(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of rows that are all good enough, the three of lowest score."""
    fine = _runs(spark, sf_dir).where("score >= 0.95 and coalesce(delta >= 0, true)")
    return E.focus(fine, "c_custkey", low=0.95).select("c_custkey", "score", "delta")
