"""Queries of selection, settings, gates and manifests, with the same rows in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import labels
from quire.operators import records as R
from quire.sources import derived as S

QUERIES, SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


_DIMS = labels.sql_dims()
_REG = f"{S.SQL_REGIONS}, {_DIMS}, rt AS (SELECT reg.*, coalesce(dim_label.task, 'abandon') AS task FROM reg LEFT JOIN dim_label USING (native_label))"


@query(f"WITH {_REG} SELECT doc_id, page_index, idx, native_label FROM rt WHERE task IN ('text', 'table', 'formula') AND idx IN (0, 2, 5, 9, 30) AND native_label IN ('text', 'doc_title', 'formula_number', 'image')")
def region_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = R.select_regions(S.regions(spark, sf_dir), [0, 2, 5, 9, 30], ["text", "doc_title", "formula_number", "image"])
    return chosen.select("doc_id", "page_index", "idx", "native_label")


@query(f"WITH {_REG} SELECT doc_id, page_index, idx, task, CASE task WHEN 'skip' THEN 'keep' WHEN 'abandon' THEN 'error' ELSE 'ocr' END AS route, CASE WHEN task IN ('skip', 'abandon') THEN content ELSE 'seen ' || length(content) END AS content FROM rt")
def ocr_scatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions that are recognised get their result back by offset; the stand-in for recognition is the content's length."""
    keys = ["doc_id", "page_index", "idx"]
    routed = R.route(S.regions(spark, sf_dir))
    results = routed.where("route = 'ocr'").select(*keys, F.concat(F.lit("seen "), F.length("content").cast("string")).alias("content"))
    return R.scatter(routed, results, keys).select(*keys, "task", "route", "content")


_LINE = "CASE event_id % 5 WHEN 0 THEN concat(' M out/', event_type) WHEN 1 THEN concat('R  old/', event_type, ' -> out/new ', event_id % 7) WHEN 2 THEN concat('?? \"src/', event_type, '\"') WHEN 3 THEN '' ELSE ' M out' END"


@query(f"WITH l AS (SELECT event_id, {_LINE} AS line FROM events), p AS (SELECT event_id, CASE WHEN length(line) >= 4 THEN trim(trim(CASE WHEN contains(substr(line, 4), ' -> ') THEN split_part(substr(line, 4), ' -> ', 2) ELSE substr(line, 4) END), '\"') END AS path FROM l) SELECT event_id, path, path = 'out' OR starts_with(path, 'out/') AS ignored FROM p WHERE path IS NOT NULL")
def dirty_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = R.porcelain_path(F.expr(_LINE))
    return S.table(spark, sf_dir, "events").select("event_id", path.alias("path")).where("path is not null").withColumn("ignored", R.ignored(F.col("path"), ["out/"]))


_ENV = {
    "b": "CASE c_custkey % 5 WHEN 0 THEN ' CoreImage ' WHEN 1 THEN 'deterministic' WHEN 2 THEN 'other' ELSE NULL END",
    "q": "CASE c_custkey % 4 WHEN 0 THEN '0.8' WHEN 1 THEN 'high' ELSE NULL END",
    "a": "CASE c_custkey % 6 WHEN 0 THEN 'no' WHEN 1 THEN ' YES' WHEN 2 THEN 'maybe' ELSE NULL END",
    "d": "CASE c_custkey % 7 WHEN 0 THEN 'FP16' WHEN 1 THEN 'bf16' WHEN 2 THEN 'int8' ELSE NULL END",
    "p": "CASE c_custkey % 3 WHEN 0 THEN 'coreImageBicubic' ELSE NULL END",
}


@query(
    "WITH e AS (SELECT c_custkey, " + ", ".join(f"{v} AS {k}" for k, v in _ENV.items()) + " FROM customer), s AS (SELECT *, CASE WHEN lower(trim(b)) IN ('coreimage', 'core_image', 'coreimagebicubic') THEN 'coreImageBicubic' WHEN lower(trim(b)) IN ('deterministic', 'deterministic_bicubic_cpu', 'deterministicbicubiccpu') THEN 'deterministicBicubicCPU' END AS sb, CASE lower(trim(d)) WHEN 'fp16' THEN 'float16' WHEN 'bf16' THEN 'bfloat16' END AS sd, coalesce(CASE WHEN lower(trim(a)) IN ('1', 'true', 'yes', 'on') THEN true WHEN lower(trim(a)) IN ('0', 'false', 'no', 'off') THEN false END, true) AS sa FROM e) "
    "SELECT c_custkey, coalesce(sb, p, 'coreImageBicubic') AS backend, try_cast(q AS DOUBLE) AS quality, sd IS NULL AND sa AS align, coalesce(sd, CASE WHEN sa THEN 'float32' END, 'bfloat16') AS dtype FROM s"
)
def image_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = {k: F.expr(v) for k, v in _ENV.items()}
    return S.table(spark, sf_dir, "customer").select("c_custkey", R.image_policy(e["b"], e["q"], e["a"], e["d"], e["p"], F.lit("float32")).alias("o")).select("c_custkey", "o.*")


@query("SELECT p_partkey, CAST(greatest(CASE WHEN far THEN floor(a * f + 0.5::DOUBLE) ELSE a END, 1) AS INT) AS w, CAST(greatest(CASE WHEN far THEN floor(b * f + 0.5::DOUBLE) ELSE b END, 1) AS INT) AS h FROM (SELECT *, greatest(a, b) > 1333 AS far, 1333.0::DOUBLE / greatest(a, b) AS f FROM (SELECT p_partkey, floor(w * (800.0::DOUBLE / least(w, h)) + 0.5::DOUBLE) AS a, floor(h * (800.0::DOUBLE / least(w, h)) + 0.5::DOUBLE) AS b FROM (SELECT p_partkey, CAST(greatest(p_partkey % 1900, 1) AS DOUBLE) AS w, CAST(p_size * 37 AS DOUBLE) AS h FROM part)))")
def target_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = S.table(spark, sf_dir, "part")
    return p.select("p_partkey", R.target_size(F.col("p_partkey") % 1900, F.col("p_size") * 37, 800, 1333).alias("s")).select("p_partkey", "s.w", "s.h")


_MD = "concat('![Image 1-', event_id % 9, '](imgs/', event_type, '.jpg) ![](page=1) ![Imagex](b) [Image](c) ', CASE WHEN event_id % 2 = 0 THEN '![Image]()![Image 2](d e)' ELSE '' END)"


@query(f"SELECT event_id, array_to_string(regexp_extract_all({_MD}, '!\\[Image[^\\]]*\\]\\(([^)]+)\\)', 1), '|') AS images FROM events")
def markdown_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.table(spark, sf_dir, "events").select("event_id", F.array_join(R.markdown_images(F.expr(_MD)), "|").alias("images"))


# Five decimals, of which a tenth end in 5, and thirty-seconds, of which half are exact ties.
_D = "CASE WHEN c_custkey % 9 = 0 THEN NULL WHEN c_custkey % 9 = 1 THEN CAST(c_custkey % 4001 - 2000 AS DOUBLE) / 32.0{0} ELSE CAST(c_custkey * 7919 % 400001 - 200000 AS DOUBLE) / 100000.0{0} END"


@query(f"SELECT c_custkey, CASE WHEN d IS NULL THEN 'None' ELSE printf('%.4f', d) END AS score, CASE WHEN d IS NULL THEN '' ELSE printf('%+.4f', d) END AS delta FROM (SELECT c_custkey, {_D.format('::DOUBLE')} AS d FROM customer)")
def score_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.expr(_D.format("D"))
    return S.table(spark, sf_dir, "customer").select("c_custkey", R.score_text(d).alias("score"), R.delta_text(d).alias("delta"))


_ST = {
    "lane": "CASE WHEN o_orderkey % 2 = 0 THEN 'parity' ELSE 'quality' END",
    "md": "CASE o_custkey % 7 WHEN 0 THEN 'missing' WHEN 1 THEN 'diff' ELSE 'match' END",
    "im": "CASE o_custkey % 5 WHEN 0 THEN 'missing' WHEN 1 THEN 'diff' ELSE 'match' END",
    "js": "CASE o_custkey % 6 WHEN 0 THEN 'missing' WHEN 1 THEN 'diff' WHEN 2 THEN 'error' WHEN 3 THEN NULL ELSE 'match' END",
}
_GATES = [["missing"], ["markdown"], ["images"], ["json"], ["missing", "markdown", "images", "json"], []]
_NOT_JSON = "lane = 'parity' AND js IS NOT NULL AND "
_WHEN = {"missing": f"md = 'missing' OR im = 'missing' OR ({_NOT_JSON}js IN ('missing', 'error'))", "markdown": "md <> 'match'", "images": "im <> 'match'", "json": f"({_NOT_JSON}js <> 'match')"}


@query("WITH s AS (SELECT o_orderdate, " + ", ".join(f"{v} AS {k}" for k, v in _ST.items()) + " FROM orders) SELECT o_orderdate, lane, count(*) AS reports, " + ", ".join(f"coalesce(bool_or({' OR '.join(_WHEN[c] for c in g) or 'false'}), false) AS fails_{i}" for i, g in enumerate(_GATES)) + " FROM s GROUP BY 1, 2")
def fail_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each run (a day's orders) and lane, under six sets of conditions."""
    s = S.table(spark, sf_dir, "orders").select("o_orderdate", *[F.expr(v).alias(k) for k, v in _ST.items()])
    tests = [F.coalesce(F.bool_or(R.fails(F.col("lane"), F.col("md"), F.col("im"), F.col("js"), g)), F.lit(False)).alias(f"fails_{i}") for i, g in enumerate(_GATES)]
    return s.groupBy("o_orderdate", "lane").agg(F.count("*").alias("reports"), *tests)


_BLOCK = {"label": "CASE l_partkey % 5 WHEN 0 THEN 'image' ELSE 'text' END", "ec": "CASE WHEN l_partkey % 5 = 0 THEN '' ELSE l_returnflag END", "ac": "CASE l_suppkey % 9 WHEN 0 THEN ' ' WHEN 1 THEN 'else' ELSE l_linestatus END", "al": "CASE l_partkey % 31 WHEN 0 THEN 'table' WHEN 5 THEN 'image' ELSE CASE l_partkey % 5 WHEN 0 THEN 'image' ELSE 'text' END END", "d": "CAST(l_suppkey % 19 AS INT)"}


@query("WITH b AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, " + ", ".join(f"{v} AS {k}" for k, v in _BLOCK.items()) + " FROM lineitem), p AS (SELECT *, CASE WHEN l_suppkey % 23 = 0 THEN 'count' WHEN al <> label THEN 'label' WHEN al = 'image' AND (trim(ac) <> '' OR ec <> '') THEN 'image not empty' WHEN al <> 'image' AND (trim(ac) = '' OR ec = '') THEN 'empty' WHEN d > 15 THEN 'bbox' END AS problem FROM b) SELECT coalesce(problem, 'none') AS problem, count(*) AS n, min(l_orderkey) AS first FROM p GROUP BY 1")
def parity_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = S.table(spark, sf_dir, "lineitem")
    c = {k: F.expr(v) for k, v in _BLOCK.items()}
    side = lambda label, content, x: F.struct(F.col("l_linenumber").alias("index"), label.alias("label"), content.alias("content"), F.array(x, F.lit(5), F.lit(50), F.lit(60)).alias("bbox"))
    both = t.select("l_orderkey", F.when(F.col("l_suppkey") % 23 != 0, side(c["al"], c["ac"], c["d"])).alias("a"), side(c["label"], c["ec"], F.lit(0)).alias("e"))
    return R.parity_problems(both).groupBy(F.coalesce("problem", F.lit("none")).alias("problem")).agg(F.count("*").alias("n"), F.min("l_orderkey").alias("first"))


@query("WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST((l_partkey * 31 + l_suppkey) % 101 AS DOUBLE) / 128.0::DOUBLE AS score FROM lineitem), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY score, l_linenumber, l_partkey, l_suppkey) AS INT) AS rank FROM p WHERE score < 0.5::DOUBLE) SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, score, rank FROM r WHERE rank <= 5")
def lowest_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five lowest of a document's pairs below one half, as the report shows them."""
    p = S.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.expr("CAST((l_partkey * 31 + l_suppkey) % 101 AS DOUBLE) / 128.0D").alias("score"))
    return R.lowest(p.where("score < 0.5"), "l_orderkey", "score", 5, ["l_linenumber", "l_partkey", "l_suppkey"])


_DIMS_OF = {"text": 31, "structure": 37, "style": 41}


@query("WITH d AS (" + " UNION ALL ".join(f"SELECT c_custkey, '{n}' AS dimension, CAST(c_custkey * {k} % 1001 AS DOUBLE) / 1000.0::DOUBLE AS score FROM customer" for n, k in _DIMS_OF.items()) + ") SELECT c_custkey, arg_min(dimension, (score, dimension)) AS dimension, min(score) AS score FROM d GROUP BY 1")
def lowest_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = S.table(spark, sf_dir, "customer")
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("dimension"), F.expr(f"CAST(c_custkey * {k} % 1001 AS DOUBLE) / 1000.0D").alias("score")) for n, k in _DIMS_OF.items()])).alias("d")
    d = c.select("c_custkey", each).select("c_custkey", "d.*")
    return R.lowest(d, "c_custkey", "score", 1, ["dimension"]).select("c_custkey", "dimension", "score")


@query(f"WITH {S.SQL_REGIONS}, e AS (SELECT doc_id, page_index, idx, b, 'region_' || lpad(CAST(idx AS VARCHAR), 3, '0') || '_' || native_label || '_' || b || '.png' AS file FROM reg, (VALUES ('core'), ('det')) AS t(b)) SELECT doc_id, page_index, string_agg(file, ',' ORDER BY idx, b) AS files FROM e GROUP BY 1, 2")
def preprocess_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = R.manifest(S.regions(spark, sf_dir), ["core", "det"])
    return m.select("doc_id", "page_index", F.array_join(F.transform("entries", lambda e: e["file"]), ",").alias("files"))


@query(f"WITH {S.SQL_REGIONS} SELECT doc_id, array_to_string(list_sort(list_distinct(list(page_index))), ',') AS pages, max(page_index) AS last FROM reg WHERE native_label = 'text' GROUP BY 1")
def pages_needed(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = R.pages_needed(S.regions(spark, sf_dir).where("native_label = 'text'"), "doc_id", "page_index")
    return p.select("doc_id", F.array_join(F.col("pages").cast("array<string>"), ",").alias("pages"), "last")


@query("WITH q AS (SELECT vec_id AS a, (vec_id * 7 + 3) % 1009 AS e FROM embeddings), s AS (SELECT vec_id AS b, (vec_id * 5 + 1) % 1009 AS e FROM embeddings) SELECT a, e, b FROM q JOIN s USING (e)")
def identity_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries of one side named by the other side's, through the encoder's index."""
    v = S.table(spark, sf_dir, "embeddings")
    q = v.select(F.col("vec_id").alias("a"), F.expr("(vec_id * 7 + 3) % 1009").alias("e"))
    return q.join(v.select(F.col("vec_id").alias("b"), F.expr("(vec_id * 5 + 1) % 1009").alias("e")), "e").select("a", "e", "b")
