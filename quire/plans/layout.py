"""Queries over detections, with the same rows in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import geometry as G
from quire.functions import labels
from quire.operators import detect as D
from quire.operators import pagearrays as A
from quire.operators import raster as R
from quire.sources import derived as S

QUERIES, SQL = {}, {}
_DET, _DIM = S.SQL_DETECTIONS, labels.sql_dims()
_VALID = "x1 BETWEEN 0 AND 1000 AND y1 BETWEEN 0 AND 1000 AND x2 BETWEEN 0 AND 1000 AND y2 BETWEEN 0 AND 1000 AND x1 < x2 AND y1 < y2"
_FLAT = ["page_id", "det_idx", "class_id", "x1", "y1", "x2", "y2"]


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def flat(df: DataFrame, *more: str) -> DataFrame:
    return df.select("page_id", "det_idx", "class_id", "bbox.x1", "bbox.y1", "bbox.x2", "bbox.y2", *more)


@query(f"WITH {_DIM}, {_DET} SELECT page_id, det_idx, coalesce(c.native_label, 'class_' || CAST(class_id AS VARCHAR)) AS native_label, coalesce(task, 'abandon') AS task, coalesce(kind, 'unknown') AS kind FROM det LEFT JOIN dim_class c USING (class_id) LEFT JOIN dim_label l ON l.native_label = c.native_label")
def route_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.route_labels(S.detections(spark, sf_dir)).select("page_id", "det_idx", "native_label", "task", "kind")


@query(f"WITH {_DIM}, {_DET} SELECT coalesce(kind, 'unknown') AS kind, coalesce(task, 'abandon') AS task, count(*) AS n, count(DISTINCT page_id) AS pages FROM det LEFT JOIN dim_class c USING (class_id) LEFT JOIN dim_label l ON l.native_label = c.native_label GROUP BY 1, 2")
def kind_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.route_labels(S.detections(spark, sf_dir)).groupBy("kind", "task").agg(F.count("*").alias("n"), F.count_distinct("page_id").alias("pages"))


_UNIT = "l_extendedprice / 100000 - 0.1"


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(trunc(greatest(CAST(0 AS FLOAT), least(CAST(1 AS FLOAT), CAST({_UNIT} AS FLOAT))) * CAST(1000 AS FLOAT)) AS INT) AS edge, CAST(trunc(CAST((l_partkey % 1000) / 1000.0::DOUBLE AS FLOAT) * CAST(1000 AS FLOAT)) AS INT) AS exact FROM lineitem")
def bbox_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = S.table(spark, sf_dir, "lineitem")
    return t.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", G.normalise(F.expr(_UNIT)).alias("edge"), G.normalise(F.col("l_partkey") % 1000 / F.lit(1000.0)).alias("exact"))


@query(f"WITH {_DET} SELECT page_id, det_idx, cx - 0.5::DOUBLE * w AS x1, cy - 0.5::DOUBLE * h AS y1, cx + 0.5::DOUBLE * w AS x2, cy + 0.5::DOUBLE * h AS y2 FROM (SELECT page_id, det_idx, CAST(x1 AS DOUBLE) AS cx, CAST(y1 AS DOUBLE) AS cy, CAST(x2 - x1 AS DOUBLE) AS w, CAST(y2 - y1 AS DOUBLE) AS h FROM det)")
def boxes_xyxy(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = flat(S.detections(spark, sf_dir))
    c = d.select("page_id", "det_idx", F.col("x1").cast("double").alias("cx"), F.col("y1").cast("double").alias("cy"), (F.col("x2") - F.col("x1")).cast("double").alias("w"), (F.col("y2") - F.col("y1")).cast("double").alias("h"))
    half = lambda a, b, s: (F.col(a) + s * 0.5 * F.col(b))
    return c.select("page_id", "det_idx", half("cx", "w", -1).alias("x1"), half("cy", "h", -1).alias("y1"), half("cx", "w", 1).alias("x2"), half("cy", "h", 1).alias("y2"))


@query(f"WITH {_DET} SELECT page_id, det_idx, class_id, greatest(0, least(1000, x1)) AS x1, greatest(0, least(1000, y1)) AS y1, greatest(0, least(1000, x2)) AS x2, greatest(0, least(1000, y2)) AS y2, ({_VALID}) AS valid, concat_ws(' ', greatest(0, least(1000, x1)), greatest(0, least(1000, y1)), greatest(0, least(1000, x2)), greatest(0, least(1000, y1)), greatest(0, least(1000, x2)), greatest(0, least(1000, y2)), greatest(0, least(1000, x1)), greatest(0, least(1000, y2))) AS polygon FROM det")
def clamped_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = S.detections(spark, sf_dir).withColumn("valid", G.valid(F.col("bbox"))).withColumn("bbox", G.clamp(F.col("bbox")))
    corners = F.flatten(F.transform(G.polygon(F.col("bbox")), lambda p: F.array(p["x"].cast("string"), p["y"].cast("string"))))
    return flat(d, "valid", F.array_join(corners, " ").alias("polygon"))


@query(f"WITH {_DET}, r AS (SELECT *, 1.5::DOUBLE AS wr, CASE WHEN class_id = 21 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS hr FROM det) SELECT page_id, det_idx, class_id, " + ", ".join(f"CAST(CASE WHEN x2 > x1 AND y2 > y1 THEN floor(greatest(0.0::DOUBLE, least(1000.0::DOUBLE, {lo} + ({hi} - {lo}) / 2.0::DOUBLE {s} ({hi} - {lo}) * {r} / 2.0::DOUBLE))) ELSE {n} END AS INT) AS {n}" for n, lo, hi, s, r in (("x1", "x1", "x2", "-", "wr"), ("y1", "y1", "y2", "-", "hr"), ("x2", "x1", "x2", "+", "wr"), ("y2", "y1", "y2", "+", "hr"))) + " FROM r")
def unclip_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(D.unclip_boxes(S.detections(spark, sf_dir), F.lit(1.5), F.when(F.col("class_id") == 21, 1.0).otherwise(2.0)))


def _inter(a: str, b: str, plus: int) -> str:
    side = lambda lo, hi: f"greatest(0, least({a}.{hi}, {b}.{hi}) - greatest({a}.{lo}, {b}.{lo}) + {plus})"
    return f"{side('x1', 'x2')} * {side('y1', 'y2')}"


_AREA1 = lambda a: f"({a}.x2 - {a}.x1 + 1) * ({a}.y2 - {a}.y1 + 1)"
_NMS = f"""val AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, det_idx) AS rk FROM det WHERE {_VALID}),
nms AS (
  SELECT page_id, 0 AS rk, CAST([] AS BIGINT[]) AS kept, max(rk) AS n FROM val GROUP BY page_id
  UNION ALL
  SELECT m.page_id, m.rk + 1, CASE WHEN EXISTS (
      SELECT 1 FROM val s WHERE s.page_id = m.page_id AND list_contains(m.kept, s.rk)
      AND {_inter('s', 'v', 1)} >= (CASE WHEN s.class_id = v.class_id THEN 0.6::DOUBLE ELSE 0.98::DOUBLE END) * ({_AREA1('s')} + {_AREA1('v')} - {_inter('s', 'v', 1)}))
    THEN m.kept ELSE list_append(m.kept, v.rk) END, m.n
  FROM nms m JOIN val v ON v.page_id = m.page_id AND v.rk = m.rk + 1 WHERE m.rk < m.n),
kept AS (SELECT v.* FROM nms m JOIN val v ON v.page_id = m.page_id AND list_contains(m.kept, v.rk) WHERE m.rk = m.n)"""


@query(f"WITH RECURSIVE {_DET}, {_NMS} SELECT {', '.join(_FLAT)} FROM kept")
def nms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(D.nms(D.drop_invalid(S.detections(spark, sf_dir))))


def _hit(src: str) -> str:
    area = "greatest(0, i.x2 - i.x1) * greatest(0, i.y2 - i.y1)"
    return f"hit AS (SELECT i.page_id, i.det_idx AS i, j.det_idx AS j, i.class_id AS ci, j.class_id AS cj FROM {src} i JOIN {src} j ON i.page_id = j.page_id AND i.det_idx <> j.det_idx WHERE i.class_id NOT IN (14, 20, 3) AND {area} > 0 AND ({_inter('i', 'j', 0)}) * 5 >= {area} * 4)"


_IN = "EXISTS (SELECT 1 FROM hit h WHERE h.page_id = d.page_id AND h.i = d.det_idx {0})"
_OUT = "EXISTS (SELECT 1 FROM hit h WHERE h.page_id = d.page_id AND h.j = d.det_idx {0})"
_LARGE = f"NOT {_IN.format('')}"
_SMALL = f"(NOT {_OUT.format('')} OR {_IN.format('')})"
_BYCLASS = f"NOT {_IN.format('AND h.cj <> 18 AND h.cj BETWEEN 0 AND 24')} AND (NOT {_OUT.format('AND h.ci = 18')} OR {_IN.format('AND h.ci = 18')})"


def _containment(mode):
    return lambda spark, sf_dir: flat(D.containment(D.drop_invalid(S.detections(spark, sf_dir)), mode))


for _name, _mode, _where in (("containment_large", "large", _LARGE), ("containment_small", "small", _SMALL), ("containment_by_class", None, _BYCLASS)):
    QUERIES[_name] = _containment(_mode)
    SQL[_name] = f"WITH {_DET}, val AS (SELECT * FROM det WHERE {_VALID}), {_hit('val')} SELECT {', '.join(_FLAT)} FROM val d WHERE {_where}"

_LIMGS = "img AS (SELECT *, count(*) OVER p AS n, sum(CASE WHEN sm THEN 1 ELSE 0 END) OVER p AS lft FROM (SELECT *, class_id <> 14 OR (greatest(0, least(1000, x2)) - greatest(0, least(1000, x1))) * (greatest(0, least(1000, y2)) - greatest(0, least(1000, y1))) <= {limit} AS sm FROM {src}) WINDOW p AS (PARTITION BY page_id)), big AS (SELECT * FROM img WHERE n <= 1 OR lft = 0 OR sm)"


@query("WITH " + _DET.replace("l_partkey % 26", "CASE WHEN l_partkey % 2 = 0 THEN 14 ELSE l_partkey % 26 END") + ", " + _LIMGS.format(limit="CASE WHEN page_id % 2 = 0 THEN 820000 ELSE 930000 END", src="(SELECT page_id, det_idx, class_id, x1 * 2 AS x1, y1 * 2 AS y1, x2 * 2 AS x2, y2 * 2 AS y2 FROM det)") + f" SELECT {', '.join(_FLAT)} FROM big")
def large_image_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _images(spark, sf_dir)
    return flat(D.drop_large_images(d, F.when(F.col("page_id") % 2 == 0, 1200).otherwise(800), F.lit(1000)))


def _images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections of which every other one is an image, twice as large."""
    d = S.detections(spark, sf_dir, "CAST(CASE WHEN l_partkey % 2 = 0 THEN 14 ELSE l_partkey % 26 END AS INT)")
    twice = F.struct(*[(F.col(f"bbox.{e}") * 2).alias(e) for e in G.EDGES])
    return d.withColumn("bbox", twice)


@query(f"WITH {_DET}, p AS (SELECT *, x2 > x1 AND y2 > y1 AS bx, x2 > x1 AND y2 > y1 AND score >= CAST(0.6 AS FLOAT) AS ps FROM det), a AS (SELECT *, max(ps) OVER (PARTITION BY page_id) AS an FROM p) SELECT {', '.join(_FLAT)} FROM a WHERE bx AND (ps OR NOT an)")
def score_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(D.threshold_or_all(S.detections(spark, sf_dir), 0.6))


@query("SELECT page_id, rank, flat_idx, logit FROM (SELECT *, CAST(row_number() OVER (PARTITION BY page_id ORDER BY logit DESC, flat_idx) AS INT) AS rank FROM (SELECT label AS page_id, vec_id * 64 + i AS flat_idx, CASE WHEN CAST(abs(embedding[1]) AS FLOAT) > CAST(0.005 AS FLOAT) AND CAST(abs(embedding[2]) AS FLOAT) > CAST(0.005 AS FLOAT) THEN embedding[i + 1] ELSE CAST(-100 AS FLOAT) END AS logit FROM (SELECT *, unnest(range(0, 64)) AS i FROM embeddings))) WHERE rank <= 300")
def topk_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = S.table(spark, sf_dir, "embeddings").select("label", "vec_id", F.abs(F.col("embedding")[0]).alias("w"), F.abs(F.col("embedding")[1]).alias("h"), F.posexplode("embedding").alias("i", "logit"))
    flat_ = D.mask_tiny(e, 200, 200).select(F.col("label").alias("page_id"), (F.col("vec_id") * 64 + F.col("i")).alias("flat_idx"), "logit")
    return D.top_queries(flat_, 300, score="logit").select("page_id", "rank", "flat_idx", "logit")


@query(f"WITH {_DET} SELECT page_id, det_idx, CAST(row_number() OVER (PARTITION BY page_id ORDER BY coalesce(order_seq, 0), y1, x1, y2, x2, det_idx) - 1 AS INT) AS idx FROM det")
def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.reading_order(S.detections(spark, sf_dir)).select("page_id", "det_idx", "idx")


@query(f"WITH RECURSIVE {_DIM}, {_DET}, {_NMS}, {_LIMGS.format(limit='930000', src='kept')}, {_hit('big')}, cm AS (SELECT * FROM big d WHERE {_BYCLASS}), o AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY coalesce(order_seq, 0), y1, x1, y2, x2, det_idx) AS q FROM cm), rt AS (SELECT o.*, coalesce(c.native_label, 'class_' || CAST(class_id AS VARCHAR)) AS native_label, coalesce(task, 'abandon') AS task FROM o LEFT JOIN dim_class c USING (class_id) LEFT JOIN dim_label l ON l.native_label = c.native_label) SELECT {', '.join(_FLAT)}, native_label, task, CAST(row_number() OVER (PARTITION BY page_id ORDER BY q) - 1 AS INT) AS idx FROM rt WHERE task <> 'abandon'")
def layout_postprocess(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(D.postprocess(S.detections(spark, sf_dir), F.lit(800), F.lit(1000)), "native_label", "task", "idx")


_PAIR = "CAST((i * 31 + j * 17 + label) % 64 AS DOUBLE) / 64.0{0}"


@query("WITH e AS (SELECT label, vec_id // 300 AS page, vec_id % 300 AS i FROM embeddings), p AS (SELECT a.label, a.page, a.i, b.i AS j, " + "CAST((a.i * 31 + b.i * 17 + a.label) % 64 AS DOUBLE) / 64.0::DOUBLE AS p FROM e a JOIN e b ON a.label = b.label AND a.page = b.page AND a.i < b.i), v AS (SELECT label, page, item, sum(v) AS vote FROM (SELECT label, page, j AS item, p AS v FROM p UNION ALL SELECT label, page, i, 1 - p FROM p) GROUP BY 1, 2, 3) SELECT label, page, item, vote, CAST(row_number() OVER (PARTITION BY label, page ORDER BY vote, item) AS INT) AS rank FROM v")
def order_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page has 300 queries, as many as the model gives; a label's vectors are dealt to pages by their id."""
    e = S.table(spark, sf_dir, "embeddings").select(F.struct("label", F.expr("vec_id div 300").alias("page")).alias("at"), (F.col("vec_id") % 300).alias("i"))
    p = e.join(e.withColumnRenamed("i", "j"), "at").where("i < j").withColumn("p", F.expr(_PAIR.replace("label", "at.label").format("D")))
    return D.order_votes(p, "at").select("at.label", "at.page", "item", "vote", "rank")


_CROP = {"w": "1200 + page_id % 7 * 10", "h": "1600 + page_id % 5 * 10"}


@query(f"WITH {_DET}, s AS (SELECT *, {_CROP['w']} AS pw, {_CROP['h']} AS ph FROM det), c AS (SELECT *, " + ", ".join(f"CAST(greatest(0, least({n}, floor({e} * {n} / 1000.0::DOUBLE))) AS INT) AS c{e}" for e, n in (("x1", "pw"), ("x2", "pw"), ("y1", "ph"), ("y2", "ph"))) + " FROM s) SELECT page_id, det_idx, cx1 AS x, CAST(ph - cy2 AS INT) AS y, cx2 - cx1 AS w, cy2 - cy1 AS h, cx2 - cx1 <= 0 OR cy2 - cy1 <= 0 AS empty, class_id = 21 AS by_polygon, class_id IN (21, 5, 15, 14, 3) AS derive_polygon, class_id = 22 AND cx2 - cx1 >= 340 AND cy2 - cy1 <= 36 AS exact_resize FROM c")
def crop_rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = S.detections(spark, sf_dir).withColumn("r", G.crop_rect(F.col("bbox"), F.expr(_CROP["w"]), F.expr(_CROP["h"])))
    label = labels.label_of(F.col("class_id"))
    return d.select(
        "page_id", "det_idx", "r.x", "r.y", "r.w", "r.h",
        ((F.col("r.w") <= 0) | (F.col("r.h") <= 0)).alias("empty"),
        (labels.task_of(label) == "table").alias("by_polygon"),
        (labels.task_of(label).isin("table", "formula") | label.isin("image", "chart")).alias("derive_polygon"),
        ((label == "text") & (F.col("r.w") >= 340) & (F.col("r.h") <= 36)).alias("exact_resize"),
    )


def _rs() -> str:
    near = lambda v: f"round({v} / 28.0::DOUBLE) * 28"
    vol = f"(2 * ({near('h')}) * ({near('w')}))"
    fit = lambda v: f"CAST(greatest(28, CASE WHEN {vol} > 71372800 THEN floor({v} / sqrt(2 * h * w / 71372800.0::DOUBLE) / 28.0::DOUBLE) * 28 WHEN {vol} < 12544 THEN ceil({v} * sqrt(12544.0::DOUBLE / (2 * h * w)) / 28.0::DOUBLE) * 28 ELSE {near(v)} END) AS INT)"
    tok = "CAST(floor(floor(rh / 14) / 2) * floor(floor(rw / 14) / 2) AS INT)"
    return f"SELECT p_partkey, rh, rw, {tok} AS tokens, CAST(greatest(ceil(p_size * 200 / 72.0::DOUBLE), 1) AS INT) AS px FROM (SELECT p_partkey, p_size, {fit('h')} AS rh, {fit('w')} AS rw FROM (SELECT *, p_partkey % 97 * p_size * 2 + 1 AS h, p_partkey % 89 * 3 * p_size + 1 AS w FROM part))"


@query(_rs())
def smart_resize(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = S.table(spark, sf_dir, "part").withColumns({"h": F.expr("p_partkey % 97 * p_size * 2 + 1"), "w": F.expr("p_partkey % 89 * 3 * p_size + 1")})
    p = p.withColumn("r", G.smart_resize(F.col("h"), F.col("w")))
    return p.select("p_partkey", F.col("r.h").alias("rh"), F.col("r.w").alias("rw"), G.image_tokens(F.col("r.h"), F.col("r.w")).alias("tokens"), G.rendered_pixels(F.col("p_size")).alias("px"))


# Pages of parallel arrays: a page in seven has an order too few, one in eleven a label too few; a third have polygons, of these some one too few.
_POLY = [("x1 - 20", "y1"), ("x2", "y1"), ("x2", "y2 + 30")]
_CLAMP = lambda v: f"greatest(0, least(1000, {v}))"
_GIVEN = "page_id % 3 = 0 AND page_id % 5 <> 0 AND det_idx % 4 <> 3"
_CORNERS = "concat_ws(' ', " + ", ".join(_CLAMP(v) for v in ("x1", "y1", "x2", "y1", "x2", "y2", "x1", "y2")) + ")"
_SHAPE = "concat_ws(' ', " + ", ".join(_CLAMP(v) for p in _POLY for v in p) + ")"
_NOTES = [
    ("page_id % 7 = 0", "'order_seq count mismatch; using fallback ordering'"),
    ("page_id % 3 = 0 AND page_id % 5 = 0", "'polygon count mismatch; falling back to bbox polygons'"),
    ("removed > 0", "'filter_large_image removed ' || removed || ' region(s)'"),
    ("page_id % 7 = 0", "'order_seq missing; using (y1, x1) fallback ordering'"),
]
_RAW = _DET.replace("FROM lineitem)", "FROM lineitem WHERE l_orderkey % 11 <> 0)").replace("CASE WHEN l_orderkey % 3 = 0 THEN NULL", "CASE WHEN l_orderkey % 3 = 0 OR l_orderkey % 7 = 0 THEN NULL")


@query(f"""WITH RECURSIVE {_DIM}, {_RAW}, {_NMS}, {_LIMGS.format(limit='930000', src='kept')}, {_hit('big')}, cm AS (SELECT * FROM big d WHERE {_BYCLASS}),
o AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY coalesce(order_seq, 0), y1, x1, y2, x2, det_idx) - 1 AS idx FROM cm),
lost AS (SELECT k.page_id, k.n - b.n AS removed FROM (SELECT page_id, count(*) AS n FROM kept GROUP BY 1) k JOIN (SELECT page_id, count(*) AS n FROM big GROUP BY 1) b USING (page_id))
SELECT page_id, CAST(idx AS INT) AS idx, det_idx, coalesce(c.native_label, 'class_' || CAST(class_id AS VARCHAR)) AS native_label, coalesce(task, 'abandon') AS task, CASE WHEN order_seq > 0 THEN order_seq END AS "order",
  CASE WHEN {_GIVEN} THEN {_SHAPE} ELSE {_CORNERS} END AS polygon, concat_ws('|', {', '.join(f"CASE WHEN {k} THEN {v} END" for k, v in _NOTES)}) AS diagnostics
FROM o JOIN lost USING (page_id) LEFT JOIN dim_class c USING (class_id) LEFT JOIN dim_label l ON l.native_label = c.native_label""")
def raw_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The layout stage from parallel arrays; pages whose counts differ have no regions."""
    points = F.array(*[F.struct(F.expr(x).alias("x"), F.expr(y).alias("y")) for x, y in _POLY])
    d = S.detections(spark, sf_dir).select("*", "bbox.*").withColumn("shape", F.slice(points, 1, F.when(F.col("det_idx") % 4 == 3, 2).otherwise(3)))
    pages = A.gathered(d.select("page_id", "det_idx", "class_id", "score", "bbox", "order_seq", "shape"))
    each = lambda c: F.col("dets")[c]
    shorter = lambda c, odd: F.when(F.expr(odd), F.slice(each(c), 1, F.size("dets") - 1)).otherwise(each(c))
    polygons = F.when(F.col("page_id") % 3 == 0, shorter("shape", "page_id % 5 = 0"))
    raw = pages.select("page_id", F.lit(800).alias("width"), F.lit(1000).alias("height"), each("score").alias("scores"), shorter("class_id", "page_id % 11 = 0").alias("labels"), each("bbox").alias("boxes"), shorter("order_seq", "page_id % 7 = 0").alias("order_seq"), polygons.alias("polygons"))
    found = A.regions_of(A.regions_from_raw(raw), F.array_join("diagnostics", "|").alias("diagnostics"))
    corners = F.transform("polygon", lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string")))
    return found.select("page_id", "idx", "det_idx", "native_label", "task", "order", F.array_join(corners, " ").alias("polygon"), "diagnostics")


# Polygons of five points, crossing themselves as they like, on pictures of 40 by 30 pixels.
_FIVE = [(f"p_partkey * {37 + 10 * i} % {1001 - i}", f"(p_partkey * {53 + 6 * i} + p_size * 17) % {1001 - 2 * i}") for i in range(5)]
_TURN = lambda i, j: f"CASE WHEN (y{i} <= cy) <> (y{j} <= cy) AND x{i} + (cy - y{i}) * (x{j} - x{i}) / (y{j} - y{i}) <= cx THEN CASE WHEN y{j} > y{i} THEN 1 ELSE -1 END ELSE 0 END"
_WOUND = "(" + " + ".join(_TURN(i, (i + 1) % 5) for i in range(5)) + ")"


@query(f"""WITH p AS (SELECT p_partkey, {', '.join(f'({x}) * 40 / 1000.0::DOUBLE AS x{i}, ({y}) * 30 / 1000.0::DOUBLE AS y{i}' for i, (x, y) in enumerate(_FIVE))} FROM part),
px AS (SELECT p.*, gy.y, gx.x, gy.y + 0.5::DOUBLE AS cy, gx.x + 0.5::DOUBLE AS cx FROM p, (SELECT unnest(range(0, 30)) AS y) gy, (SELECT unnest(range(0, 40)) AS x) gx)
SELECT p_partkey, CAST(y AS INT) AS y, CAST(sum(CASE WHEN {_WOUND} <> 0 THEN 1 ELSE 0 END) AS INT) AS pixels, CAST(coalesce(min(CASE WHEN {_WOUND} <> 0 THEN x END), -1) AS INT) AS first FROM px GROUP BY 1, 2""")
def polygon_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pixels that a polygon covers in each row, against the winding number at each pixel's centre."""
    points = F.array(*[F.struct(F.expr(x).alias("x"), F.expr(y).alias("y")) for x, y in _FIVE])
    shapes = S.table(spark, sf_dir, "part").select("p_partkey", points.alias("polygon"), F.lit(40).alias("width"), F.lit(30).alias("height"))
    first = F.coalesce(F.get("spans", F.lit(0))["from"], F.lit(-1))
    return R.filled_rows(shapes).select("p_partkey", "y", R.covered(F.col("spans")).alias("pixels"), first.alias("first"))
