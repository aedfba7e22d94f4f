"""Queries over vectors, masks and model files, with the same rows in DuckDB where SQL can say it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import masks as M
from quire.functions import tensors as T
from quire.shipping import ship
from quire.sources import derived as S

QUERIES, SQL = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.table(spark, sf_dir, "embeddings").withColumn("v", F.col("embedding").cast("array<double>"))


_E = "e AS (SELECT vec_id, label, i, CAST(embedding[i + 1] AS DOUBLE) AS x FROM (SELECT *, unnest(range(0, 64)) AS i FROM embeddings))"


def _rounded(a):
    """Numbers are compared in whole hundred-thousandths, as text."""
    return F.array_join(F.transform(a, lambda x: F.round(x * 100000).cast("long").cast("string")), ",")


def _listed(x: str) -> str:
    return f"string_agg(CAST(CAST(round({x} * 100000) AS BIGINT) AS VARCHAR), ',' ORDER BY i)"


@query(f"WITH {_E}, s AS (SELECT *, exp(x - max(x) OVER (PARTITION BY vec_id)) AS p FROM e), t AS (SELECT vec_id, i, p / sum(p) OVER (PARTITION BY vec_id) AS q FROM s) SELECT vec_id, {_listed('q')} AS softmax FROM t GROUP BY 1")
def embed_softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vectors(spark, sf_dir).select("vec_id", _rounded(T.softmax(F.col("v"))).alias("softmax"))


@query(f"WITH {_E}, t AS (SELECT vec_id, i, x / sqrt(avg(x * x) OVER (PARTITION BY vec_id) + 0.000001::DOUBLE) AS q FROM e) SELECT vec_id, {_listed('q')} AS normed FROM t GROUP BY 1")
def embed_rmsnorm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vectors(spark, sf_dir).select("vec_id", _rounded(T.rms_norm(F.col("v"))).alias("normed"))


@query(f"WITH {_E}, a AS (SELECT l.vec_id, l.i, l.x, CASE WHEN l.i < 32 THEN -r.x ELSE r.x END AS o, (l.vec_id % 100) * pow(10000.0::DOUBLE, -2.0::DOUBLE * (l.i % 32) / 64) AS g FROM e l JOIN e r ON r.vec_id = l.vec_id AND r.i = (l.i + 32) % 64) SELECT vec_id, {_listed('(x * cos(g) + o * sin(g))')} AS turned FROM a GROUP BY 1")
def embed_rotary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vectors(spark, sf_dir).select("vec_id", _rounded(T.rotate_half(F.col("v"), F.col("vec_id") % 100)).alias("turned"))


@query(f"WITH {_E}, a AS (SELECT l.vec_id, l.i, l.x, CASE WHEN l.i % 2 = 0 THEN -r.x ELSE r.x END AS o, (CASE WHEN l.i // 2 < 8 THEN l.vec_id % 100 WHEN l.i // 2 < 20 THEN l.vec_id % 7 ELSE l.vec_id % 11 END) * pow(10000.0::DOUBLE, -2.0::DOUBLE * (l.i // 2) / 64) AS g FROM e l JOIN e r ON r.vec_id = l.vec_id AND r.i = CASE WHEN l.i % 2 = 0 THEN l.i + 1 ELSE l.i - 1 END) SELECT vec_id, {_listed('(x * cos(g) + o * sin(g))')} AS turned FROM a GROUP BY 1")
def embed_rotary_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of neighbours, turned by time, row or column: 8, 12 and 12 pairs of the 32."""
    at = F.array(*[(F.col("vec_id") % n).cast("double") for n in (100, 7, 11)])
    return _vectors(spark, sf_dir).select("vec_id", _rounded(T.rotate_pairs(F.col("v"), at, [8, 12, 12])).alias("turned"))


@query(f"WITH {_E}, b AS (SELECT l.vec_id, l.i, greatest(least(abs(l.x), 1.0::DOUBLE), 0.00001::DOUBLE) AS p, greatest(1 - least(abs(l.x), 1.0::DOUBLE), 0.00001::DOUBLE) AS q, r.x AS d FROM e l JOIN e r ON r.vec_id = l.vec_id AND r.i = l.i + 4 WHERE l.i < 4) SELECT vec_id, {_listed('1 / (1 + exp(-(ln(p / q) + d)))')} AS box FROM b GROUP BY 1")
def box_refinement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A box from each vector's first four numbers, moved by the next four."""
    box = F.transform(F.slice("v", 1, 4), lambda x: F.abs(x))
    return _vectors(spark, sf_dir).select("vec_id", _rounded(T.refine(box, F.slice("v", 5, 4))).alias("box"))


@query(f"WITH {_E}, s AS (SELECT vec_id, i, x, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, i) AS r FROM e) SELECT vec_id, CAST(min(i) FILTER (r = 1) AS INT) AS argmax, string_agg(CAST(i AS VARCHAR), ',' ORDER BY r) FILTER (r <= 5) AS top5, round(min(x), 6) AS lo, round(max(x), 6) AS hi, round(avg(x), 6) AS mean FROM s GROUP BY 1")
def tensor_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = T.summary(F.col("v"))
    v = _vectors(spark, sf_dir)
    return v.select("vec_id", T.argmax(F.col("v")).alias("argmax"), F.array_join(T.top_positions(F.col("v"), 5).cast("array<string>"), ",").alias("top5"), *[F.round(s[c], 6).alias(c) for c in ("lo", "hi", "mean")])


@query(f"WITH {_E} SELECT vec_id, {_listed('1 / (1 + exp(-x))')} AS sigmoid, {_listed('ln(greatest(greatest(0.0::DOUBLE, least(1.0::DOUBLE, x)), 0.00001::DOUBLE) / greatest(1 - greatest(0.0::DOUBLE, least(1.0::DOUBLE, x)), 0.00001::DOUBLE))')} AS logit, {_listed('(x * 0.5::DOUBLE - 0.5::DOUBLE) / 0.25::DOUBLE')} AS scaled FROM e GROUP BY 1")
def elementwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    each = lambda f: _rounded(F.transform("v", f))
    return v.select("vec_id", each(T.sigmoid).alias("sigmoid"), each(lambda x: T.inverse_sigmoid(x)).alias("logit"), each(lambda x: (x * 0.5 - 0.5) / 0.25).alias("scaled"))


_TOP = "r AS (SELECT vec_id, label, embedding, vec_id // 300 AS page, vec_id AS k FROM embeddings)"


@query(f"WITH {_TOP} SELECT a.label, a.vec_id AS i, b.vec_id AS j, round(CASE WHEN a.k >= b.k THEN -10000 ELSE list_sum(list_transform(range(1, 65), lambda n: CAST(a.embedding[n] AS DOUBLE) * CAST(b.embedding[n] AS DOUBLE))) / 8 END, 4) + 0.0::DOUBLE AS logit FROM r a JOIN r b ON a.label = b.label AND a.page = b.page")
def pair_logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order logits of the 300 queries of a page (a label's vectors are dealt to pages by id); the lower triangle is masked."""
    r = _vectors(spark, sf_dir).select("label", F.expr("vec_id div 300").alias("page"), "vec_id", "v", F.col("vec_id").alias("k"))
    a, b = r.toDF("label", "page", "i", "va", "ka"), r.toDF("label", "page", "j", "vb", "kb")
    logit = F.when(F.col("ka") >= F.col("kb"), F.lit(-10000.0)).otherwise(T.dot(F.col("va"), F.col("vb")) / 8)
    return a.join(b, ["label", "page"]).select("label", "i", "j", (F.round(logit, 4) + 0.0).alias("logit"))


@query("SELECT p_partkey, string_agg(CAST(CAST(round(v * 100000) AS BIGINT) AS VARCHAR), ',' ORDER BY o) AS encoding FROM (SELECT p_partkey, o, CASE (o // 2) % 2 WHEN 0 THEN sin(t * f) ELSE cos(t * f) END AS v FROM (SELECT p_partkey, o, CASE WHEN o < 4 THEN p_size ELSE p_partkey % 50 END AS t, CASE WHEN o % 2 = 0 THEN 1.0::DOUBLE ELSE 0.01::DOUBLE END AS f FROM (SELECT *, unnest(range(0, 8)) AS o FROM part))) GROUP BY 1")
def sincos_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.table(spark, sf_dir, "part").select("p_partkey", _rounded(T.sincos_2d(F.col("p_size"), F.col("p_partkey") % 50)).alias("encoding"))


@query("SELECT level, CAST(y AS INT) AS y, CAST(x AS INT) AS x, (x + 0.5::DOUBLE) / n AS cx, (y + 0.5::DOUBLE) / n AS cy, 0.05::DOUBLE * pow(2, level) AS size, (x + 0.5::DOUBLE) / n > 0.01::DOUBLE AND (x + 0.5::DOUBLE) / n < 0.99::DOUBLE AND (y + 0.5::DOUBLE) / n > 0.01::DOUBLE AND (y + 0.5::DOUBLE) / n < 0.99::DOUBLE AS valid FROM (SELECT level, n, y, unnest(range(0, n)) AS x FROM (SELECT level, n, unnest(range(0, n)) AS y FROM (VALUES (0, 80), (1, 40), (2, 20)) AS l(level, n)))")
def anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels = spark.createDataFrame([(0, 80), (1, 40), (2, 20)], "level int, n int")
    cell = lambda v: F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias(v)
    g = levels.select("level", "n", cell("y")).select("level", "n", "y", cell("x"))
    c = lambda v: (F.col(v) + 0.5) / F.col("n")
    inside = lambda v: (c(v) > 0.01) & (c(v) < 0.99)
    return g.select("level", "y", "x", c("x").alias("cx"), c("y").alias("cy"), (0.05 * F.pow(F.lit(2.0), "level")).alias("size"), (inside("x") & inside("y")).alias("valid"))


@query("SELECT c_custkey, c_custkey % 256 * 255 // 255 AS r, (c_custkey // 256) % 16 * 255 // 15 AS g, (c_custkey % 256 + (c_custkey // 256) % 16) * 255 // 270 AS b, (c_custkey * 1103515245 + 12345) % 2147483648 % 997 AS idx FROM customer")
def test_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A gradient image's pixels and indices of a linear congruential generator, for fixtures."""
    e = {"r": "c_custkey % 256 * 255 div 255", "g": "(c_custkey div 256) % 16 * 255 div 15", "b": "(c_custkey % 256 + (c_custkey div 256) % 16) * 255 div 270", "idx": "(c_custkey * 1103515245 + 12345) % 2147483648 % 997"}
    return S.table(spark, sf_dir, "customer").select("c_custkey", *[F.expr(v).alias(k) for k, v in e.items()])


@query("SELECT o_orderkey, array_to_string(list_sort(list_distinct(list_append(list_filter([o_custkey % 5 - 2, o_orderkey % 7 - 3], lambda x: x >= 0), 2))), ',') AS stops FROM orders")
def stop_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = S.table(spark, sf_dir, "orders")
    return o.select("o_orderkey", F.array_join(T.stop_tokens(F.array(F.expr("o_custkey % 5 - 2"), F.expr("o_orderkey % 7 - 3")), F.lit(2).cast("long")).cast("array<string>"), ",").alias("stops"))


def _mask(pixels: np.ndarray, n: int = 8) -> np.ndarray:
    return pixels[: n * n].reshape(n, n) > 0.0


@query(f"WITH {_E}, m AS (SELECT vec_id, i % 8 AS x, i // 8 AS y FROM e WHERE x > 0), s AS (SELECT vec_id FROM embeddings) SELECT s.vec_id, CAST(coalesce(min(m.x), 0) AS INT) AS x1, CAST(coalesce(min(m.y), 0) AS INT) AS y1, CAST(coalesce(max(m.x) + 1, 0) AS INT) AS x2, CAST(coalesce(max(m.y) + 1, 0) AS INT) AS y2 FROM s LEFT JOIN m ON m.vec_id = s.vec_id GROUP BY 1")
def mask_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mask of 8 by 8 from each vector's signs, and its box."""
    on = F.filter(F.transform("v", lambda x, i: F.when(x > 0, i)), lambda i: i.isNotNull())
    v = _vectors(spark, sf_dir).withColumn("on", on)
    edge = lambda f, g, d: F.coalesce(f(F.transform("on", g)) + d, F.lit(0)).cast("int")
    col, row = lambda i: i % 8, lambda i: F.floor(i / 8)
    return v.select("vec_id", edge(F.array_min, col, 0).alias("x1"), edge(F.array_min, row, 0).alias("y1"), edge(F.array_max, col, 1).alias("x2"), edge(F.array_max, row, 1).alias("y2"))


@query(None)
def mask_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polygons of the same masks on a page of 80 by 80, rows dealt out; tracing is procedural, so no SQL."""
    ship(spark)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [M.mask_polygon(_mask(np.asarray(v)), (0, 0, 1000, 1000), 80, 80) for v in b["embedding"]]
            yield pd.DataFrame({"vec_id": b["vec_id"], "polygon": [[list(p) for p in f] if f else None for f in found]})

    dealt = S.table(spark, sf_dir, "embeddings").select("vec_id", "embedding").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    return dealt.mapInPandas(run, "vec_id long, polygon array<array<int>>")


@query(None)
def bicubic_resize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector as an image of 8 by 8 bytes, resized to 20 by 12."""
    ship(spark)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [T.bicubic(np.clip(np.asarray(v) * 400 + 128, 0, 255).astype(np.uint8).reshape(8, 8), 20, 12) for v in b["embedding"]]
            yield pd.DataFrame({"vec_id": b["vec_id"], "pixels": [x.tobytes() for x in out]})

    return S.table(spark, sf_dir, "embeddings").select("vec_id", "embedding").mapInPandas(run, "vec_id long, pixels binary")


@query(None)
def attention_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One grouped-query attention and a gated perceptron over each vector as 8 tokens of 8, and a greedy decode."""
    ship(spark)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rng = np.random.default_rng(3)
        g, u, d = (rng.normal(size=(8, 8)) for _ in range(3))
        for b in batches:
            outs, tokens = [], []
            for v in b["embedding"]:
                x = np.asarray(v, float).reshape(8, 8)
                q = np.stack([x[:, :4], x[:, 4:]])
                cache = T.Cache(1, 4)
                k, w = cache.append(x[None, :, :4], x[None, :, 4:])
                y = T.gated_mlp(np.concatenate(list(T.attention(q, k, w)), 1), g, u, d)
                outs.append(y.ravel().round(6).tolist())
                tokens.append(T.greedy(lambda t, y=y: y[t % 8], 0, {7}, 6))
            yield pd.DataFrame({"vec_id": b["vec_id"], "out": outs, "tokens": tokens})

    return S.table(spark, sf_dir, "embeddings").select("vec_id", "embedding").mapInPandas(run, "vec_id long, out array<double>, tokens array<int>")
