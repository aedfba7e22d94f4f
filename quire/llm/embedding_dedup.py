"""Near duplicates among embeddings by NN-descent.

Equal vectors are one node. A neighbour graph (each node's most similar nodes, by exact cosine)
starts from a few random hyperplane partitions and is refined by joining neighbours of
neighbours: around each node, the nodes listed with it are compared with each other. A node
whose list holds links only is saturated, and its list is enlarged. Rounds end when no link is
new; an audit then compares a bounded query set with all nodes of its label by brute force, and
more partitions follow while recall is low. The edges at or above the threshold stay;
components of saturated nodes are compared exactly in blocks, and links
between members of a component that the lists have no room for are counted in blocks.

Lists, blocks and groups have a fixed size. Nodes listed by very many others are split over
several blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, discard, materialize, sweep

#: Nodes that are compared with each other in one task's group.
BLOCK = 192
#: Saturated lists are enlarged up to this length; what they lack then is counted inside components.
LONGEST = 32
LINKS = "u long, v long, sim double"
#: Nodes of a component that are counted in one task's group.
COUNTED = 1024
#: Partitions that are tried until the audit is content; then the operator fails.
TRIES = 10


def unit(rows: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of equal length as unit vectors in double precision."""
    rows = rows.combine_chunks() if isinstance(rows, pa.ChunkedArray) else rows
    x = rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _best(ids: np.ndarray, sims: np.ndarray, least: np.ndarray, k: np.ndarray) -> pa.Table:
    """From a block's similarities, each node's best k others above its bound."""
    np.fill_diagonal(sims, -2)
    most = min(int(k.max()), len(ids) - 1)
    if most < 1:
        return pa.table({"u": pa.array([], pa.int64()), "v": pa.array([], pa.int64()), "sim": pa.array([], pa.float64())})
    top = np.argpartition(-sims, most - 1, axis=1)[:, :most]
    row = np.repeat(np.arange(len(ids)), most)
    col = top.ravel()
    s = sims[row, col]
    keep = (s > least[row]) & (s > -1.5)
    return pa.table({"u": ids[row[keep]], "v": ids[col[keep]], "sim": s[keep]})


def _partitions(nodes: DataFrame, sizes: DataFrame, tables: int, k: int, dim_seed: int) -> DataFrame:
    """Links inside the cells of random hyperplane partitions."""

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            bits = batch.column("bits").to_numpy()
            groups = batch.column("dim").to_numpy()
            for d in np.unique(groups):
                sub = batch.filter(pa.array(groups == d))
                x, b = unit(sub.column("vec")), bits[groups == d]
                for t in range(tables):
                    rng = np.random.default_rng([dim_seed, t, int(d)])
                    side = (x @ rng.normal(size=(int(d), 48)) > 0).astype(np.int64)
                    code = np.zeros(len(x), np.int64)
                    for j in range(48):
                        code = np.where(j < b, code * 2 + side[:, j], code)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t + 1000 * dim_seed)), sub.column("label"), sub.column("dim"), pa.array(code), sub.column("id"), sub.column("vec"), sub.column("k")], ["t", "label", "dim", "code", "id", "vec", "k"])

    kind = nodes.schema["vec"].dataType.simpleString()
    coded = nodes.join(F.broadcast(sizes), ["label", "dim"]).mapInArrow(cells, f"t long, label long, dim int, code long, id long, vec {kind}, k int")
    cell = ["t", "label", "dim", "code"]
    coded = materialize(coded, "cells")
    many = coded.groupBy(*cell).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts")).where("parts > 1")
    dealt = coded.join(many, cell, "left").withColumn("part", F.pmod(F.xxhash64("id", "t"), F.coalesce("parts", F.lit(1))))

    def pairs(t: pa.Table) -> pa.Table:
        x = unit(t.column("vec"))
        ids = t.column("id").to_numpy()
        return _best(ids, x @ x.T, np.full(len(ids), -2.0), t.column("k").to_numpy())

    out = materialize(dealt.groupBy(*cell, "part").applyInArrow(pairs, LINKS), "start")
    discard(coded)
    return out


def _top(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Each node's k best links."""
    rank = Window.partitionBy("u").orderBy(F.desc("sim"), "v")
    lists = edges.groupBy("u", "v").agg(F.max("sim").alias("sim")).join(nodes.select(F.col("id").alias("u"), "k"), "u")
    return materialize(lists.withColumn("r", F.row_number().over(rank)).where(F.col("r") <= F.col("k")).select("u", "v", "sim"), "lists")


def _refine(lists: DataFrame, nodes: DataFrame, turn: int) -> DataFrame:
    """New links among the nodes that are listed around a common node; each turn deals large neighbourhoods anew."""
    around = lists.select(F.col("v").alias("c"), "u").unionByName(lists.select(F.col("u").alias("c"), F.col("v").alias("u"))).distinct()
    around = around.unionByName(nodes.select(F.col("id").alias("c"), F.col("id").alias("u")))
    many = around.groupBy("c").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts")).where("parts > 1")
    worst = lists.groupBy("u").agg(F.min("sim").alias("least"), F.count("*").alias("n"))
    info = nodes.join(worst, nodes["id"] == worst["u"], "left").select(F.col("id").alias("u"), "vec", "k", F.when(F.col("n") >= F.col("k"), F.col("least")).otherwise(-2.0).alias("least"))
    dealt = around.join(many, "c", "left").withColumn("part", F.pmod(F.xxhash64("u", F.lit(turn)), F.coalesce("parts", F.lit(1)))).join(info, "u")

    def pairs(t: pa.Table) -> pa.Table:
        x = unit(t.column("vec"))
        return _best(t.column("u").to_numpy(), x @ x.T, t.column("least").to_numpy(), t.column("k").to_numpy())

    return dealt.select("c", "part", "u", "vec", "k", "least").groupBy("c", "part").applyInArrow(pairs, LINKS)


def _between(nodes: DataFrame, lists: DataFrame, comp: DataFrame, threshold: float) -> DataFrame:
    """Links (u, v) that connect components whose links have no room in saturated lists.

    Saturated nodes of a component are dealt to blocks. Blocks of different components of a
    label are compared exactly unless their centres are too far apart for any link, and of two
    blocks one link is enough, as links inside components are counted later.
    """
    full = lists.groupBy("u").agg(F.min("sim").alias("least"), F.count("*").alias("n")).where(F.col("least") >= threshold)
    dense = full.join(nodes.select(F.col("id").alias("u"), "k"), "u").where("n >= k").select(F.col("u").alias("id"))
    members = nodes.join(dense, "id").join(comp.toDF("id", "comp"), "id").select("label", "dim", "comp", "id", "vec")
    parts = members.groupBy("comp").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    dealt = materialize(members.join(parts, "comp").withColumn("own", F.pmod(F.xxhash64("id"), "parts").cast("int")).drop("parts"), "dense")

    def ball(t: pa.Table) -> pa.Table:
        x = unit(t.column("vec"))
        centre = x.mean(0) if np.linalg.norm(x.mean(0)) > 1e-6 else x[0]
        centre = centre / np.linalg.norm(centre)
        angle = float(np.arccos(np.clip(x @ centre, -1, 1)).max())
        return t.select(["label", "dim", "comp", "own"]).slice(0, 1).append_column("centre", pa.array([centre.tolist()], pa.list_(pa.float64()))).append_column("angle", pa.array([angle]))

    balls = materialize(dealt.groupBy("label", "dim", "comp", "own").applyInArrow(ball, "label long, dim int, comp long, own int, centre array<double>, angle double"), "balls")
    x, y = balls.toDF("label", "dim", "c1", "o1", "x", "ax"), balls.toDF("label", "dim", "c2", "o2", "y", "ay")
    dot = F.aggregate(F.zip_with("x", "y", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    apart = F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), dot))) - F.col("ax") - F.col("ay")
    near = x.join(y, ["label", "dim"]).where("c1 < c2").where(apart <= float(np.arccos(threshold)) + 1e-6).select("c1", "o1", "c2", "o2")
    near = materialize(near, "near")
    sides = near.select("*", F.explode(F.array(F.struct(F.col("c1").alias("comp"), F.col("o1").alias("own")), F.struct(F.col("c2").alias("comp"), F.col("o2").alias("own")))).alias("s")).select("c1", "o1", "c2", "o2", "s.comp", "s.own")

    def link(t: pa.Table) -> pa.Table:
        x, ids = unit(t.column("vec")), t.column("id").to_numpy()
        first = t.column("comp").to_numpy() == t.column("c1")[0].as_py()
        s = x[first] @ x[~first].T
        i, j = np.unravel_index(s.argmax(), s.shape)
        found = [0] if s[i, j] >= threshold else []
        return pa.table({"u": pa.array([ids[first][i]], pa.int64()).take(pa.array(found, pa.int64())), "v": pa.array([ids[~first][j]], pa.int64()).take(pa.array(found, pa.int64()))})

    out = materialize(sides.join(dealt.select("comp", "own", "id", "vec"), ["comp", "own"]).groupBy("c1", "o1", "c2", "o2").applyInArrow(link, "u long, v long"), "between")
    discard(dealt, balls, near)
    return out


def _audit(nodes: DataFrame, comp: DataFrame, threshold: float, queries: int, few: int, block: int = 512) -> tuple[float, float]:
    """The mean share of a query node's links, as brute force finds them, that are inside its component: of all nodes, and of those with up to ``few`` links."""
    spark = nodes.sparkSession
    chosen = nodes.orderBy(F.xxhash64("id"), "id").limit(queries).select("id", "label", "dim", "vec").toArrow()
    sums = [0.0, 0, 0.0, 0]
    for at in range(0, chosen.num_rows, block):
        shared = spark.sparkContext.broadcast(chosen.slice(at, block).to_pylist())

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            asked: dict = {}
            for q in shared.value:
                asked.setdefault((q["label"], q["dim"]), []).append(q)
            for batch in batches:
                for key, qs in asked.items():
                    sub = batch.filter(pa.array((batch.column("label").to_numpy() == key[0]) & (batch.column("dim").to_numpy() == key[1])))
                    if sub.num_rows:
                        s = unit(pa.array([q["vec"] for q in qs], sub.schema.field("vec").type)) @ unit(sub.column("vec")).T
                        i, j = np.nonzero(s >= threshold)
                        u, v = np.array([q["id"] for q in qs])[i], sub.column("id").to_numpy()[j]
                        yield pa.RecordBatch.from_arrays([pa.array(u[u != v]), pa.array(v[u != v])], ["u", "v"])

        exact = nodes.select("id", "label", "dim", "vec").mapInArrow(run, "u long, v long")
        both = exact.join(comp.toDF("u", "cu"), "u", "left").join(comp.toDF("v", "cv"), "v", "left")
        each = both.groupBy("u").agg(F.count("*").alias("n"), F.avg((F.coalesce(F.col("cu") == F.col("cv"), F.lit(False))).cast("int")).alias("share"))
        small = F.when(F.col("n") <= few, F.col("share"))
        seen = each.agg(F.coalesce(F.sum("share"), F.lit(0.0)), F.count("*"), F.coalesce(F.sum(small), F.lit(0.0)), F.count(small)).first()
        sums = [a + b for a, b in zip(sums, seen, strict=True)]
    return (sums[0] / sums[1] if sums[1] else 1.0), (sums[2] / sums[3] if sums[3] else 1.0)


def _link_counts(nodes: DataFrame, comp: DataFrame, threshold: float) -> DataFrame:
    """(id, others): for each node the rows of all linked nodes of its component.

    A component's members are dealt to blocks and blocks are compared in pairs, which yields
    counts, not links: a list that stays saturated needn't hold all its links.
    """
    members = nodes.join(comp.withColumnsRenamed({"node": "id"}), "id").select("comp", "id", "vec", "copies")
    blocks = members.groupBy("comp").agg(F.ceil(F.count("*") / COUNTED).cast("int").alias("parts"))
    dealt = members.join(blocks, "comp").withColumn("own", F.pmod(F.xxhash64("id"), "parts").cast("int"))
    pairs = dealt.select("comp", "id", "vec", "copies", "own", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    pairs = pairs.withColumns({"lo": F.least("own", "other"), "hi": F.greatest("own", "other")}).drop("other")

    def count(t: pa.Table) -> pa.Table:
        x, own = unit(t.column("vec")), t.column("own").to_numpy()
        copies = t.column("copies").to_numpy()
        lo, hi = t.column("lo")[0].as_py(), t.column("hi")[0].as_py()
        near = x @ x.T >= threshold
        near &= (own[:, None] != own[None, :]) if lo != hi else ~np.eye(len(x), dtype=bool)
        return pa.table({"id": t.column("id"), "others": pa.array((near * copies[None, :]).sum(1), pa.int64())})

    return pairs.groupBy("comp", "lo", "hi").applyInArrow(count, "id long, others long").groupBy("id").agg(F.sum("others").alias("others"))


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", k: int = 8, tables: int = 8, rounds: int = 3, audit: int = 1000, recall: float = 0.97) -> DataFrame:
    """(id_col, n_links, component_id, kept), one row per input row.

    Vectors are compared when their labels are equal and not null and their lengths are equal,
    by cosine in double precision. Vectors that are null, empty, zero, or hold null or
    non-finite components link with nothing, as do rows with a null id; each is its own
    component. Rows may repeat an id; each counts by its own vector. Only pairs at or above ``threshold`` link; ``n_links`` counts the other rows
    linked directly, equal vectors included. The audit's query set has at most ``audit`` nodes;
    further partitions follow until the recall is reached, or an error after TRIES.
    """
    spark = vectors.sparkSession
    v = F.col(vector)
    good = (F.size(v) > 0) & F.forall(v, lambda e: e.isNotNull() & (F.abs(e) < float("inf"))) & F.exists(v, lambda e: e != 0) & F.col(label).isNotNull() & F.col(id_col).isNotNull()
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.when(good, v).alias("vec"), F.col(label).cast("long").alias("label"))
    same = rows.where("vec is not null").groupBy("label", "vec").agg(F.min("id").alias("least_id"), F.count("*").alias("copies"))
    # A node is known by its label and vector, as ids may repeat.
    nodes = materialize(same.withColumn("id", F.xxhash64("label", "vec")).withColumn("dim", F.size("vec")).withColumn("k", F.lit(k)), "nodes")
    sizes = materialize(nodes.groupBy("label", "dim").agg(F.greatest(F.lit(0), F.ceil(F.log2(F.count("*") / (BLOCK / 3)))).cast("int").alias("bits")), "sizes")

    lists, done, links = None, 0, -1
    while True:
        more = _partitions(nodes, sizes, tables, k, done)
        merged = more if lists is None else lists.unionByName(more)
        new = _top(merged, nodes)
        discard(lists, more)
        lists = new
        for turn in range(rounds):
            found = lists.where(F.col("sim") >= threshold).count()
            full = lists.groupBy("u").agg(F.min("sim").alias("least"), F.count("*").alias("n")).where(F.col("least") >= threshold)
            saturated = full.join(nodes.select(F.col("id").alias("u"), "k"), "u").where(f"n >= k and k < {LONGEST}")
            grown = nodes.join(saturated.select(F.col("u").alias("id"), F.lit(2).alias("by")), "id", "left").withColumn("k", F.when(F.col("by") == 2, F.col("k") * 2).otherwise(F.col("k"))).select(*nodes.columns)
            widened = saturated.count()
            if found == links and not widened:
                break
            links = found
            if widened:
                old, nodes = nodes, materialize(grown, "nodes")
                discard(old)
            new = _top(lists.unionByName(_refine(lists, nodes, done * rounds + turn)), nodes)
            discard(lists)
            lists = new
            sweep(spark)
        near = lists.where(F.col("sim") >= threshold).select("u", "v")
        comp = materialize(components(near, "u", "v"), "components")
        between = _between(nodes, lists, comp, threshold)
        if not between.isEmpty():
            discard(comp)
            comp = materialize(components(near.unionByName(between), "u", "v"), "components")
        discard(between)
        shares = _audit(nodes, comp, threshold, audit, k)
        done += 1
        if all(share >= recall for share in shares):
            break
        if done >= TRIES:
            raise RuntimeError(f"recall of all nodes, and of those with few links, is {shares} after {done} partitions; it should be {recall}")
        discard(comp)

    linked = _link_counts(nodes, comp, threshold)
    least = comp.withColumnRenamed("node", "id").join(nodes.select("id", "least_id"), "id")
    named = (
        nodes.select("id", "label", "vec", "copies", "least_id")
        .join(linked, "id", "left")
        .join(comp.withColumnRenamed("node", "id"), "id", "left")
        .join(least.groupBy("comp").agg(F.min("least_id").alias("root")), "comp", "left")
        .select("label", "vec", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("root", "least_id").alias("component_id"))
    )
    # Rows find their node by the vector's hash first; equal hashes are told apart by the vector.
    out = rows.withColumn("h", F.xxhash64("label", "vec")).alias("r").join(named.withColumn("h", F.xxhash64("label", "vec")).alias("n"), F.expr("r.h = n.h and r.label = n.label and r.vec = n.vec"), "left")
    return out.select(F.col("r.id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "r.id").alias("component_id")).withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))


#: The rows in DuckDB, from all pairs of a label.
SQL = """
WITH RECURSIVE g AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT a.vec_id AS u, b.vec_id AS v FROM g a JOIN g b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.98::DOUBLE),
r AS (SELECT vec_id AS n, vec_id AS c FROM embeddings UNION SELECT p.v, r.c FROM r JOIN p ON p.u = r.n),
c AS (SELECT n, min(c) AS component_id FROM r GROUP BY n),
k AS (SELECT u, count(*) AS n_links FROM p GROUP BY u)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings LEFT JOIN c ON c.n = vec_id LEFT JOIN k ON k.u = vec_id
"""
