"""Sharding by a k-d tree over document metadata.

Points are groups of equal texts, weighted by their bytes; a group that outweighs a twentieth
of a shard is dealt to several points by the hash of id and row, so that a hot text can't unbalance
the shards. The dimensions are the text's length, its crc32, the group's source and language.
The node that holds all points is split at the weighted median along its widest dimension, and
so on, until each leaf holds one shard's share of the bytes.

Medians are found by distributed histograms of the weights over a dimension's key, refined
until the cut is exact to a point or to a small part of a shard. All nodes of a level share
their jobs; the driver sees histograms of fixed size for each node, never points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, numbered

#: Bins of a histogram; bits of a dimension's value and of the hash that breaks its ties.
BINS = 256
VALUE_BITS, TIE_BITS = 20, 40
DIMENSIONS = ("bytes", "crc", "source", "lang")


def _points(docs: DataFrame, id_col: str, text: str, shards: int, source: str | None, lang: str | None) -> tuple[DataFrame, DataFrame]:
    """(rows with their point's id, points with weight and dimension keys)."""
    t = F.coalesce(F.col(text), F.lit(""))
    part = lambda c: F.xxhash64(F.col(c).cast("string")) if c in docs.columns else F.lit(0)
    rows = docs.select(
        F.col(id_col).alias("id"),
        (F.octet_length(t) + 1).cast("long").alias("size"),
        F.crc32(t.cast("binary")).alias("crc"),
        F.xxhash64(t).alias("h"),
        part(source).alias("source"),
        part(lang).alias("lang"),
        F.monotonically_increasing_id().alias("salt"),  # written once; spreads rows that repeat an id or have none
    )
    rows = materialize(rows, "rows")
    total = rows.agg(F.sum("size")).first()[0] or 0
    # A text's weight decides how many points it is; the same rule for every text.
    step = max(1.0, total / shards / 20)
    groups = rows.groupBy("h", "crc", "size").agg(F.min("source").alias("source"), F.min("lang").alias("lang"), F.count("*").alias("copies"))
    groups = materialize(groups.withColumn("pieces", F.ceil(F.col("copies") * F.col("size") / step).cast("int")), "texts")
    hot = groups.where("pieces > 1").select("h", "crc", "size", "pieces")  # at most 20 * shards texts
    rows = rows.join(F.broadcast(hot), ["h", "crc", "size"], "left").withColumn("piece", F.pmod(F.xxhash64("id", "salt"), F.coalesce("pieces", F.lit(1))))
    point = F.xxhash64("h", "crc", "size", "piece")
    rows = rows.withColumn("point", point)
    split = rows.where("pieces > 1").groupBy("h", "crc", "size", "piece").agg(F.sum("size").alias("weight")).join(F.broadcast(groups.where("pieces > 1").drop("pieces", "copies")), ["h", "crc", "size"])
    whole = groups.where("pieces = 1").select("h", "crc", "size", F.lit(0).cast("long").alias("piece"), (F.col("copies") * F.col("size")).alias("weight"), "source", "lang")
    points = whole.unionByName(split.withColumn("piece", F.col("piece").cast("long"))).withColumn("point", point)

    def key(value: Column) -> Column:
        tie = F.pmod(F.col("point"), F.lit(1 << TIE_BITS))
        return F.least(F.greatest(value, F.lit(0)), F.lit((1 << VALUE_BITS) - 1)).cast("long") * (1 << TIE_BITS) + tie

    scale = float(1 << VALUE_BITS)
    points = points.select(
        "point",
        "weight",
        key(F.log2("size") / 40 * scale).alias("bytes"),
        key(F.col("crc") / 2.0**32 * scale / 64).alias("crc"),  # a narrow dimension: it only serves where the others can't
        key(F.pmod("source", F.lit(1 << VALUE_BITS))).alias("source"),
        key(F.pmod("lang", F.lit(1 << VALUE_BITS))).alias("lang"),
    )
    return rows.select("id", "size", "crc", "point", "salt"), materialize(points, "points")


def _split(points: DataFrame, nodes: dict[int, tuple[int, int]], total: int, shards: int) -> dict[int, tuple[str, int]]:
    """For each open node (its shards from..to), the dimension and the key at which its weights divide in proportion."""
    spark = points.sparkSession
    ext = points.groupBy("node").agg(F.sum("weight").alias("w"), *[f(d).alias(f"{n}_{d}") for d in DIMENSIONS for n, f in (("lo", F.min), ("hi", F.max))])
    open_, cuts = {}, {}
    for r in ext.where(F.col("node").isin(list(nodes))).collect():
        dim = max(DIMENSIONS, key=lambda d: (r[f"hi_{d}"] >> TIE_BITS) - (r[f"lo_{d}"] >> TIE_BITS))
        lo, hi = nodes[r.node]
        open_[r.node] = [dim, r[f"lo_{dim}"], r[f"hi_{dim}"], 0, r.w * ((hi - lo) // 2) / (hi - lo)]
    close = total / shards / 200
    while open_:
        plan = spark.createDataFrame([(n, d, lo, max(1, -(-(hi - lo + 1) // BINS))) for n, (d, lo, hi, _, _) in open_.items()], "node int, dim string, lo long, step long")
        value = F.coalesce(*[F.when(F.col("dim") == d, F.col(d)) for d in DIMENSIONS])
        bins = points.join(F.broadcast(plan), "node").withColumn("bin", F.expr("({}) div step".format("case " + " ".join(f"when dim = '{d}' then {d} - lo" for d in DIMENSIONS) + " end")))
        bins = bins.where((F.col("bin") >= 0) & (F.col("bin") < BINS)).groupBy("node", "bin").agg(F.sum("weight").alias("w"), F.min(value).alias("a"), F.max(value).alias("b")).collect()
        for n in list(open_):
            dim, lo, hi, before, want = open_[n]
            own = sorted((r.bin, r.w, r.a, r.b) for r in bins if r.node == n)
            for _, w, a, b in own:
                if before + w >= want:
                    break
                before += w
            if a == b or w <= close:
                # The cut goes behind or before the bin, whichever is nearer.
                cuts[n] = (dim, b + 1 if before + w - want <= want - before else a)
                del open_[n]
            else:
                open_[n] = [dim, a, b, before, want]
    return cuts


def shards_of(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text: str = "text", source: str | None = "source", lang: str | None = "lang") -> DataFrame:
    """(id, size, text_crc32, shard, slot), one row per input row.

    size: bytes of the text in UTF-8 (null: none) plus 1; the shards' sizes are near equal.
    Equal texts go together unless they outweigh a twentieth of a shard. slot counts from 0
    without gaps in each shard, by hash order. Null ids and repeated rows are rows like others.
    Fewer points than shards leave shards empty; an empty table gives an empty result.
    """
    rows, points = _points(docs, id_col, text, shards, source, lang)
    total = points.agg(F.sum("weight")).first()[0]
    node = F.lit(0)
    nodes, leaves, tree = {0: (0, shards)}, {}, []
    while total and (level := {n: x for n, x in nodes.items() if x[1] - x[0] > 1}):
        cuts = _split(points.withColumn("node", node), level, total, shards)
        for n, (dim, at) in cuts.items():
            lo, hi = nodes.pop(n)
            left, right = 2 * n + 1, 2 * n + 2
            nodes[left], nodes[right] = (lo, lo + (hi - lo) // 2), (lo + (hi - lo) // 2, hi)
            tree.append((n, dim, at))
        for n in set(level) - set(cuts):  # no point in it
            leaves[n] = nodes.pop(n)
        node = F.lit(0)
        for n, dim, at in tree:
            node = F.when(node == n, F.when(F.col(dim) < at, 2 * n + 1).otherwise(2 * n + 2)).otherwise(node)
    shard = F.lit(0)
    for n, (lo, _) in nodes.items():
        shard = F.when(F.col("node") == n, lo).otherwise(shard)
    placed = points.withColumn("node", node).select("point", shard.alias("shard"))
    out = rows.join(placed.withColumnsRenamed({"point": "at"}), F.col("point") == F.col("at")).drop("at")
    out = out.withColumn("_k", F.shiftrightunsigned(F.xxhash64("id", "point", "salt"), 24))
    out = numbered(materialize(out, "placed"), "shard", ["_k", "id", "point", "salt"], 64, "slot")
    discard(points)
    return out.select("id", "size", F.col("crc").alias("text_crc32"), "shard", "slot")


def shard_report(docs: DataFrame, shards: int = 8) -> DataFrame:
    out = shards_of(docs, shards)
    return out.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))
