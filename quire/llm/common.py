"""Helpers shared by the training-data operators: scratch tables, components, prefix sums."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.shipping import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: ``spark.checkpoint.dir`` of the session.

    Only a local master without that setting (tests) gets a folder of its own.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        path = found.get() if found.isDefined() else None
    if not path:
        master = spark.sparkContext.master
        if not master.startswith("local[") and master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="quire-")
        spark.sparkContext.setCheckpointDir(path)
    return path


def materialize(df: DataFrame, label: str = "step") -> DataFrame:
    """Writes ``df`` as Parquet to the scratch folder and reads it back, which cuts the lineage."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def sweep(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished plans that nothing refers to any more."""
    for _ in range(2):  # the first round frees the plans, the second what they held
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.3)


def discard(*frames: DataFrame | None) -> None:
    """Deletes scratch tables that no later plan reads."""
    for df in frames:
        path = getattr(df, "_scratch_path", None)
        if path:
            jvm = df.sparkSession._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


class Bitmap:
    """Which 64-bit hashes may be in a table: a broadcast of fixed size that spares rows a join; the join decides."""

    BITS = 26

    def __init__(self, wanted: DataFrame, column: str):
        slot = F.shiftrightunsigned(F.col(column), 64 - self.BITS).alias("s")
        parts = wanted.select(slot).groupBy(F.expr("bitmap_bucket_number(s + 1)").alias("b")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(s + 1))").alias("m")).collect()
        bits = np.zeros((1 << self.BITS) // 8, np.uint8)
        for r in parts:
            at = (r.b - 1) * 4096
            bits[at : at + len(r.m)] = np.frombuffer(bytes(r.m), np.uint8)
        self.shared = wanted.sparkSession.sparkContext.broadcast(bits)

    def holds(self, h: np.ndarray) -> np.ndarray:
        s = (h.view(np.uint64) >> np.uint64(64 - self.BITS)).astype(np.int64)
        return (self.shared.value[s >> 3] >> (s & 7).astype(np.uint8)) & 1 == 1


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Distributed union-find over links: alternating large-star and small-star steps.

    ``edges`` has two long columns. Returns ``(node, comp)``, one row for each node that has
    an edge to another node; ``comp`` is the smallest node it reaches. Each step is a grouped
    minimum (combined map-side) and a join on the node, so neither a task nor the driver ever
    holds the neighbours of a node. Null ends and self links are ignored; repeats don't matter.
    """
    e = materialize(
        edges.where(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct(),
        "links",
    )
    state = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (
            both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        )
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low2, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("x"))
            .select("x.u", "x.v")
            .where("u <> v")
            .distinct()
        )
        nxt = materialize(small, "links")
        now = nxt.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003), F.bit_xor(F.xxhash64("u", "v"))).first()
        discard(e)
        e = nxt
        if state is None:
            state = now
            if now[0] == 0:
                break
            continue
        if now == state:
            break
        state = now
    out = e.select(F.col("u").alias("node"), F.col("v").alias("comp"))
    return out.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())


def numbered(df: DataFrame, group: str, order: list, buckets: int, name: str) -> DataFrame:
    """Adds ``name``: 0, 1, 2 ... in each ``group`` without sending a group to one task.

    ``order``'s first column is a long key spread evenly over its range of 0 .. 2**40 - 1;
    rows are numbered inside slices of it and slices are joined with their starting number.
    """
    cut = df.withColumn("_b", F.expr(f"cast({order[0]} div {2**40 // buckets} as int)"))
    w = Window.partitionBy(group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        cut.groupBy(group, "_b")
        .agg(F.count("*").alias("_n"))
        .withColumn("_from", F.coalesce(F.sum("_n").over(w), F.lit(0)))
        .drop("_n")
    )
    inner = Window.partitionBy(group, "_b").orderBy(*order)
    return (
        cut.withColumn("_r", F.row_number().over(inner) - 1)
        .join(starts, [group, "_b"])
        .withColumn(name, (F.col("_from") + F.col("_r")).cast("long"))
        .drop("_b", "_r", "_from")
    )
