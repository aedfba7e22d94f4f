"""Detection post-processing: validity, suppression, containment, order, geometry.

The working form is one row per detection with ``page_id`` as the only partition key, so each
operator shuffles at most once and all on the same key. Boxes are integers in 0 .. 1000.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import labels
from quire.functions.geometry import clamp, iou_reaches, unclip, valid
from quire.operators import pagearrays as P


def route_labels(det: DataFrame) -> DataFrame:
    """Adds native_label, task and kind; unknown labels are abandoned and of unknown kind."""
    spark = det.sparkSession
    named = det.join(F.broadcast(labels.dim_class(spark).select("class_id", "native_label")), "class_id", "left")
    named = named.withColumn("native_label", F.coalesce("native_label", F.concat(F.lit("class_"), F.col("class_id").cast("string"))))
    out = named.join(F.broadcast(labels.dim_label(spark)), "native_label", "left")
    return out.withColumns({"task": F.coalesce("task", F.lit("abandon")), "kind": F.coalesce("kind", F.lit("unknown"))})


def drop_invalid(det: DataFrame) -> DataFrame:
    return det.where(valid(F.col("bbox")))


def nms(det: DataFrame, same: float = 0.6, different: float = 0.98, key: str = "page_id") -> DataFrame:
    """Greedy class-aware suppression: by score (ties: input order), a box goes if a kept one overlaps it too much.

    A page's boxes are folded in one array; a page holds at most a few hundred.
    """
    row = F.struct(*[F.col(c) for c in det.columns if c != key])
    ranked = det.groupBy(key).agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("neg"), F.col("det_idx").alias("i"), row.alias("d")))).alias("all"))

    def keep(acc: Column, e: Column) -> Column:
        def beats(s: Column) -> Column:
            limit = F.when(s["d"]["class_id"] == e["d"]["class_id"], F.lit(same)).otherwise(F.lit(different))
            return iou_reaches(s["d"]["bbox"], e["d"]["bbox"], limit)

        return F.when(F.exists(acc, beats), acc).otherwise(F.concat(acc, F.array(e)))

    kept = ranked.select(key, F.explode(F.aggregate("all", F.slice("all", 1, 0), keep)).alias("k"))
    return kept.select(key, "k.d.*")


def drop_large_images(det: DataFrame, width: Column, height: Column, key: str = "page_id") -> DataFrame:
    """Drops image boxes that cover nearly all of a page, unless that would empty it or it is the only box."""
    w = Window.partitionBy(key)
    b = clamp(F.col("bbox"))
    area = (b["x2"] - b["x1"]) * (b["y2"] - b["y1"])
    # The share is compared as whole numbers: 82 or 93 hundredths of 1000 * 1000.
    limit = F.when(width > height, 820_000).otherwise(930_000)
    small = (F.col("class_id") != labels.IMAGE_CLASS) | (area <= limit)
    out = det.withColumn("_small", small).withColumns({"_n": F.count("*").over(w), "_left": F.count_if("_small").over(w)})
    return out.where((F.col("_n") <= 1) | (F.col("_left") == 0) | F.col("_small")).drop("_small", "_n", "_left")


def containment(det: DataFrame, mode: str | None = None, key: str = "page_id") -> DataFrame:
    """Drops boxes that contain others or lie in others; pages are gathered, so this is one exchange.

    mode ``large`` keeps containers, ``small`` contents, ``union`` all; None applies each class's
    own mode. All pairs are judged on the same snapshot, so two boxes that contain
    each other both go in mode large. Image, seal and chart boxes are never removed as contained.
    """
    pages = P.gathered(det, key)
    return P.spread(pages.withColumn("dets", P.uncontained(F.col("dets"), mode)), key).select(det.columns)


def reading_order(det: DataFrame, key: str = "page_id") -> DataFrame:
    """Adds ``idx``: by order_seq (null: 0), then y1, x1, y2, x2, then input order."""
    w = Window.partitionBy(key).orderBy(F.coalesce("order_seq", F.lit(0)), "bbox.y1", "bbox.x1", "bbox.y2", "bbox.x2", "det_idx")
    return det.withColumn("idx", (F.row_number().over(w) - 1).cast("int"))


def unclip_boxes(det: DataFrame, width_ratio: Column, height_ratio: Column) -> DataFrame:
    """Scales boxes about their centres."""
    return det.withColumn("bbox", unclip(F.col("bbox"), width_ratio, height_ratio))


def drop_abandoned(det: DataFrame, key: str = "page_id") -> DataFrame:
    """Drops rows of task ``abandon`` and renumbers the rest."""
    w = Window.partitionBy(key).orderBy("idx")
    return det.where(F.col("task") != "abandon").withColumn("idx", (F.row_number().over(w) - 1).cast("int"))


def postprocess(det: DataFrame, width: Column, height: Column) -> DataFrame:
    """All steps in their fixed order, with the defaults of the layout stage, on one grouping by page.

    What a page decides together is done in its array; labels, tasks and kinds are looked up in the rows
    that leave it. Adds idx, native_label, task and kind; boxes are clamped.
    """
    kept = [i for i, label in enumerate(labels.CLASSES) if label not in labels.TASKS["abandon"]]
    pages = P.gathered(drop_invalid(det).withColumns({"_w": width, "_h": height}))
    first = F.get("dets", F.lit(0))
    pages = pages.withColumns({"_w": first["_w"], "_h": first["_h"], "dets": P.suppressed(F.col("dets"))})
    pages = pages.withColumn("dets", P.uncontained(P.without_large_images(F.col("dets"), F.col("_w"), F.col("_h"))))
    # Boxes are valid here, so none goes by being clamped, and abandoned ones are known by their class.
    pages = pages.withColumn("dets", P.in_order(F.filter("dets", lambda d: d["class_id"].isin(kept))))
    # As in P.regions_of: without "outer" the steps would be written out in a filter once more.
    rows = pages.select("page_id", F.posexplode_outer("dets").alias("idx", "d")).where("idx IS NOT NULL").select("page_id", "idx", "d.*").drop("_w", "_h")
    label = labels.label_of(F.col("class_id"))
    return rows.withColumns({"bbox": clamp(F.col("bbox")), "native_label": label, "task": labels.task_of(label), "kind": labels.kind_of(label)})


def mask_tiny(det: DataFrame, mask_width: int, mask_height: int, score: str = "logit") -> DataFrame:
    """Logits of boxes not larger than one mask cell in both directions become -100, before any top-k."""
    ok = (F.col("w") > F.lit(1.0 / mask_width).cast("float")) & (F.col("h") > F.lit(1.0 / mask_height).cast("float"))
    return det.withColumn(score, F.when(ok, F.col(score)).otherwise(F.lit(-100.0).cast("float")))


def top_queries(flat: DataFrame, n: int, key: str = "page_id", score: str = "score", position: str = "flat_idx") -> DataFrame:
    """The n best (query, class) cells of a page, ties by position; one query may appear under several classes."""
    w = Window.partitionBy(key).orderBy(F.desc(score), position)
    return flat.withColumn("rank", F.row_number().over(w).cast("int")).where(F.col("rank") <= n)


def threshold_or_all(det: DataFrame, threshold: float = 0.3, key: str = "page_id") -> DataFrame:
    """Rows that reach the threshold and have a box; on pages without any, all rows that have a box."""
    box = (F.col("bbox.x2") > F.col("bbox.x1")) & (F.col("bbox.y2") > F.col("bbox.y1"))
    passes = box & (F.col("score") >= F.lit(threshold).cast("float"))
    any_ = F.max(passes).over(Window.partitionBy(key))
    return det.withColumns({"_p": passes, "_a": any_}).where(box & (F.col("_p") | ~F.col("_a"))).drop("_p", "_a")


def order_votes(pairs: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, j, vote, rank) from (key, i, j, p) with i < j: p is the probability that i comes first.

    j's vote is the sum of p over its predecessors plus of 1 - p over its successors; rank is by vote.
    """
    up = pairs.select(key, F.col("j").alias("item"), F.col("p").alias("v"))
    down = pairs.select(key, F.col("i").alias("item"), (1 - F.col("p")).alias("v"))
    votes = up.unionByName(down).groupBy(key, "item").agg(F.sum("v").alias("vote"))
    w = Window.partitionBy(key).orderBy("vote", "item")
    return votes.withColumn("rank", F.row_number().over(w).cast("int"))
