"""Detection post-processing on a page's array of detections: after one grouping by page no step shuffles.

A detection is a struct<det_idx, class_id, score, bbox, order_seq, polygon>, a page a row with the
array of them; pages hold tens to hundreds. Pages that come as parallel arrays need no shuffle at all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import labels
from quire.functions.geometry import clamp, contained, extent, iou_reaches, pixels, polygon, unclip, valid
from quire.functions.masks import mask_polygon
from quire.functions.values import bound

POINTS = "array<struct<x: int, y: int>>"


def gathered(det: DataFrame, key: str = "page_id", name: str = "dets") -> DataFrame:
    """(key, name): a row for each page with its detections by det_idx; all other columns go along in the structs."""
    rest = [c for c in det.columns if c not in (key, "det_idx")]
    return det.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("det_idx", *rest))).alias(name))


def spread(pages: DataFrame, key: str = "page_id", name: str = "dets") -> DataFrame:
    """The opposite of ``gathered``."""
    return pages.select(key, F.inline(name))


def regions_of(pages: DataFrame, *more: Column | str, key: str = "page_id") -> DataFrame:
    """A row for each region of pages' ``regions``, with the columns ``more``.

    Not ``inline``: for that Spark adds the filter that arrays have elements and moves it below the steps that
    make them, with all of these written out in it, each as often as a later one mentions it.
    """
    return pages.select(key, F.inline_outer("regions"), *more).where("idx IS NOT NULL")


def suppressed(dets: Column, same: float = 0.6, different: float = 0.98) -> Column:
    """Greedy class-aware suppression by descending score, ties by det_idx; boxes are valid.

    Boxes whose areas differ too much can't reach the limit, so most pairs end at that comparison.
    """
    ranked = F.sort_array(F.transform(dets, lambda d: F.struct((-d["score"]).alias("s"), d["det_idx"].alias("i"), d.alias("d"), pixels(d["bbox"]).alias("n"))))

    def keep(acc: Column, e: Column) -> Column:
        limit = lambda s: F.when(s["d"]["class_id"] == e["d"]["class_id"], F.lit(same)).otherwise(F.lit(different))
        near = lambda s: F.least(s["n"], e["n"]) >= limit(s) * F.greatest(s["n"], e["n"])
        return F.when(F.exists(acc, lambda s: near(s) & iou_reaches(s["d"]["bbox"], e["d"]["bbox"], limit(s))), acc).otherwise(F.concat(acc, F.array(e)))

    return F.transform(bound(ranked, lambda a: F.aggregate(a, F.slice(a, 1, 0), keep)), lambda x: x["d"])


def without_large_images(dets: Column, width: Column, height: Column) -> Column:
    """Without image boxes that cover nearly all of the page, unless nothing would be left, there is one box only, or the page has no size."""
    limit = F.when(width > height, 820_000).otherwise(930_000)  # hundredths of 1000 * 1000

    def small(d: Column) -> Column:
        b = clamp(d["bbox"])
        return (d["class_id"] != labels.IMAGE_CLASS) | ((b["x2"] - b["x1"]) * (b["y2"] - b["y1"]) <= limit)

    sized = F.coalesce((width > 0) & (height > 0), F.lit(False))
    return bound(dets, lambda a: F.when(sized & (F.size(a) > 1), bound(F.filter(a, small), lambda s: F.when(F.size(s) > 0, s).otherwise(a))).otherwise(a))


def uncontained(dets: Column, mode: str | None = None) -> Column:
    """Without boxes that contain others or lie in others; modes as for ``detect.containment``."""
    if mode == "union":
        return dets
    kept = F.array(*[F.lit(labels.CLASSES.index(x)) for x in labels.PRESERVED])
    inside = lambda i, j, area=None: (i["det_idx"] != j["det_idx"]) & ~F.array_contains(kept, i["class_id"]) & contained(i["bbox"], j["bbox"], area)

    def stays(a: Column, d: Column) -> Column:
        within, holds = F.exists(a, lambda j: inside(d, j)), F.exists(a, lambda i: inside(i, d))
        if mode == "large":
            return ~within
        if mode == "small":
            return ~holds | within
        small = labels.SMALL_CLASS
        in_large = lambda j, area: j["class_id"].between(0, len(labels.CLASSES) - 1) & (j["class_id"] != small) & inside(d, j, area)
        holds_small = lambda i: (i["class_id"] == small) & inside(i, d) & ~((d["class_id"] == small) & within)
        return bound(extent(d["bbox"]), lambda area: ~F.exists(a, lambda x: in_large(x, area) | holds_small(x)))  # one look at each pair

    return bound(dets, lambda a: F.filter(a, lambda d: stays(a, d)))


def in_order(dets: Column) -> Column:
    """By order_seq (null: 0), then y1, x1, y2, x2, then det_idx."""
    edges = lambda b: [b[e].alias(e) for e in ("y1", "x1", "y2", "x2")]
    keyed = F.transform(dets, lambda d: F.struct(F.coalesce(d["order_seq"], F.lit(0)).alias("o"), *edges(d["bbox"]), d["det_idx"].alias("i"), d.alias("d")))
    return F.transform(F.sort_array(keyed), lambda x: x["d"])


def unclipped(dets: Column, ratios: dict[int | None, tuple[float, float]]) -> Column:
    """Boxes scaled about their centres; ratios (width, height) by class id, None for all other classes. Scaled boxes lose their polygons."""

    def scaled(d: Column) -> Column:
        pick = lambda k: F.coalesce(*[F.when(d["class_id"] == c, r[k]) for c, r in ratios.items() if c is not None], F.lit(ratios.get(None, (1.0, 1.0))[k]))
        same = (pick(0) == 1.0) & (pick(1) == 1.0)
        return F.when(same, d).otherwise(d.withField("bbox", unclip(d["bbox"], pick(0), pick(1))).withField("polygon", F.lit(None).cast(POINTS)))

    return F.transform(dets, scaled)


def emitted(dets: Column, whole: bool = False) -> Column:
    """array<struct<idx, det_idx, class_id, native_label, task, kind, score, order, bbox, polygon>>: clamped, those still valid, numbered.

    ``whole``: the boxes are known to be valid, so clamping leaves them as they are. A polygon of fewer than three points, or none, becomes the box's corners; orders below 1 are null.
    """

    def region(d: Column, i: Column) -> Column:
        points = F.transform(d["polygon"], lambda p: F.struct(*[F.greatest(F.lit(0), F.least(F.lit(1000), p[e])).alias(e) for e in ("x", "y")]))
        shape = F.when(F.size(d["polygon"]) >= 3, points).otherwise(polygon(d["bbox"]))
        return bound(labels.named(d["class_id"]), lambda n: F.struct(
            i.cast("int").alias("idx"), d["det_idx"].alias("det_idx"), d["class_id"].alias("class_id"), n["native_label"].alias("native_label"), n["task"].alias("task"), n["kind"].alias("kind"),
            d["score"].alias("score"), F.when(d["order_seq"] > 0, d["order_seq"]).alias("order"), d["bbox"].alias("bbox"), shape.alias("polygon"),
        ))

    clamped = F.transform(dets, lambda d: d.withField("bbox", clamp(d["bbox"])))
    return F.transform(dets if whole else F.filter(clamped, lambda d: valid(d["bbox"])), region)


def without_abandoned(regions: Column) -> Column:
    """Without regions of task ``abandon``; the rest is numbered anew."""
    return F.transform(F.filter(regions, lambda r: r["task"] != "abandon"), lambda r, i: r.withField("idx", i.cast("int")))


def _mask_polygons(pages: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
    """Each page's polygons by its masks, null where no mask is wanted or none is found."""
    for page in pages:
        out = []
        for p in page.itertuples(index=False):
            found = None
            if p.masks is not None and p.wanted is not None and p.width > 0 and p.height > 0:  # NaN: unknown
                found = []
                for mask, box, wanted in zip(p.masks, p.boxes, p.wanted, strict=True):
                    points = None
                    if wanted and mask is not None:
                        bits = np.frombuffer(mask["data"], np.uint8).reshape(mask["height"], mask["width"]) > 0
                        points = mask_polygon(bits, tuple(box[e] for e in ("x1", "y1", "x2", "y2")), int(p.width), int(p.height))
                    found.append(points and [{"x": x, "y": y} for x, y in points])
            out.append(found)
        yield pd.Series(out)


def regions_from_raw(raw: DataFrame, key: str = "page_id", nms: bool = True, large_images: bool = True, merge: str | None = "class", ratios: dict[int | None, tuple[float, float]] | None = None, same: float = 0.6, different: float = 0.98) -> DataFrame:
    """(key, regions, diagnostics, problem) from pages of parallel arrays: the layout stage in full.

    ``raw``: key, width and height (null: unknown), scores, labels, boxes, and if at hand order_seq,
    polygons (array of points a detection) and masks (struct<width, height, data>, a byte a pixel). Arrays are
    matched by position. Scores, labels and boxes of different lengths are a ``problem``, and such a
    page has no regions. The others are left out, with a diagnostic, where their length differs:
    orders fall back to the boxes' places, polygons and masks to the boxes' corners. Masks give
    polygons to tables, formulas, images and charts of pages without polygons and with a size.
    ``merge``: class, large, small, union or None.
    """
    has = lambda c: F.col(c) if c in raw.columns else F.lit(None)
    n = F.size("scores")
    same_size = lambda c: F.coalesce(F.size(c) == n, F.lit(False)) & c.isNotNull() if c is not None else F.lit(False)
    lost = lambda c, text: F.when(c.isNotNull() & (F.size(c) != n), text)
    order, shapes, masks = (has(c) for c in ("order_seq", "polygons", "masks"))
    order, shapes = order.cast("array<int>"), shapes.cast(f"array<{POINTS}>")
    masks = masks if "masks" in raw.columns else masks.cast("array<struct<width: int, height: int, data: binary>>")
    uneven = (F.size("labels") != n) | (F.size("boxes") != n)
    problem = F.when(uneven, F.format_string("counts differ: scores=%d, labels=%d, boxes=%d", n, F.size("labels"), F.size("boxes")))
    pages = raw.withColumns({"_problem": problem, "_order": F.when(same_size(order), order), "_shapes": F.when(same_size(shapes), shapes)})
    notes = [lost(order, "order_seq count mismatch; using fallback ordering"), lost(shapes, "polygon count mismatch; falling back to bbox polygons"), lost(masks, "mask count mismatch; falling back to bbox polygons")]
    if "masks" in raw.columns:
        derive = lambda c: labels.task_of(labels.label_of(c)).isin("table", "formula") | labels.label_of(c).isin("image", "chart")
        use = same_size(masks) & F.col("_shapes").isNull() & F.col("_problem").isNull()
        page = F.struct(F.when(use, masks).alias("masks"), F.col("boxes").alias("boxes"), F.transform("labels", derive).alias("wanted"), F.col("width").alias("width"), F.col("height").alias("height"))
        pages = pages.withColumn("_shapes", F.coalesce("_shapes", F.pandas_udf(_mask_polygons, f"array<{POINTS}>")(page)))
    det = lambda s, i: F.struct(i.alias("det_idx"), F.get("labels", i).cast("int").alias("class_id"), s.alias("score"), F.get("boxes", i).alias("bbox"), F.get("_order", i).alias("order_seq"), F.get("_shapes", i).alias("polygon"))
    dets = F.filter(F.transform("scores", det), lambda d: valid(d["bbox"]))
    dets = suppressed(dets, same, different) if nms else dets
    pages = pages.withColumn("_dets", F.when(F.col("_problem").isNull(), dets))
    kept = without_large_images(F.col("_dets"), F.col("width"), F.col("height")) if large_images else F.col("_dets")
    pages = pages.withColumn("_kept", kept)
    fewer = F.size("_dets") - F.size("_kept")
    notes += [F.when(fewer > 0, F.format_string("filter_large_image removed %d region(s)", fewer)), F.when(F.col("_order").isNull(), "order_seq missing; using (y1, x1) fallback ordering")]
    out = in_order(uncontained(F.col("_kept"), None if merge == "class" else merge) if merge else F.col("_kept"))
    out = emitted(unclipped(out, ratios)) if ratios else emitted(out, whole=True)
    return pages.select(key, F.coalesce(out, F.array().cast(out_type())).alias("regions"), F.when(F.col("_problem").isNull(), F.array_compact(F.array(*notes))).alias("diagnostics"), F.col("_problem").alias("problem"))


def out_type() -> str:
    return f"array<struct<idx: int, det_idx: int, class_id: int, native_label: string, task: string, kind: string, score: float, order: int, bbox: struct<x1: int, y1: int, x2: int, y2: int>, polygon: {POINTS}>>"
