"""Pictures as rows: polygons filled by scan lines, crops with everything outside a polygon painted over.

A picture is (key, width, height, data): RGB, three bytes a pixel, rows from the top. All of it is
column expressions; a picture's rows are exploded and dealt out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.geometry import edges_of, row_spans

PIXEL = 3


def scaled(polygon: Column, width: Column, height: Column) -> Column:
    """A polygon in thousandths of a page as pixels."""
    return F.transform(polygon, lambda p: F.struct((p["x"] * width / F.lit(1000.0)).alias("x"), (p["y"] * height / F.lit(1000.0)).alias("y")))


def filled_rows(shapes: DataFrame, polygon: str = "polygon", width: str = "width", height: str = "height") -> DataFrame:
    """Adds ``y`` and ``spans``: a row for each pixel row of each shape, with the pixels that the polygon covers.

    Polygons of fewer than three points, or null, cover nothing. Heights below 1 give no row. Shapes are
    dealt out with their sides before they become rows.
    """
    parts = int(shapes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = shapes.where(F.col(height) > 0).repartition(parts).withColumn("_points", scaled(F.col(polygon), F.col(width), F.col(height)))
    rows = rows.withColumn("_edges", edges_of(F.col("_points")))
    rows = rows.withColumn("y", F.explode(F.sequence(F.lit(0), F.col(height).cast("int") - 1)))
    spans = F.when(F.size("_points") >= 3, row_spans(F.col("_edges"), F.col("y"), F.col(width)))
    return rows.withColumn("spans", F.coalesce(spans, F.array().cast("array<struct<from: int, to: int>>"))).drop("_points", "_edges")


def covered(spans: Column) -> Column:
    """The number of pixels in spans."""
    return F.aggregate(spans, F.lit(0), lambda n, s: n + s["to"] - s["from"])


def crop(pictures: DataFrame, key: str, bbox: str = "bbox", polygon: str = "polygon", fill: str = "FFFFFF") -> DataFrame:
    """(key, width, height, data): each picture cut to its box; pixels outside its polygon get the colour ``fill``.

    Boxes and polygons are in thousandths; edges are rounded down and cut to the picture. Without a polygon of
    three points the box alone decides. An empty or invalid box (not inside 0 .. 1000 with positive
    extent) is an error.
    """
    px = lambda v, n: F.floor(v * F.col(n) / F.lit(1000.0)).cast("int")
    b = F.col(bbox)
    inside = b["x1"].between(0, 1000) & b["y1"].between(0, 1000) & b["x2"].between(0, 1000) & b["y2"].between(0, 1000)
    edges = {"_x1": px(b["x1"], "width"), "_x2": px(b["x2"], "width"), "_y1": px(b["y1"], "height"), "_y2": px(b["y2"], "height")}
    rows = pictures.withColumns(edges)
    fine = F.coalesce(inside & (F.col("_x1") < F.col("_x2")) & (F.col("_y1") < F.col("_y2")), F.lit(False))
    rows = rows.withColumn("y", F.explode(F.when(fine, F.sequence(F.col("_y1"), F.col("_y2") - 1)).otherwise(F.raise_error(F.lit("invalid crop")).cast("array<int>"))))
    line = F.substring("data", (F.col("y") * F.col("width") + F.col("_x1")) * PIXEL + 1, (F.col("_x2") - F.col("_x1")) * PIXEL)
    points, wide = scaled(F.col(polygon), F.col("width"), F.col("height")), F.col("_x2") - F.col("_x1")
    blank = lambda n: F.unhex(F.repeat(F.lit(fill), n))

    def painted(s: Column, span: Column) -> Column:
        at, to = F.greatest(span["from"] - F.col("_x1"), F.lit(0)), F.least(span["to"] - F.col("_x1"), wide)
        row = F.concat(s["row"], blank(at - s["at"]), F.substring(F.col("_line"), at * PIXEL + 1, (to - at) * PIXEL))
        return F.when(at < to, F.struct(row.alias("row"), to.alias("at"))).otherwise(s)

    rows = rows.withColumns({"_line": line, "_spans": row_spans(edges_of(points), F.col("y"), F.col("width"))})
    start = F.struct(F.lit(b"").alias("row"), F.lit(0).alias("at"))
    cut = F.aggregate("_spans", start, painted, lambda s: F.concat(s["row"], blank(wide - s["at"])))
    rows = rows.withColumn("_row", F.when(F.size(polygon) >= 3, cut).otherwise(F.col("_line")))
    lines = F.array_sort(F.collect_list(F.struct("y", "_row")))
    return rows.groupBy(key).agg(
        F.first(wide).alias("width"),
        F.first(F.col("_y2") - F.col("_y1")).alias("height"),
        F.aggregate(lines, F.lit(b""), lambda s, r: F.concat(s, r["_row"])).alias("data"),
    )
