"""Boxes and sizes as column expressions. Boxes are struct<x1, y1, x2, y2> of int."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EDGES = ("x1", "y1", "x2", "y2")


def box(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.struct(*[c.cast("int").alias(n) for n, c in zip(EDGES, (x1, y1, x2, y2), strict=True)])


def valid(b: Column) -> Column:
    """Inside 0 .. 1000 with positive extent."""
    inside = F.lit(True)
    for e in EDGES:
        inside = inside & b[e].between(0, 1000)
    return inside & (b["x1"] < b["x2"]) & (b["y1"] < b["y2"])


def clamp(b: Column) -> Column:
    return box(*[F.greatest(F.lit(0), F.least(F.lit(1000), b[e])) for e in EDGES])


def normalise(v: Column) -> Column:
    """A share of the page as 0 .. 1000: clamped, multiplied and truncated in single precision."""
    f = F.greatest(F.lit(0.0).cast("float"), F.least(F.lit(1.0).cast("float"), v.cast("float")))
    return (f * F.lit(1000.0).cast("float")).cast("int")


def iou_reaches(a: Column, b: Column, limit: Column) -> Column:
    """Whether intersection over union, with pixels counted inclusively, is at least ``limit``."""
    span = lambda lo, hi: F.greatest(F.lit(0), hi - lo + 1)
    inter = span(F.greatest(a["x1"], b["x1"]), F.least(a["x2"], b["x2"])) * span(F.greatest(a["y1"], b["y1"]), F.least(a["y2"], b["y2"]))
    area = lambda r: (r["x2"] - r["x1"] + 1) * (r["y2"] - r["y1"] + 1)
    return inter >= limit * (area(a) + area(b) - inter)


def pixels(b: Column) -> Column:
    """The box's area as ``iou_reaches`` counts it."""
    return (b["x2"] - b["x1"] + 1) * (b["y2"] - b["y1"] + 1)


def extent(b: Column) -> Column:
    """The box's area as ``contained`` counts it."""
    return F.greatest(F.lit(0), b["x2"] - b["x1"]) * F.greatest(F.lit(0), b["y2"] - b["y1"])


def contained(inner: Column, outer: Column, area: Column | None = None) -> Column:
    """Whether four fifths of ``inner`` or more lie in ``outer``; edges have no width. ``area``: the inner box's extent, if at hand."""
    span = lambda lo, hi: F.greatest(F.lit(0), hi - lo)
    area = extent(inner) if area is None else area
    inter = span(F.greatest(inner["x1"], outer["x1"]), F.least(inner["x2"], outer["x2"])) * span(F.greatest(inner["y1"], outer["y1"]), F.least(inner["y2"], outer["y2"]))
    return (area > 0) & (inter * 5 >= area * 4)


def unclip(b: Column, width_ratio: Column, height_ratio: Column) -> Column:
    """Scaled about the centre, clamped, rounded down; empty boxes stay."""
    edge = lambda lo, hi, r, sign: F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1000.0), lo + (hi - lo) / 2.0 + sign * (hi - lo) * r / 2.0)))
    grown = box(
        edge(b["x1"], b["x2"], width_ratio, -1), edge(b["y1"], b["y2"], height_ratio, -1), edge(b["x1"], b["x2"], width_ratio, 1), edge(b["y1"], b["y2"], height_ratio, 1)
    )
    return F.when((b["x2"] > b["x1"]) & (b["y2"] > b["y1"]), grown).otherwise(b)


def polygon(b: Column) -> Column:
    """The box's corners, clockwise from the top left."""
    point = lambda x, y: F.struct(b[x].alias("x"), b[y].alias("y"))
    return F.array(point("x1", "y1"), point("x2", "y1"), point("x2", "y2"), point("x1", "y2"))


def crop_rect(b: Column, width: Column, height: Column) -> Column:
    """Pixel rectangle of a box, origin at the bottom left: all edges rounded down, then cut to the page."""
    px = lambda v, n: F.floor(v * n / 1000.0)
    cut = lambda v, n: F.greatest(F.lit(0), F.least(n, v))
    x1, x2 = cut(px(b["x1"], width), width), cut(px(b["x2"], width), width)
    y1, y2 = cut(px(b["y1"], height), height), cut(px(b["y2"], height), height)
    return F.struct(x1.cast("int").alias("x"), (height - y2).cast("int").alias("y"), (x2 - x1).cast("int").alias("w"), (y2 - y1).cast("int").alias("h"))


def smart_resize(height: Column, width: Column, factor: int = 28, least: int = 12544, most: int = 71372800, frames: int = 2) -> Column:
    """struct(h, w): multiples of ``factor`` near the size whose volume over ``frames`` is within least .. most."""
    height, width = F.greatest(height, F.lit(1)), F.greatest(width, F.lit(1))
    near = lambda v: F.round(v / float(factor)) * factor
    volume = frames * near(height) * near(width)
    down = F.sqrt(frames * height * width / float(most))
    up = F.sqrt(F.lit(float(least)) / (frames * height * width))
    fit = lambda v: F.when(volume > most, F.floor(v / down / float(factor)) * factor).when(volume < least, F.ceil(v * up / float(factor)) * factor).otherwise(near(v))
    side = lambda v: F.greatest(F.lit(factor), fit(v).cast("int")).cast("int")
    return F.struct(side(height).alias("h"), side(width).alias("w"))


def image_tokens(h: Column, w: Column, patch: int = 14, merge: int = 2) -> Column:
    return (F.floor(F.floor(h / patch) / merge) * F.floor(F.floor(w / patch) / merge)).cast("int")


def rendered_pixels(points: Column, dpi: int = 200) -> Column:
    """Pixels of a length in points, at least 1."""
    return F.greatest(F.ceil(points * dpi / 72.0), F.lit(1)).cast("int")


def edges_of(points: Column) -> Column:
    """array<struct<a, b>>: the sides of a polygon of array<struct<x, y>>, the last one back to the first point."""
    n = F.size(points)
    return F.transform(points, lambda p, i: F.struct(p.alias("a"), F.element_at(points, (F.pmod(i + 1, n) + 1).cast("int")).alias("b")))


def row_spans(edges: Column, y: Column, width: Column) -> Column:
    """array<struct<from, to>>: the pixels of row y whose centres lie in a polygon with the sides ``edges`` (pixels, double), by non-zero winding.

    Where edges cross the row's centre line they are sorted and folded into spans; ends are exclusive, and an
    edge that runs through a centre counts as left of it.
    """
    centre = y + F.lit(0.5)
    crossing = F.filter(edges, lambda e: (e["a"]["y"] <= centre) != (e["b"]["y"] <= centre))
    at = lambda e: e["a"]["x"] + (centre - e["a"]["y"]) * (e["b"]["x"] - e["a"]["x"]) / (e["b"]["y"] - e["a"]["y"])
    cell = lambda x: F.greatest(F.lit(0), F.least(width, F.ceil(x - 0.5))).cast("int")
    turns = F.array_sort(F.transform(crossing, lambda e: F.struct(at(e).alias("x"), F.when(e["b"]["y"] > e["a"]["y"], 1).otherwise(-1).alias("d"))))
    turns = F.transform(turns, lambda t: F.struct(cell(t["x"]).alias("here"), t["d"].alias("d")))
    none = F.array().cast("array<struct<from: int, to: int>>")

    def turned(s: Column, t: Column) -> Column:
        closes = (s["wound"] + t["d"] == 0) & (t["here"] > s["since"])
        spans = F.when(closes, F.concat(s["spans"], F.array(F.struct(s["since"].alias("from"), t["here"].alias("to"))))).otherwise(s["spans"])
        return F.struct((s["wound"] + t["d"]).alias("wound"), F.when(s["wound"] == 0, t["here"]).otherwise(s["since"]).alias("since"), spans.alias("spans"))

    start = F.struct(F.lit(0).alias("wound"), F.lit(0).alias("since"), none.alias("spans"))
    return F.aggregate(turns, start, turned, lambda s: s["spans"])
