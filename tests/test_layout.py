"""The layout stage from parallel arrays, polygons on pictures, page specifications and token positions, by literal cases."""

import time
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire import catalog
from quire.functions import labels
from quire.functions import masks as M
from quire.operators import pagearrays as A
from quire.operators import pages as P
from quire.operators import prompts as O
from quire.operators import raster as R

BOX = "struct<x1: int, y1: int, x2: int, y2: int>"
RAW = f"page_id int, width int, height int, scores array<float>, labels array<int>, boxes array<{BOX}>, order_seq array<int>, polygons array<array<struct<x: int, y: int>>>, masks array<struct<width: int, height: int, data: binary>>"
CORNERS = [(0, 0), (1000, 0), (1000, 1000), (0, 1000)]


def l_shape():
    mask = np.zeros((8, 8), np.uint8)
    mask[1:7, 1:3] = mask[5:7, 1:7] = 1
    return (8, 8, bytearray(mask.tobytes()))


def raw(spark, *rows):
    return spark.createDataFrame(list(rows), RAW)


def points(region):
    return [(p.x, p.y) for p in region.polygon]


def test_masks_become_polygons(spark):
    whole, mask = (0, 0, 1000, 1000), l_shape()
    t = raw(
        spark,
        (1, 80, 80, [0.9], [21], [whole], [1], None, [mask]),
        (2, 80, 80, [0.9], [22], [whole], [1], None, [mask]),  # text gets no polygon
        (3, None, None, [0.9], [21], [whole], [1], None, [mask]),  # nor does a page without size
        (4, 80, 80, [0.9], [21], [whole], [1], [[(0, 0), (9, 0), (2000, -5)]], [mask]),
        (5, 80, 80, [0.9, 0.8], [22, 21], [(0, 0, 500, 500), (500, 500, 1000, 1000)], [1, 2], None, [mask]),
    )
    got = {r.page_id: r for r in A.regions_from_raw(t, nms=False, merge=None).collect()}
    bits = np.frombuffer(mask[2], np.uint8).reshape(8, 8) > 0
    assert points(got[1].regions[0]) == M.mask_polygon(bits, whole, 80, 80)
    assert len(points(got[1].regions[0])) > 4
    assert got[1].diagnostics == []
    assert points(got[2].regions[0]) == points(got[3].regions[0]) == CORNERS
    assert points(got[4].regions[0]) == [(0, 0), (9, 0), (1000, 0)]
    assert got[5].diagnostics == ["mask count mismatch; falling back to bbox polygons"]
    assert points(got[5].regions[0]) == [(0, 0), (500, 0), (500, 500), (0, 500)]


def test_uneven_arrays(spark):
    a, b = (0, 0, 100, 100), (0, 500, 100, 600)
    t = raw(
        spark,
        (1, 80, 80, [0.9, 0.8], [22], [a, b], None, None, None),
        (2, 80, 80, [0.9, 0.8], [22, 22], [b, a], [2, 1, 3], [[(1, 1)]], None),
        (3, 80, 80, [], [], [], [], [], []),
        (4, 80, 80, [0.9, 0.8], [22, 99], [b, a], [1, 0], None, None),
    )
    got = {r.page_id: r for r in A.regions_from_raw(t).collect()}
    assert (got[1].regions, got[1].diagnostics, got[1].problem) == ([], None, "counts differ: scores=2, labels=1, boxes=2")
    assert [r.det_idx for r in got[2].regions] == [1, 0]
    assert got[2].diagnostics == ["order_seq count mismatch; using fallback ordering", "polygon count mismatch; falling back to bbox polygons", "order_seq missing; using (y1, x1) fallback ordering"]
    assert (got[3].regions, got[3].diagnostics, got[3].problem) == ([], [], None)
    assert [(r.det_idx, r.native_label, r.task, r.kind, r.order) for r in got[4].regions] == [(1, "class_99", "abandon", "unknown", None), (0, "text", "text", "text", 1)]


def test_options(spark):
    big, text = (0, 0, 1000, 960), (100, 100, 300, 200)
    t = raw(spark, (1, 80, 100, [0.9, 0.8], [14, 22], [big, text], [1, 2], [[(1, 1), (2, 2), (3, 3)]] * 2, None))
    one = lambda **o: A.regions_from_raw(t, **o).first()
    assert ([r.class_id for r in one().regions], one().diagnostics) == ([22], ["filter_large_image removed 1 region(s)"])
    assert [r.class_id for r in one(large_images=False).regions] == [14]  # the text lies in the image
    assert [r.class_id for r in one(large_images=False, merge=None).regions] == [14, 22]
    assert [r.class_id for r in one(large_images=False, merge="small").regions] == [22]
    scaled = one(merge=None, ratios={None: (2.0, 1.0)}).regions[0]
    assert (tuple(scaled.bbox), points(scaled)) == ((0, 100, 400, 200), [(0, 100), (400, 100), (400, 200), (0, 200)])
    assert points(one(merge=None, ratios={14: (2.0, 1.0)}).regions[0]) == [(1, 1), (2, 2), (3, 3)]


def test_polygon_crop(spark):
    red, white = b"\xff\x00\x00", b"\xff\xff\xff"
    half = [(0, 0), (500, 0), (500, 1000), (0, 1000)]
    rows = [(1, 20, 10, bytearray(red * 200), (0, 0, 1000, 1000), half), (2, 20, 10, bytearray(red * 200), (250, 0, 1000, 500), half), (3, 20, 10, bytearray(red * 200), (0, 0, 500, 1000), None)]
    schema = f"id int, width int, height int, data binary, bbox {BOX}, polygon array<struct<x: int, y: int>>"
    got = {r.id: r for r in R.crop(spark.createDataFrame(rows, schema), "id").collect()}
    assert bytes(got[1].data) == (red * 10 + white * 10) * 10
    assert (got[2].width, got[2].height, bytes(got[2].data)) == (15, 5, (red * 5 + white * 10) * 5)
    assert (got[3].width, bytes(got[3].data)) == (10, red * 100)
    for box in [(500, 0, 500, 10), (0, 0, 10, 1001), None]:
        with pytest.raises(Exception, match="invalid crop"):
            R.crop(spark.createDataFrame([(1, 20, 10, bytearray(600), box, None)], schema), "id").collect()


def test_filled_rows_by_points(spark):
    r = np.random.default_rng(5)
    shapes = [[tuple(int(v) for v in p) for p in r.integers(0, 1001, (int(r.integers(0, 8)), 2))] for _ in range(60)]
    t = spark.createDataFrame([(i, s, 17, 13) for i, s in enumerate(shapes)], "id int, polygon array<struct<x: int, y: int>>, width int, height int")

    def inside(s, x, y):
        wound, pts = 0, [(px * 17 / 1000, py * 13 / 1000) for px, py in s]
        for (ax, ay), (bx, by) in zip(pts, pts[1:] + pts[:1], strict=True):
            if (ay <= y) != (by <= y) and ax + (y - ay) * (bx - ax) / (by - ay) <= x:
                wound += 1 if by > ay else -1
        return wound != 0

    got = R.filled_rows(t).collect()
    assert len(got) == 60 * 13
    for row in got:
        s = shapes[row.id]
        want = {x for x in range(17) if len(s) > 2 and inside(s, x + 0.5, row.y + 0.5)}
        assert {x for span in row.spans for x in range(span["from"], span["to"])} == want


@pytest.mark.parametrize(
    ("spec", "ranges", "error"),
    [
        (None, None, None), ("", None, None), ("   ", None, None), ("all", None, None), ("ALL", None, None), (" All ", None, None), ("1", [(1, 1)], None), ("1-3", [(1, 3)], None), ("[1-3]", [(1, 3)], None), (" [ 1 - 3 ] ", [(1, 3)], None),
        ("1,2,4", [(1, 2), (4, 4)], None), ("3,1,2", [(1, 3)], None), ("1, [3-5], 9", [(1, 1), (3, 5), (9, 9)], None), ("1, [3 - 5], 9", [(1, 1), (3, 5), (9, 9)], None), ("1,1,2", [(1, 2)], None), ("all,all", None, None),
        ("all,1", None, "cannot mix 'all' with explicit page selections"), ("1,all", None, "cannot mix 'all' with explicit page selections"), ("abc", None, "could not parse token 'abc'"), ("3-1", None, "range start must be <= end (got 3-1)"),
        ("0", None, "page must be >= 1 (got 0)"), ("1,,2", None, "empty token"), ("[1", None, "invalid brackets in token '[1'"), ("[", None, "invalid brackets in token '['"), ("1-2-3", None, "could not parse token '1-2-3'"), ("-1", None, "could not parse token '-1'"),
        ("all,x", None, "could not parse token 'x'"), ("2,0-1", None, "page must be >= 1 (got 0)"), ("5-9,1-20,30", [(1, 20), (30, 30)], None), ("9223372036854775808", None, "could not parse token '9223372036854775808'"),
    ],
)
def test_page_specs(spark, spec, ranges, error):
    t = spark.createDataFrame([(spec,)], "s string").withColumn("r", P.read_specs(F.col("s"))).first().r
    assert (t["ranges"] and [(x.lo, x.hi) for x in t["ranges"]], t["error"], t["all"]) == (ranges, error, ranges is None and error is None)


def test_resolved_specs(spark):
    t = spark.createDataFrame([("all", 3), ("2-3", 3), ("3", 2), ("1", 0), ("x", 0), ("1-2,4", 9)], "s string, n int")
    got = t.select(P.resolve_specs(P.read_specs(F.col("s")), F.col("n")).alias("p")).collect()
    assert [(r.p.pages, r.p.error) for r in got] == [([1, 2, 3], None), ([2, 3], None), (None, "page 3 is out of range (pageCount=2)"), (None, "invalid PDF page count 0"), (None, "could not parse token 'x'"), ([1, 2, 4], None)]


def positions(spark, tokens, grid, **options):
    t = spark.createDataFrame([(1, i, x, *grid) for i, x in enumerate(tokens)], "b int, pos int, token int, grid_t int, grid_h int, grid_w int")
    rows = O.rope_positions(t, "b", 9, video_start=7, video_end=8, **options).orderBy("pos").collect()
    return rows[0].problem or [(r.p_t, r.p_h, r.p_w) for r in rows], rows[0].delta


def test_positions(spark):
    assert positions(spark, [1, 9, 9, 9, 9, 2], (1, 4, 4)) == ([(0, 0, 0), (1, 1, 1), (1, 1, 2), (1, 2, 1), (1, 2, 2), (3, 3, 3)], -2)
    assert positions(spark, [9, 9, 2], (2, 2, 3)) == ([(0, 0, 0), (1, 0, 0), (2, 2, 2)], 0)  # two times, one cell
    assert positions(spark, [1, 2, 3], (1, 4, 4)) == ([(0, 0, 0), (1, 1, 1), (2, 2, 2)], 0)
    assert positions(spark, [1, 9, 9, 9, 2], (1, 4, 4)) == ("image tokens differ: expected 4, found 3", None)
    assert positions(spark, [9, 1, 9], (1, 2, 2)) == ("more than one image", None)
    assert positions(spark, [9, 1, 9], (1, 4, 2)) == ("image tokens differ: expected 2, found 1", None)
    assert positions(spark, [7, 9, 8, 9], (1, 2, 2)) == ("video isn't supported", None)
    assert positions(spark, [7, 8, 9], (1, 2, 2)) == ([(0, 0, 0), (1, 1, 1), (2, 2, 2)], 0)
    assert positions(spark, [1, 9], (None, 2, 2)) == ("no image grid", None)
    with pytest.raises(Exception, match="more than one image"):
        positions(spark, [9, 1, 9], (1, 2, 2), strict=True)


def test_flat_corners_go_every_other_one():
    assert M._merged([(0, 0), (5, 1), (10, 2), (16, 3), (20, 10), (0, 10)], 1.0) == [(0, 0), (10, 2), (16, 3), (20, 10), (0, 10)]
    assert M._merged([(0, 0), (10, 0), (20, 0), (20, 20)], 1.0) == [(0, 0), (10, 0), (20, 0), (20, 20)]  # level neighbours stay
    assert M._merged([(10, 2), (15, 3), (20, 10), (0, 10), (0, 0), (5, 1)], 1.0) == [(15, 3), (20, 10), (0, 10), (0, 0)]  # the last corner looks past the first, which is gone
    assert M._merged([(0, 0), (1, 1)], 5.0) == [(0, 0), (1, 1)]


def test_components_against_growing_one_pixel_at_a_time():
    r = np.random.default_rng(2)
    for _ in range(300):
        mask = r.random(r.integers(1, 12, 2)) < r.choice([0.1, 0.4, 0.6, 1.0])
        left, best = set(zip(*np.nonzero(mask), strict=True)), set()
        for start in sorted(left):
            own, todo = set(), [start] if start in left else []
            while todo:
                y, x = todo.pop()
                if (y, x) in left:
                    left.discard((y, x))
                    own.add((y, x))
                    todo += [(y + i, x + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
            best = own if len(own) > len(best) else best
        assert set(zip(*np.nonzero(M.largest_component(mask)), strict=True)) == best


def test_mask_polygons_take_little_time():
    r = np.random.default_rng(3)
    masks = [r.standard_normal((8, 8)) > 0 for _ in range(60)]
    begin = time.process_time()
    assert all(M.mask_polygon(m, (0, 0, 1000, 1000), 80, 80) for m in masks)
    assert time.process_time() - begin < 60 * 0.02


def test_shapes_of_one_part_are_dealt_out(spark):
    points = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in [(0, 0), (1000, 0), (1000, 1000)]])
    shapes = spark.range(0, 40, 1, 1).select("id", points.alias("polygon"), F.lit(4).alias("width"), F.lit(4).alias("height"))
    rows = R.filled_rows(shapes).withColumn("part", F.spark_partition_id()).collect()
    assert len({r.part for r in rows}) > 1
    assert len(rows) == 160


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="no test data")
@pytest.mark.parametrize("name", ["raw_regions", "layout_postprocess"])
def test_a_page_is_folded_once(spark, name):
    """The plan holds suppression's fold once; a filter on the rows of a generator had repeated all steps of the page."""
    plan = catalog.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("aggregate(") == 1


def test_pages_without_regions_have_no_rows(spark):
    regions = "array<struct<idx: int, det_idx: int>>"
    t = spark.createDataFrame([(1, [(0, 4), (1, 2)]), (2, []), (3, None)], f"page_id long, regions {regions}")
    assert [tuple(r) for r in A.regions_of(t).orderBy("idx").collect()] == [(1, 0, 4), (1, 1, 2)]


def test_labels_by_one_look(spark):
    label = labels.label_of(F.col("c"))
    t = spark.createDataFrame([(i,) for i in (None, -1, *range(27))], "c int").select(labels.named(F.col("c")).alias("n"), F.struct(label, labels.task_of(label), labels.kind_of(label)).alias("m"))
    assert all(tuple(r.n) == tuple(r.m) for r in t.collect())
