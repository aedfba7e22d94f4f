"""Literal cases: detections, formatting, parsers, files."""

import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.functions import geometry as G
from quire.functions import masks as M
from quire.functions import tensors as T
from quire.operators import detect as D
from quire.operators import formatting as O
from quire.operators import pages as P
from quire.operators import prompts as R
from quire.sources import files

DET = "page_id long, det_idx int, class_id int, score float, bbox struct<x1: int, y1: int, x2: int, y2: int>, order_seq int"


def det(spark, *rows):
    return spark.createDataFrame([(1, i, c, s, b, o) for i, (s, c, b, o) in enumerate(rows)], DET)


def kept(df):
    return sorted(r.det_idx for r in df.collect())


@pytest.mark.parametrize(("classes", "want"), [((22, 22), [0]), ((22, 21), [0, 1])])
def test_nms(spark, classes, want):
    assert kept(D.nms(det(spark, (0.9, classes[0], (0, 0, 500, 500), 1), (0.8, classes[1], (50, 50, 550, 550), 2)))) == want


@pytest.mark.parametrize(("mode", "want"), [("large", [0]), ("small", [1]), ("union", [0, 1]), (None, [0])])
def test_containment(spark, mode, want):
    assert kept(D.containment(det(spark, (0.9, 22, (0, 0, 1000, 1000), 1), (0.8, 21, (100, 100, 200, 200), 2)), mode)) == want


def test_containment_corners(spark):
    preserved = det(spark, (0.9, 22, (0, 0, 1000, 1000), 1), (0.8, 14, (100, 100, 200, 200), 2))
    assert kept(D.containment(preserved, "large")) == [0, 1]
    mutual = det(spark, (0.9, 22, (0, 0, 500, 500), 1), (0.8, 21, (10, 10, 510, 510), 2))
    assert kept(D.containment(D.nms(mutual))) == []


def test_large_image(spark):
    one = det(spark, (0.9, 14, (0, 0, 1000, 1000), 1), (0.8, 22, (0, 0, 100, 100), 2))
    assert kept(D.drop_large_images(one, F.lit(1000), F.lit(2000))) == [1]
    both = det(spark, (0.9, 14, (0, 0, 1000, 1000), 1), (0.8, 14, (0, 0, 1000, 1000), 2))
    assert kept(D.drop_large_images(both, F.lit(1000), F.lit(2000))) == [0, 1]


def test_reading_order(spark):
    order = lambda d: [r.class_id for r in D.reading_order(d).orderBy("idx").collect()]
    boxes = [(50, 100, 60, 110), (100, 50, 110, 60), (10, 50, 20, 60)]
    assert order(det(spark, *[(0.5, c, b, o) for c, b, o in zip((22, 21, 14), boxes, (10, 1, 5), strict=True)])) == [21, 14, 22]
    assert order(det(spark, *[(0.5, c, b, None) for c, b in zip((22, 21, 14), boxes, strict=True)])) == [14, 21, 22]


def test_boxes(spark):
    one = spark.range(1)
    v = lambda *x: [r for r in one.select(*[G.normalise(F.lit(e).cast("float")) for e in x]).first()]
    assert v(0.4319999, 0.9999999, 0.211, 0.667, 0.432, 1.0, -0.5, 1.2) == [431, 999, 211, 667, 432, 1000, 0, 1000]
    b = F.struct(*[F.lit(x).alias(n) for n, x in zip(G.EDGES, (100, 100, 300, 200), strict=True)])
    assert tuple(one.select(G.unclip(b, F.lit(1.5), F.lit(2.0))).first()[0]) == (50, 50, 350, 250)
    b = F.struct(*[F.lit(x).alias(n) for n, x in zip(G.EDGES, (100, 200, 400, 700), strict=True)])
    assert tuple(one.select(G.crop_rect(b, F.lit(1000), F.lit(1000))).first()[0]) == (100, 300, 300, 500)


def page(spark, *regions):
    rows = [(1, 0, i, label, (x1, 0, 900, 50), c) for i, (label, c, x1) in enumerate((*r, 100)[:3] for r in regions)]
    df = spark.createDataFrame(rows, "doc_id long, page_index int, idx int, native_label string, bbox struct<x1: int, y1: int, x2: int, y2: int>, content string")
    return O.format_regions(df)


CASES = [
    ([("doc_title", "## Document Title"), ("paragraph_title", "- Section Title"), ("text", "Hello\nWorld")], "# Document Title\n\n## Section Title\n\nHello\n\nWorld"),
    ([("doc_title", '<div align="center">\n\n# Document Title\n\n</div>')], '<div align="center">\n\n# Document Title\n\n</div>'),
    ([("display_formula", "E = mc^2"), ("formula_number", "(1)")], "$$\nE = mc^2 \\tag{1}\n$$"),
    ([("formula_number", "(2)"), ("formula", "x")], "$$\nx \\tag{2}\n$$"),
    ([("formula_number", "(1)"), ("formula", "x"), ("formula_number", "(2)")], "$$\nx \\tag{1}\n$$"),
    ([("text", "inter-"), ("text", "national")], "international"),
    ([("text", "inter-"), ("text", "Foo-"), ("text", "national")], "international\n\nFoonational"),
    ([("text", "- a"), ("text", "b", 105), ("text", "- c", 98)], "- a\n\n- b\n\n- c"),
    ([("text", "- a"), ("text", "b", 150), ("text", "- c", 98)], "- a\n\nb\n\n- c"),
    ([("text", "e.g. x")], "e. g. x"),
    ([("text", "xx.....b____c")], "xx...b___c"),
    ([("text", "a.....b____c")], "a. ..b___c"),
    ([("text", "   "), ("image", None)], "![](page=0,bbox=[100,0,900,50])"),
    ([("algorithm", "```html\n<local-jndi-name>A</local-jndi-name>\n```")], "```xml\n\n<local-jndi-name>A</local-jndi-name>\n\n```"),
    ([("algorithm", "```html\n<html><body>hello</body></html>\n```")], "```html\n\n<html><body>hello</body></html>\n\n```"),
]


@pytest.mark.parametrize(("regions", "want"), CASES)
def test_format(spark, regions, want):
    assert O.page_markdown(page(spark, *regions)).first().markdown == want


def test_image_links(spark):
    md = "![](page=0,bbox=[57, 199, 884, 444]) and ![](page=12,bbox=[1,2,3,4]) and ![](page=1,bbox=[1,2])"
    r = O.image_refs(spark.createDataFrame([(1, 0, md)], "doc_id long, page_index int, markdown string")).first()
    assert r.n_refs == 2
    assert r.markdown == "![Image 0-0](imgs/cropped_page0_idx0.jpg) and ![Image 12-1](imgs/cropped_page12_idx1.jpg) and ![](page=1,bbox=[1,2])"


@pytest.mark.parametrize(
    ("spec", "want"), [(None, None), ("", None), ("ALL", None), ("1,2,4", [(1, 2), (4, 4)]), ("3,1,2", [(1, 3)]), ("1, [3 - 5], 9", [(1, 1), (3, 5), (9, 9)]), ("1,1,2", [(1, 2)])]
)
def test_pages(spec, want):
    assert P.parse_pages(spec) == want


@pytest.mark.parametrize("spec", ["all,1", "abc", "3-1", "0", "1,,2", "[1", "1-2-3"])
def test_pages_errors(spec):
    with pytest.raises(P.PagesError):
        P.parse_pages(spec)
    with pytest.raises(P.PagesError):
        P.resolve_pages("3", 2)


def test_fusion(spark):
    ids = [[101, 999, 102, 999, 999, 103], [999, 201, 999, 202, 203, 999]]
    t = spark.createDataFrame([(b, p, x) for b, row in enumerate(ids) for p, x in enumerate(row)], "b int, pos int, token int")
    v = spark.createDataFrame([(b, k, 10 * b + k) for b in (0, 1) for k in (1, 2, 3)], "b int, k long, row int")
    got = R.fuse(t, v, "b", 999).where("row is not null").orderBy("b", "pos").collect()
    assert [r.row for r in got] == [1, 2, 3, 11, 12, 13]
    with pytest.raises(Exception, match="differ"):
        R.fuse(t, v.where("k < 3"), "b", 999).collect()


def test_tensor_files(spark, tmp_path):
    head = json.dumps({"a.w": {"dtype": "F32", "shape": [2, 3], "data_offsets": [0, 24]}, "__metadata__": {"dtype": "x"}}).encode()
    for name in ("1.safetensors", "2.safetensors"):
        (tmp_path / name).write_bytes(struct.pack("<Q", len(head)) + head + b"\0" * 24)
    (tmp_path / "bad.safetensors").write_bytes(struct.pack("<Q", 1 << 40))
    inv = files.inventory(files.binary_files(spark, str(tmp_path), "*.safetensors"))
    assert [(r.name, r.dtype, r.shape, r.duplicate) for r in inv.collect()] == [("a.w", "F32", [2, 3], True)] * 2
    assert {(r.problem, r.name) for r in files.check_inventory(inv, ["a.w", "b"], "a.w").collect()} == {("missing", "b"), ("stem", "a.w"), ("duplicate", "a.w")}
    paths = spark.createDataFrame([("/x/a.png",), ("/x/a.pdf",), ("/x/.DS_Store",), ("/x/b.JPG",), ("/x/c.txt",)], "path string")
    assert [r.name for r in files.list_examples(paths).collect()] == ["a", "b"]
    assert files.cache_dir({"HF_HUB_CACHE": " ", "HF_HOME": "~/m"}, "/h") == "/h/m/hub"


def test_masks():
    mask = np.zeros((8, 8), bool)
    mask[1:7, 1:3] = mask[5:7, 1:7] = True
    mask[0, 7] = True
    assert M.mask_box(M.largest_component(mask)) == (1, 1, 7, 7)
    polygon = M.mask_polygon(mask, (0, 0, 1000, 1000), 80, 80)
    assert len(polygon) > 4
    assert M.arc_length([(0, 0), (2, 0), (2, 2), (0, 2)]) == 8
    assert abs(M.signed_area([(0, 0), (2, 0), (2, 2), (0, 2)])) == 4


def test_kernels():
    q, k, v = (np.random.default_rng(i).normal(size=s) for i, s in enumerate([(4, 5, 8), (2, 5, 8), (2, 5, 8)]))
    out = T.attention(q, k, v)
    assert out.shape == (4, 5, 8)
    assert np.allclose(out[:, 0], np.repeat(v, 2, 0)[:, 0])
    cache = T.Cache(2, 8)
    for t in range(5):
        a, b = cache.append(k[:, t : t + 1], v[:, t : t + 1])
    assert np.allclose(a, k)
    assert np.allclose(b, v)
    assert cache.capacity == 256
    image = np.arange(48).reshape(4, 4, 3).astype(np.uint8)
    assert (T.bicubic(image, 4, 4) == image).all()
    assert T.grid_sample(np.ones((2, 2, 1)), np.array([[0.0, 0.0], [3.0, 3.0]])).ravel().tolist() == [1.0, 0.0]


def test_stream(spark, tmp_path):
    from quire.streaming.regions import SCHEMA, format_stream

    spark.createDataFrame([(1, 0, 0, "doc_title", (0, 0, 9, 9), "T"), (1, 0, 1, "text", (0, 9, 9, 18), "x")], SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in"))
    format_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).first().markdown == "# T\n\nx"


def test_mask_rules():
    ring = M.from_top([(0, 0), (10, 0), (10, 10)])
    assert ring == [(0, 0), (10, 10), (10, 0)]
    moved = M.push_out(ring)
    assert [round(v, 2) for v in moved[0]] == [11.15, 4.62]  # along the bisector, by the mean of the sides
    assert M.push_out([(0, 0), (0, 10), (5, 10), (10, 10), (10, 0)]) == [(0, 0), (0, 10), (10, 10), (10, 0)]  # straight vertices go
    # (12, 1) is near the line through (0, 0) and (10, 0), but far from the segment.
    assert (12, 1) in M.simplify([(0, 0), (0, 30), (10, 0), (12, 1)], 1.5)
    square = np.zeros((8, 8), bool)
    square[2:6, 2:6] = True
    assert M.mask_polygon(square, (0, 0, 1000, 1000), 8, 8) == [(250, 250), (250, 625), (625, 625), (625, 250)]
    assert M.mask_polygon(square, (0, 0, 100, 100), 8, 8) is None  # no whole pixel


def test_merged_ranges_without_a_start(spark):
    rows = [(1, None, 9), (1, 1, 3), (1, 4, 5), (1, 20, None), (1, 21, 22)]
    got = P.merge_ranges(spark.createDataFrame(rows, "k int, lo int, hi int"), "k").collect()
    assert sorted((r.lo or 0, r.hi or 0) for r in got) == [(0, 9), (1, 5), (20, 0), (21, 22)]
