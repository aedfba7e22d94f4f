"""Block comparison by literal cases: each page's counts, normalised contents, structure and content apart."""

import json

import pytest
from pyspark.sql import functions as F

from quire.functions import values
from quire.operators import evaluate, formatting, pages, records
from quire.sources import files

SCHEMA = "doc string, page int, pos int, index double, label string, content string, bbox array<double>"
BOX = [0.0, 0.0, 10.0, 10.0]


def block(page, pos, content="a", label="text", index=None, bbox=BOX):
    return ("d", page, pos, float(pos) if index is None else index, label, content, bbox)


def compare(spark, expected, actual, **options):
    e, a = (spark.createDataFrame(x, SCHEMA) for x in (expected, actual))
    return evaluate.compare_blocks(a, e, "doc", **options).first()


def test_equal_after_normalising(spark):
    r = compare(spark, [block(0, 0), block(0, 1, "", "image")], [block(0, 0, "a\r\n "), block(0, 1, " ", "image")])
    assert (r.status, r.structural_ok, r.content_ok, r.blocks_expected, r.blocks_actual, r.max_bbox_delta) == ("match", True, True, 2, 2, 0)


def test_each_page_counts(spark):
    r = compare(spark, [block(0, 0), block(0, 1), block(1, 0)], [block(0, 0), block(1, 0), block(1, 1)])
    assert (r.status, r.structural_ok, r.content_ok, r.blocks_expected, r.blocks_actual) == ("diff", False, True, 3, 3)


def test_content_apart_from_structure(spark):
    for e, a in [("a", ""), ("", "a"), ("a", "b")]:
        r = compare(spark, [block(0, 0, e)], [block(0, 0, a)])
        assert (r.status, r.structural_ok, r.content_ok) == ("diff", True, False)
    r = compare(spark, [block(0, 0, "x", "image")], [block(0, 0, "", "image")])
    assert (r.structural_ok, r.content_ok) == (True, False)


@pytest.mark.parametrize("other", [{"index": 0.5}, {"index": 7.0}, {"label": "table"}, {"bbox": None}, {"bbox": [0.0] * 3}, {"bbox": [0.5, 0.0, 10.0, 10.0]}, {"bbox": [16.0, 0.0, 10.0, 10.0]}])
def test_structure(spark, other):
    r = compare(spark, [block(0, 0)], [block(0, 0, **other)])
    assert (r.status, r.structural_ok, r.content_ok) == ("diff", False, True)


def test_page_counts_and_missing(spark):
    r = compare(spark, [block(0, 0), block(1, 0)], [block(0, 0)])
    assert (r.status, r.pages_expected, r.pages_actual, r.blocks_expected, r.blocks_actual) == ("diff", 2, 1, None, None)
    r = compare(spark, [block(0, 0)], [])
    assert (r.status, r.structural_ok, r.max_bbox_delta) == ("missing", None, None)
    bad = spark.createDataFrame([("d",)], "doc string")
    assert compare(spark, [block(0, 0)], [block(0, 0)], errors=bad).status == "error"


def test_details_end_the_comparison(spark):
    r = compare(spark, [block(0, i, label="a") for i in range(5)], [block(0, i, "b", label="c", bbox=[20.0, 0.0, 10.0, 10.0 + i]) for i in range(5)], details=4)
    assert (r.n_problems, len(r.details), r.max_bbox_delta) == (6, 2, 20.0)


def test_names_and_pages(spark):
    got = spark.createDataFrame([("a..b c",), ("été-1_x",)], "v string").select(values.safe_name(F.col("v")).alias("v")).collect()
    assert [r.v for r in got] == ["a__b_c", "été-1_x"]
    assert pages.parse_pages("all, ALL") is None
    with pytest.raises(pages.PagesError):
        pages.parse_pages("all,2")


def test_image_policies(spark):
    t = spark.createDataFrame([({"a": "1", "b": "2"}, {"a": "1", "b": "3"}), ({"a": "1"}, {}), ({}, {"x": "1"}), ({"a": "1"}, {"a": "1", "c": "1"})], "e map<string, string>, a map<string, string>")
    of = lambda policy: [r.s for r in t.select(evaluate.compare_images(F.col("e"), F.col("a"), policy)["status"].alias("s")).collect()]
    assert of("sha256") == ["diff", "missing", "match", "diff"]
    assert of("exists") == ["match", "missing", "match", "diff"]
    assert of("none") == ["match"] * 4


def test_combined_summary(spark):
    rows = [("parity", "a", "match", "diff", "error"), ("quality", "a", "match", "match", None), ("quality", "b", "diff", "missing", None), ("parity", "c", "missing", "match", None)]
    t = spark.createDataFrame(rows, "lane string, name string, markdown string, images string, json string")
    files = {r.name: r.content for r in evaluate.combined_summary(evaluate.combined_rows(t, "name"), "name").collect()}
    lines = ["| `a` | match | error | diff | match | match |", "| `b` | — | — | — | diff | missing |", "| `c` | missing | — | match | — | — |"]
    assert files["summary.md"] == evaluate.HEADER + "\n".join(lines) + "\n"
    assert json.loads(files["summary.json"])["examples"][:2] == [
        {"name": "a", "parity": {"markdown": "match", "json": "error", "images": "diff"}, "quality": {"markdown": "match", "images": "match"}},
        {"name": "b", "quality": {"markdown": "diff", "images": "missing"}},
    ]


def test_run_metadata_and_records(spark, tmp_path):
    t = spark.createDataFrame([("b.pdf", "succeeded"), ("a.png", "succeeded"), ("c.txt", "skipped")], "path string, outcome string")
    row = records.run_metadata(t, {"model": " m ", "revision": " ", "preset": None}).first()
    assert (row.schema_version, row.status, row.run.succeeded, row.run.failed, row.run.skipped) == (1, "ok", ["a.png", "b.pdf"], [], ["c.txt"])
    assert row.settings.asDict() == {"model": "m", "revision": None, "preset": None}
    assert records.run_metadata(t.withColumn("outcome", F.lit("failed")), {"model": ""}).first().status == "failed"
    records.write_record(records.run_metadata(t, {"model": "", "preset": "p"}), str(tmp_path / "meta"))
    back = spark.read.json(str(tmp_path / "meta")).first()
    assert (back.settings.model, back.settings.preset, back.run.succeeded) == (None, "p", ["a.png", "b.pdf"])
    records.write_markdown(spark.createDataFrame([(7, "# x\n")], "doc_id long, markdown string"), str(tmp_path / "md"))
    assert (tmp_path / "md" / "7" / "7.md").read_text() == "# x\n"


def test_json_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"x": 1, "y": {"z": [1, 2]}}')
    (tmp_path / "b.json").write_text('{"x": 1,')
    got = {r.status: r for r in files.read_json(spark, str(tmp_path), "x int, y struct<z: array<int>>").collect()}
    assert (got["ok"].x, got["ok"].y.z, got["error"].x) == (1, [1, 2], None)


def test_snapshots_and_baselines(spark):
    t = spark.createDataFrame([("m", "/c/1", "r1", 5, None), ("m", "/c/2", "r2", 9, None), ("n", "/c/3", "r3", 1, " /own "), ("o", "/c/4", "r4", 1, " "), ("o", "/c/5", "r5", 1, None)], "repo string, path string, revision string, mtime long, given string")
    got = {r.repo: (r.path, r.origin) for r in files.resolve_snapshot(t, F.col("given"), F.lit("r1")).collect()}
    assert got == {"m": ("/c/1", "reference"), "n": ("/own", "explicit"), "o": ("/c/5", "newest")}
    now = spark.createDataFrame([("a", 0.5)], "name string, score double")
    before = files.with_baseline(now, None, "name")
    assert (before.columns, before.count()) == (["name", "score"], 0)
    assert evaluate.baseline_delta(now, before, "name").first().change == "new"
    assert evaluate.baseline_delta(now, files.with_baseline(now, now.withColumn("score", F.lit(0.25)), "name"), "name").first().change == "improvement"


def test_equal_indices_keep_their_order(spark):
    box = "struct<x1: int, y1: int, x2: int, y2: int>"
    rows = [(1, 0, 3, o, label, (0, 0, 9, 9), f"text {o}") for o, label in enumerate(["text", "doc_title", "text", "abstract"])]
    t = spark.createDataFrame(rows, f"doc_id long, page_index int, idx int, offset int, native_label string, bbox {box}, content string").repartition(3)
    got = formatting.renumber(t).orderBy("idx").collect()
    assert [r.offset for r in got] == [0, 1, 2, 3]


def test_required_tensors(spark):
    shapes = {x: [3, 3] for x in files.REQUIRED} | {files.REQUIRED[0]: [32, 3, 3, 3]}
    frame = lambda d: spark.createDataFrame([(k, v) for k, v in d.items()], "name string, shape array<long>")
    problems = lambda d: {(r.problem, r.name) for r in files.check_inventory(frame(d)).collect()}
    assert problems(shapes | {"other": [0]}) == set()
    assert problems(shapes | {files.REQUIRED[0]: [3, 32, 3, 3]}) == {("stem", files.REQUIRED[0])}
    assert problems(shapes | {files.REQUIRED[1]: [], files.REQUIRED[2]: [4, 0]}) == {("shape", files.REQUIRED[1]), ("shape", files.REQUIRED[2])}
    assert problems({k: v for k, v in shapes.items() if k != files.REQUIRED[6]}) == {("missing", files.REQUIRED[6])}
