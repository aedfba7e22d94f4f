"""Inputs, arguments, freshness, page counts and signals, by literal cases."""

import json
import zlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quire import catalog
from quire.operators import prompts
from quire.operators import runs as R
from quire.operators.records import delta_text, score_text


def _one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_signals(spark):
    blocks = [{"index": 0, "status": "paired", "score": 0.4, "actual_kind": "p", "expected_kind": "h"}, {"index": 1, "score": 0.9}, {"index": 2, "status": "paired", "score": 1.0}]
    details = {
        "style": {"actual": {"center_wrappers": 2, "bold_markers": 1}, "expected": {"center_wrappers": 0, "bold_markers": 1, "heading_levels": "x"}},
        "json": {"available": True, "components": {"order": 0.99, "bbox": 0.5, "label": 0.25}},
        "tables": {"tables": [{"index": 3, "score": 0.97}, {"index": 4, "score": 0.98}, {"index": 5}]},
        "block_shape": 0.98,
        "text": {"blocks": blocks},
    }
    report = {"parity": {"available": True, "details": details}, "final_dimensions": {"text": 0.75, "style": 0.5, "order": None}, "rules": [{"status": "pass", "check_id": "a"}, {"status": "error", "check_id": "b", "check_type": "count", "message": "two"}]}
    assert _one(spark, R.signals(F.lit(json.dumps(report)))) == [
        "- lowest dimension: `style` = 0.5000",
        "- style.center_wrappers: actual=2, expected=0",
        "- json components < 0.98: label=0.2500, bbox=0.5000",
        "- tables < 0.98: #3=0.9700",
        "- text blocks: paired=2, unknown=1",
        "- lowest text pairs: (idx=0, status=paired, actual=p, expected=h, score=0.4000), (idx=1, status=None, actual=None, expected=None, score=0.9000)",
        "- rules failed: 1 (first: b / count / two)",
        "- fix_hints: Markdown style wrappers (centering/bold/fences), OCR JSON (block ordering, bbox rounding, content normalization), Markdown block segmentation (heading/list/paragraph splits), Table extraction/canonicalization, Example-specific rules/regression",
    ]


def test_signals_without_scores(spark):
    for report in ("{}", '{"parity": null}', '{"parity": {"available": false, "missing_reason": ""}}'):
        assert _one(spark, R.signals(F.lit(report))) == ["- parity: unavailable (missing parity score)"]
    assert _one(spark, R.signals(F.lit('{"parity": {"missing_reason": "no file"}}'))) == ["- parity: unavailable (no file)"]
    assert _one(spark, R.signals(F.lit('{"parity": {"available": true}}'))) == []


def test_signals_skip_single_values(spark):
    def lines(**report):
        details = report.pop("details", {})
        return _one(spark, R.signals(F.lit(json.dumps({"parity": {"available": True, "details": details}} | report))))

    assert lines(final_dimensions={"a": "x", "b": 0.5, "c": "0.1", "d": None, "e": True}) == ["- lowest dimension: `b` = 0.5000"]
    assert lines(details={"json": {"available": True, "components": {"a": "bad", "order": 0.5, "off": False}}})[0] == "- json components < 0.98: off=0.0000, order=0.5000"
    assert lines(details={"text": {"blocks": ["x", {"status": "paired", "score": "0.9"}, 3, None]}})[:2] == ["- text blocks: paired=1", "- lowest text pairs: (idx=None, status=paired, actual=None, expected=None, score=0.0000)"]
    assert lines(details={"tables": {"tables": ["x", {"index": 1, "score": 0.5}, {"index": 2, "score": "low"}]}, "block_shape": "flat"})[0] == "- tables < 0.98: #1=0.5000"
    assert lines(rules=["fail", {"status": "fail", "check_id": "a"}])[0] == "- rules failed: 1 (first: a / None / None)"
    assert lines(final_dimensions=[1], details={"json": {"available": True, "components": [1]}, "tables": 3, "text": {"blocks": "x"}}) == []


def test_exact_rounding(spark):
    values = [0.98995, 0.55555, 0.00015, 0.00025, 1 / 32, 3 / 32, -1 / 32, -0.00001, 0.0, -0.0, 0.99995, 123456.78905, -2.5, 1e-300, 7.00005, 199999999999.12345, float("nan"), float("inf"), float("-inf"), None]
    values += [k * 1e-5 + 5e-6 for k in range(-300, 300)] + [i / 2**j for i in (1, 3, 5, 77) for j in range(30)]
    t = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    got = t.select("i", score_text(F.col("v")).alias("s"), delta_text(F.col("v")).alias("d")).orderBy("i").collect()
    assert [r.s for r in got] == ["None" if v is None else f"{v:.4f}" for v in values]
    assert [r.d for r in got] == ["" if v is None else ("+" if v >= 0 else "") + f"{v:.4f}" for v in values]


def test_inputs(spark):
    rows = [("file:///a.pdf", 1, False), ("http://a", 1, False), ("file:///a", 0, None), ("file:///a", 1, None), ("file:///a", 1, True)]
    t = spark.createDataFrame(rows, "uri string, page int, d boolean")
    assert [r.p for r in t.select(R.input_problem(F.col("uri"), F.col("page"), F.col("d")).alias("p")).collect()] == [None, "invalid url", "invalid page", "not found", "directory"]


def _plain_pdf(count, prefix=b""):
    """A PDF with a plain cross-reference table."""
    objects = [b"<</Type/Catalog/Pages 2 0 R/Names<</Pages 9>>/Note (a >> \\) b)>>", b"<</Kids[]/Parent<</Count 99>>/Type/Pages/Count %d>>" % count]
    raw, at = b"%PDF-1.4\n" + prefix, []
    for i, body in enumerate(objects):
        at.append(len(raw))
        raw += b"%d 0 obj\n%s\nendobj\n" % (i + 1, body)
    table = b"xref\n0 3\n0000000000 65535 f \n" + b"".join(b"%010d 00000 n \n" % x for x in at)
    return raw + table + b"trailer <</Size 3/Root 1 0 R>>\nstartxref\n%d\n%%%%EOF\n" % len(raw)


def _packed_pdf(count, predictor):
    """A PDF whose catalog and page tree lie in an object stream, found through a cross-reference stream."""
    bodies = [b"<</Type/Catalog/Pages 2 0 R>>", b"<</Type/Pages/Count %d/Kids[]>>" % count]
    head = b"1 0 2 %d " % len(bodies[0])
    packed = zlib.compress(head + b"".join(bodies))
    raw = b"%PDF-1.5\n"
    holder = len(raw)
    raw += b"3 0 obj\n<</Type/ObjStm/N 2/First %d/Filter/FlateDecode/Length %d>>\nstream\r\n" % (len(head), len(packed)) + packed + b"\nendstream\nendobj\n"
    rows = [(0, 0, 0), (2, 3, 0), (2, 3, 1), (1, holder, 0), (1, len(raw), 0)]
    table = [a.to_bytes(1, "big") + b.to_bytes(2, "big") + c.to_bytes(1, "big") for a, b, c in rows]
    if predictor:
        table = [b"\x02" + bytes((x - y) & 255 for x, y in zip(row, above, strict=True)) for row, above in zip(table, [bytes(4), *table], strict=False)]
    data = zlib.compress(b"".join(table))
    parms = b"/DecodeParms<</Predictor 12/Columns 4>>" if predictor else b""
    start = len(raw)
    return raw + b"4 0 obj\n<</Type/XRef/Size 5/W[1 2 1]/Root 1 0 R/Filter/FlateDecode%s/Length %d>>\nstream\n" % (parms, len(data)) + data + b"\nendstream\nendobj\nstartxref\n%d\n%%%%EOF" % start


def _updated_pdf():
    """A plain PDF whose page tree was replaced by an update behind it."""
    raw = _plain_pdf(3, b"% /Type /Page /Type/Page\n")
    before = int(raw.split()[-2])
    at = len(raw)
    raw += b"2 0 obj\n<</Type/Pages/Count 5>>\nendobj\n"
    start = len(raw)
    return raw + b"xref\n2 1\n%010d 00000 n \ntrailer <</Size 3/Root 1 0 R/Prev %d>>\nstartxref\n%d\n%%%%EOF" % (at, before, start)


def test_pdf_pages(spark):
    files = [_plain_pdf(2), _packed_pdf(7, False), _packed_pdf(300, True), _updated_pdf(), b"no", None, b"%PDF-1.4 broken startxref 3", _plain_pdf(2)[:-60], b""]
    rows = spark.createDataFrame([(i, None if x is None else bytearray(x)) for i, x in enumerate(files)], "i int, c binary")
    assert [r.n for r in rows.select("i", R.pdf_pages(F.col("c")).alias("n")).orderBy("i").collect()] == [2, 7, 300, 5, None, None, None, None, None]


def test_names(spark):
    for path, ext, stem in [("a/b.PDF", "pdf", "a/b"), ("b.tar.gz", "gz", "b.tar"), ("x/.pdf", "", "x/"), ("b", "", "b"), (".pdf", "", ".pdf")]:
        assert _one(spark, R.extension(F.lit(path))) == ext
        if "/" not in path:
            assert _one(spark, R.stem(F.lit(path))) == stem


def test_incomplete(spark):
    sources = spark.createDataFrame([("a.pdf",), ("b.png",), ("._a.pdf",)], "name string")
    files = spark.createDataFrame([("a/a.md",), ("a/a.json",), ("b/b.md",)], "path string")
    assert [r.name for r in R.incomplete(sources, files).collect()] == ["b.png"]


def test_refresh(spark):
    rows = [("x", "x", True, False), ("x", "x", True, True), ("x", "y", True, False), ("", "", True, False), ("x", None, True, False), (None, None, True, False), ("x", "x", False, False)]
    t = spark.createDataFrame(rows, "now string, stored string, complete boolean, forced boolean")
    got = t.select(R.needs_refresh(*[F.col(c) for c in t.columns]).alias("r")).collect()
    assert [r.r for r in got] == [False, True, True, True, True, True, True]


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="no test data")
@pytest.mark.parametrize("name", ["text_hunks", "mask_polygons", "report_signals"])
def test_rows_of_one_file_are_dealt_out(spark, name):
    found = catalog.queries()[name](spark, "/root/testdata/sf0.001")
    assert found.select(F.spark_partition_id().alias("p")).distinct().count() > 1


def test_token_runs_in_many_parts(spark):
    rows = [(k, p, kind) for k in range(30) for p, kind in [(3, True), (5, True), (6, None), (9, None), (11, False)]]
    found = prompts.token_runs(spark.createDataFrame(rows, "k int, pos long, kind boolean"), "k", "kind")
    got = sorted((r.k, r.run, r.kind, r.first, r.n) for r in found.collect())
    assert got == [(k, *x) for k in range(30) for x in [(1, True, 3, 2), (2, None, 6, 2), (3, False, 11, 1)]]
    assert found.select(F.spark_partition_id().alias("p")).distinct().count() > spark.sparkContext.defaultParallelism
