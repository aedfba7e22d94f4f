"""Parity and quality evaluation: comparisons, rollups and deltas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text
from quire.operators.records import delta_text
from quire.operators.scoring import compare_texts

# Fixed value: the head of the table over both lanes.
HEADER = "| Example | Parity MD | Parity JSON | Parity Images | Quality MD | Quality Images |\n|---|---:|---:|---:|---:|---:|\n"


def compare_blocks(actual: DataFrame, expected: DataFrame, key: str, tolerance: int = 15, details: int = 20, errors: DataFrame | None = None) -> DataFrame:
    """One row per document of (key, page, pos, index, label, content, bbox array) on both sides; pages count from 0.

    Blocks are matched by position within a page, on the pages that both sides have. Structure:
    page counts, each page's block count, indices, labels, and coordinates (whole, at most
    ``tolerance`` apart). Content: normalised texts are equal and not empty, those of images empty.
    Comparing ends when ``details`` problems are found, as do the block totals, which are null where
    page counts differ. status is match, diff, missing (one side has no rows; the rest is null)
    or, for the keys in ``errors``, error.
    """
    at = [key, "page", "pos"]
    a = actual.select(*at, F.struct("index", "label", "content", "bbox").alias("a"))
    e = expected.select(*at, F.struct("index", "label", "content", "bbox").alias("e"))
    doc, page = Window.partitionBy(key), Window.partitionBy(key, "page")
    last = lambda side: F.max(F.when(F.col(side).isNotNull(), F.col("page") + 1)).over(doc)
    rows = a.join(e, at, "full").withColumns({"pages_actual": last("a"), "pages_expected": last("e")})
    whole = lambda v: (v.isNotNull() & (v == F.floor(v)))
    valid = F.coalesce((F.size("a.bbox") == 4) & (F.size("e.bbox") == 4), F.lit(False))
    deltas = F.zip_with("a.bbox", "e.bbox", lambda x, y: F.when(whole(x) & whole(y), F.abs(x - y)))
    x, y = (text.normalise(F.coalesce(F.col(f"{side}.content"), F.lit(""))) for side in "ae")
    bad = lambda test, name: F.when(test, F.array(F.lit(name))).otherwise(F.array().cast("array<string>"))
    coordinates = F.transform(F.filter(deltas, lambda d: d.isNull() | (d > tolerance)), lambda d: F.when(d.isNull(), "coordinate").otherwise("bbox"))
    structure = F.concat(
        bad(~F.coalesce((F.col("a.index") == F.col("e.index")) & whole(F.col("a.index")), F.lit(False)), "index"),
        bad(~F.col("a.label").eqNullSafe(F.col("e.label")), "label"),
        F.when(valid, coordinates).otherwise(F.array(F.lit("no bbox"))),
    )
    image = F.col("e.label").eqNullSafe("image")
    content = F.when(image, bad((text.trim(x) != "") | (text.trim(y) != ""), "image not empty")).otherwise(F.when((x == "") | (y == ""), F.array(F.lit("empty"))).otherwise(bad(x != y, "content")))
    matched = F.col("a").isNotNull() & F.col("e").isNotNull()
    none = F.array().cast("array<string>")
    shared = F.col("page") < F.least("pages_actual", "pages_expected")
    rows = rows.withColumns({"structure": F.when(matched, structure).otherwise(none), "content": F.when(matched, content).otherwise(none), "delta": F.when(matched & valid, F.array_max(deltas)), "n_a": F.count("a").over(page), "n_e": F.count("e").over(page), "first": F.col("pos") == F.min("pos").over(page)})
    rows = rows.withColumn("uneven", (shared & F.col("first") & (F.col("n_a") != F.col("n_e"))).cast("int"))
    paged = (F.col("pages_actual") != F.col("pages_expected")).cast("int")
    earlier = F.sum(F.when(shared, F.col("uneven") + F.size("structure") + F.size("content"))).over(doc.orderBy("page", "pos").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("before", paged + F.coalesce(earlier, F.lit(0)))
    rows = rows.withColumn("paged", shared & (F.first("before").over(page.orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)) < details))
    begun = F.sum("uneven").over(page)
    compared = F.col("paged") & (F.col("before") + F.when(F.col("first"), F.col("uneven")).otherwise(0) < details)
    rows = rows.withColumns({"begun": begun, "compared": compared})
    count = lambda c: F.sum(F.when(F.col("compared"), F.size(c)).otherwise(0))
    out = rows.groupBy(key).agg(
        F.first("pages_actual").alias("pages_actual"),
        F.first("pages_expected").alias("pages_expected"),
        F.count(F.when(F.col("paged"), F.col("a"))).alias("blocks_actual"),
        F.count(F.when(F.col("paged"), F.col("e"))).alias("blocks_expected"),
        F.coalesce(F.max(F.when(F.col("compared"), F.col("delta"))), F.lit(0)).alias("max_bbox_delta"),
        (F.sum(F.when(F.col("paged"), F.col("uneven")).otherwise(0)) + F.max(paged)).alias("_pages"),
        count("structure").alias("_structure"),
        count("content").alias("_content"),
        F.slice(F.array_sort(F.collect_list(F.when(F.col("compared") & (F.size("structure") + F.size("content") > 0), F.struct("page", "pos", F.concat("structure", "content").alias("problems"))))), 1, details).alias("details"),
    )
    wrong = errors.select(key, F.lit(True).alias("_error")) if errors is not None else None
    out = out.join(wrong, key, "full") if wrong is not None else out.withColumn("_error", F.lit(None).cast("boolean"))
    both = F.col("pages_actual").isNotNull() & F.col("pages_expected").isNotNull() & F.col("_error").isNull()
    total = both & (F.col("pages_actual") == F.col("pages_expected"))
    fine, same = F.col("_pages") + F.col("_structure") == 0, F.col("_content") == 0
    status = F.when(F.col("_error"), "error").when(~both, "missing").when(fine & same, "match").otherwise("diff")
    return out.select(
        key,
        status.alias("status"),
        F.when(both, fine).alias("structural_ok"),
        F.when(both, same).alias("content_ok"),
        *[F.when(both, F.col(c)).alias(c) for c in ("max_bbox_delta", "pages_expected", "pages_actual")],
        *[F.when(total, F.col(c)).alias(c) for c in ("blocks_expected", "blocks_actual")],
        F.when(both, F.col("_pages") + F.col("_structure") + F.col("_content")).alias("n_problems"),
        F.when(both, F.col("details")).alias("details"),
    )


def compare_markdown(actual: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """(key, status, similarity) of the documents expected: match, diff or missing, by normalised texts; see ``scoring.compare_texts``."""
    both = expected.select(key, F.col("markdown").alias("expected")).join(actual.select(key, F.col("markdown").alias("actual")), key, "left")
    return compare_texts(both).select(key, "status", "similarity")


def compare_images(expected: Column, actual: Column, policy: str = "sha256") -> Column:
    """struct(status, missing, extra, mismatch) of map<name, hash>; missing beats diff, nothing expected is a match.

    policy: ``none`` looks at nothing, ``exists`` at names, ``sha256`` at hashes too.
    """
    names = lambda m: F.array_sort(F.map_keys(m))
    empty = F.array().cast("array<string>")
    if policy == "none":
        return F.struct(F.lit("match").alias("status"), *[empty.alias(c) for c in ("missing", "extra", "mismatch")])
    missing, extra = F.array_except(names(expected), names(actual)), F.array_except(names(actual), names(expected))
    mismatch = F.filter(F.array_intersect(names(expected), names(actual)), lambda n: F.try_element_at(expected, n) != F.try_element_at(actual, n)) if policy == "sha256" else empty
    status = F.when(F.size(names(expected)) == 0, "match").when(F.size(missing) > 0, "missing").when((F.size(extra) > 0) | (F.size(mismatch) > 0), "diff").otherwise("match")
    return F.struct(status.alias("status"), missing.alias("missing"), extra.alias("extra"), mismatch.alias("mismatch"))


def combined_rows(reports: DataFrame, key: str) -> DataFrame:
    """(key, line, entry): each name's row of the table over both lanes, and its JSON, from (lane, key, markdown, images, json) with null for what a lane lacks."""
    of = lambda lane, c: F.max(F.when(F.col("lane") == lane, F.col(c)))
    both = reports.groupBy(key).agg(*[F.max(F.when(F.col("lane") == x, F.lit(True))).alias(x) for x in ("parity", "quality")], *[of(x, c).alias(f"{x}_{c}") for x in ("parity", "quality") for c in ("markdown", "json", "images")])
    shown = lambda c: F.coalesce(c, F.lit("\u2014"))
    columns = ["parity_markdown", "parity_json", "parity_images", "quality_markdown", "quality_images"]
    line = F.concat(F.lit("| `"), F.col(key).cast("string"), F.lit("` | "), F.concat_ws(" | ", *[shown(F.col(c)) for c in columns]), F.lit(" |"))
    side = lambda x, *cs: F.when(F.col(x), F.struct(*[F.col(f"{x}_{c}").alias(c) for c in cs])).alias(x)
    entry = F.to_json(F.struct(F.col(key).cast("string").alias("name"), side("parity", "markdown", "json", "images"), side("quality", "markdown", "images")))
    return both.select(key, line.alias("line"), entry.alias("entry"))


def combined_summary(rows: DataFrame, key: str) -> DataFrame:
    """(name, content) of ``summary.md`` and ``summary.json`` from ``combined_rows``, by name; one row each, so for corpora whose report a person reads."""
    listed = lambda c: F.transform(F.array_sort(F.collect_list(F.struct(key, c))), lambda x: x[c])
    all_ = rows.agg(listed("line").alias("lines"), listed("entry").alias("entries"))
    table = F.concat(F.lit(HEADER), F.array_join("lines", "\n"), F.lit("\n"))
    json = F.concat(F.lit('{"examples":['), F.array_join("entries", ","), F.lit("]}\n"))
    return all_.select(F.inline(F.array(F.struct(F.lit("summary.md").alias("name"), table.alias("content")), F.struct(F.lit("summary.json").alias("name"), json.alias("content")))))


def lane_summary(parity: DataFrame, quality: DataFrame, key: str) -> DataFrame:
    """Both lanes by name, full outer, and whether anything fails."""
    out = parity.select(key, F.col("status").alias("parity")).join(quality.select(key, F.col("status").alias("quality")), key, "full")
    return out.withColumn("fails", F.coalesce(F.col("parity") != "match", F.lit(False)) | F.coalesce(F.col("quality") == "missing", F.lit(False)))


def baseline_delta(now: DataFrame, before: DataFrame, key: str, score: str = "score", least: float = 0.001) -> DataFrame:
    """Adds the delta to the baseline (null without one), its direction and its text."""
    d = now.join(before.select(key, F.col(score).alias("before")), key, "left").withColumn("delta", F.col(score) - F.col("before"))
    kind = F.when(F.col("delta").isNull(), "new").when(F.col("delta") < -least, "regression").when(F.col("delta") > least, "improvement").otherwise("same")
    return d.withColumns({"change": kind, "delta_text": delta_text(F.col("delta"))})


def focus(rows: DataFrame, key: str, score: str = "score", low: float = 0.9, drop: float = -0.001, least: int = 3) -> DataFrame:
    """Rows below ``low`` or worse than before; if there are none, the ``least`` worst."""
    odd = (F.col(score) < low) | F.coalesce(F.col("delta") < drop, F.lit(False))
    bad = rows.where(odd)
    some = bad.limit(1).select(F.lit(1).alias("some"))
    worst = rows.orderBy(score, key).limit(least).join(F.broadcast(some), F.lit(True), "left_anti")
    return bad.unionByName(worst)


def overall(fidelity: Column, structure: Column, style: Column) -> Column:
    return 0.60 * fidelity + 0.35 * structure + 0.05 * style


def text_fidelity(aligned: Column, whole: Column) -> Column:
    return F.when(aligned.isNull(), whole).otherwise(0.35 * aligned + 0.65 * whole)


def bbox_score(a: Column, b: Column, tolerance: int = 15) -> Column:
    """1 less the mean of the coordinates' distances, each at most the tolerance, over the tolerance."""
    d = F.zip_with(a, b, lambda x, y: F.least(F.abs(x - y), F.lit(tolerance)) / float(tolerance))
    return 1 - F.aggregate(d, F.lit(0.0), lambda s, x: s + x) / F.size(d)


def final_dimension(parity: Column, result: Column, reference: Column, dead: float = 0.02) -> Column:
    """Parity, moved by a quarter of how far result and reference differ from the golden text, unless that is small."""
    d = 0.25 * (result - reference)
    return parity + F.when(F.abs(d) < dead, 0.0).otherwise(d)
