"""A run over a corpus: its inputs and arguments, lanes, freshness, outcomes, and what a report's scores hint at."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import pdf, text
from quire.functions.values import bound, number
from quire.operators.records import score_text

# The bound below which a score is reported, that of a text pair, and the hints.
LOW, LOW_PAIR = 0.98, 0.50
HINTS = {
    "style": "Markdown style wrappers (centering/bold/fences)",
    "json": "OCR JSON (block ordering, bbox rounding, content normalization)",
    "blocks": "Markdown block segmentation (heading/list/paragraph splits)",
    "tables": "Table extraction/canonicalization",
    "rules": "Example-specific rules/regression",
}
STYLES = ["center_wrappers", "bold_markers", "heading_levels", "code_languages"]
_SIDE = ", ".join(f"{s}: string" for s in STYLES)
# Maps hold variants and arrays the JSON of their elements, so one odd value is skipped and the others stay.
REPORT = (
    "parity struct<available: boolean, missing_reason: string, details: struct<"
    f"style: struct<actual: struct<{_SIDE}>, expected: struct<{_SIDE}>>, json: struct<available: boolean, components: map<string, variant>>, "
    "tables: struct<tables: array<string>>, block_shape: variant, text: struct<blocks: array<string>>>>, "
    "final_dimensions map<string, variant>, rules array<string>"
)
TABLE = "index string, score variant"
BLOCK = "index string, status string, score variant, actual_kind string, expected_kind string"
RULE = "status string, check_id string, check_type string, message string"
SUPPORTED = ("pdf", "png", "jpg", "jpeg")


def _first(*rules: tuple[Column, str | Column]) -> Column:
    """The name of the first rule that is broken, else null."""
    return F.coalesce(*[F.when(test, F.lit(name) if isinstance(name, str) else name) for test, name in rules])


def extension(path: Column) -> Column:
    """The lower-case extension of a path's last part, empty without one."""
    return F.lower(F.regexp_extract(path, r"[^/]\.([^./]+)$", 1))


def stem(name: Column) -> Column:
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def input_problem(uri: Column, page: Column, is_dir: Column) -> Column:
    """Why an input can't be read; ``is_dir`` is null where nothing lies. Null if it can."""
    return _first((~F.startswith(uri, F.lit("file://")), "invalid url"), (page < 1, "invalid page"), (is_dir.isNull(), "not found"), (is_dir, "directory"))


def layout_enabled(path: Column, layout: Column, no_layout: Column) -> Column:
    """A flag decides; without one, documents with pages have a layout."""
    return F.when(layout, True).when(no_layout, False).otherwise(F.coalesce(extension(path) == "pdf", F.lit(False)))


def argument_problem(a: dict[str, Column]) -> Column:
    """The first complaint about a run's arguments, else null.

    ``a``: max_new_tokens, pages, layout, no_layout, emit_json, emit_document, download_only,
    dev_forward, input, is_dir (null where nothing lies) and pages_problem (of the page list).
    """
    blank = lambda c: c.isNotNull() & (text.trim(c) == "")
    asked = lambda c: F.coalesce(text.trim(c), F.lit("")) != ""
    emits, idle = a["emit_json"].isNotNull() | a["emit_document"].isNotNull(), a["download_only"] | a["dev_forward"]
    is_pdf = F.coalesce(extension(text.trim(a["input"])) == "pdf", F.lit(False))
    # The complaints.
    return _first(
        (a["max_new_tokens"] <= 0, "--max-new-tokens must be > 0"),
        (blank(a["pages"]), "--pages must be non-empty"),
        (a["layout"] & a["no_layout"], "Pass at most one of --layout or --no-layout"),
        (blank(a["emit_json"]), "--emit-json path must be non-empty"),
        (blank(a["emit_document"]), "--emit-ocrdocument-json path must be non-empty"),
        (idle & emits, "--emit-json/--emit-ocrdocument-json require running inference"),
        (~idle & ~asked(a["input"]), "--input is required unless --download-only or --dev-forward-pass is set"),
        (~idle & a["is_dir"].isNull(), F.concat(F.lit("Input not found: "), text.trim(a["input"]))),
        (~idle & a["is_dir"], F.concat(F.lit("Input is a directory: "), text.trim(a["input"]))),
        (~idle & asked(a["pages"]) & ~is_pdf, "--pages is only valid for PDF inputs"),
        (~idle & is_pdf & a["pages_problem"].isNotNull(), F.concat(F.lit("--pages: "), a["pages_problem"])),
        (~idle & emits & ~layout_enabled(text.trim(a["input"]), a["layout"], a["no_layout"]), "--emit-json/--emit-ocrdocument-json require layout mode (pass --layout for non-PDF inputs)"),
    )


def pdf_pages(content: Column) -> Column:
    """The pages of a PDF's bytes by its page tree, in object streams too; null for other files and broken ones."""

    def counted(files: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for raw in files:
            yield pd.Series([pdf.page_count(None if x is None else bytes(x)) for x in raw], dtype="Int32")

    return F.pandas_udf(counted, "int")(content)


def lane_reports(names: DataFrame, key: str, markdown: DataFrame, images: DataFrame, blocks: DataFrame) -> DataFrame:
    """(lane, key, markdown, images, json): a row for each name and lane; what a lane lacks is missing, and only parity has JSON.

    markdown, images: (lane, key, status); blocks: (key, status).
    """
    of = lambda df, name, *on: df.select(*on, F.col("status").alias(name))
    each = names.select(key, F.explode(F.array(F.lit("parity"), F.lit("quality"))).alias("lane"))
    out = each.join(of(markdown, "markdown", "lane", key), ["lane", key], "left").join(of(images, "images", "lane", key), ["lane", key], "left").join(of(blocks, "json", key), key, "left")
    missing = lambda c: F.coalesce(c, F.lit("missing"))
    return out.select("lane", key, missing("markdown").alias("markdown"), missing("images").alias("images"), F.when(F.col("lane") == "parity", missing("json")).alias("json"))


def outcomes(inputs: DataFrame, results: DataFrame, key: str = "path", supported: tuple[str, ...] = SUPPORTED) -> DataFrame:
    """Each input with its outcome: skipped (its extension isn't supported), succeeded or failed (no result, or one that isn't ok)."""
    ok = F.coalesce("ok", F.lit(False))
    status = F.when(~extension(F.col(key)).isin(*supported), "skipped").when(ok, "succeeded").otherwise("failed")
    return inputs.join(results.select(key, "ok"), key, "left").withColumn("outcome", status).drop("ok")


def run_status(done: DataFrame, *by: str) -> DataFrame:
    """Counts of outcomes, and ``failed`` if an input failed, else ``ok``."""
    n = lambda s: F.count_if(F.col("outcome") == s).alias(s)
    return done.groupBy(*by).agg(n("succeeded"), n("skipped"), n("failed")).withColumn("status", F.when(F.col("failed") > 0, "failed").otherwise("ok"))


def incomplete(sources: DataFrame, files: DataFrame) -> DataFrame:
    """(name) of the sources without both results; sources: (name), files: (path) as ``stem/stem.md`` and ``.json``. Names in ``._`` don't count."""
    wanted = sources.where(~F.startswith("name", F.lit("._"))).select("name", F.explode(F.array(F.lit("md"), F.lit("json"))).alias("_e"))
    wanted = wanted.withColumn("path", F.concat(stem(F.col("name")), F.lit("/"), stem(F.col("name")), F.lit("."), F.col("_e")))
    return wanted.join(files.select("path"), "path", "left_anti").select("name").distinct()


def needs_refresh(current: Column, stored: Column, complete: Column, forced: Column) -> Column:
    """Whether results are made anew: when forced, incomplete, or without the fingerprint of now."""
    same = (F.coalesce(current, F.lit("")) != "") & F.coalesce(current == stored, F.lit(False))
    return forced | ~(same & complete)


def signals(report: Column) -> Column:
    """array<string>: what stands out in a document's JSON report, and where to look.

    Style values that are lists or objects are shown as JSON. Scores that aren't numbers and list
    elements that aren't objects are skipped one by one.
    """
    return bound(F.from_json(report, REPORT), _lines)


def _lines(r: Column) -> Column:
    parity, d = r["parity"], r["parity"]["details"]
    shown_score = lambda v: bound(v, score_text)
    shown = lambda c: F.coalesce(c, F.lit("None"))
    joined = lambda items, n=5: F.array_join(F.slice(items, 1, n), ", ")
    named = lambda m: F.filter(F.transform(F.map_entries(m), lambda e, i: F.struct(number(e["value"]).alias("v"), i.alias("i"), e["key"].alias("k"))), lambda e: e["v"].isNotNull())
    objects = lambda items, schema: F.transform(F.filter(items, lambda x: F.startswith(F.ltrim(x), F.lit("{"))), lambda x: F.from_json(x, schema))

    def listed(title: str, items: Column, text_of: Callable[[Column], Column]) -> Column:
        """A line with the first five items, null if there are none."""
        return bound(items, lambda x: F.when(F.size(x) > 0, F.concat(F.lit(title), joined(F.transform(F.slice(x, 1, 5), text_of)))))

    low = bound(F.array_min(named(r["final_dimensions"])), lambda e: F.when(e.isNotNull(), F.concat(F.lit("- lowest dimension: `"), e["k"], F.lit("` = "), shown_score(e["v"]))))
    sides = [(s, d["style"]["actual"][s], d["style"]["expected"][s]) for s in STYLES]
    style = [F.when(a != e, F.concat(F.lit(f"- style.{s}: actual="), a, F.lit(", expected="), e)) for s, a, e in sides]

    components = F.when(d["json"]["available"], F.array_sort(F.filter(named(d["json"]["components"]), lambda e: e["v"] < LOW)))
    json = listed("- json components < 0.98: ", components, lambda e: F.concat(e["k"], F.lit("="), shown_score(e["v"])))

    scores = F.transform(objects(d["tables"]["tables"], TABLE), lambda t: F.struct(t["index"].alias("index"), number(t["score"]).alias("score")))
    tables = listed("- tables < 0.98: ", F.filter(scores, lambda t: t["score"] < LOW), lambda t: F.concat(F.lit("#"), shown(t["index"]), F.lit("="), shown_score(t["score"])))
    shape = bound(number(d["block_shape"]), lambda v: F.when(v < LOW, F.concat(F.lit("- block_shape: "), shown_score(v))))

    status = lambda b: F.when(F.coalesce(b["status"], F.lit("")) == "", "unknown").otherwise(b["status"])

    def of_blocks(blocks: Column) -> Column:
        """Two lines: how many blocks have each status, and the pairs of lowest score."""
        states = F.transform(blocks, status)
        counts = F.transform(F.array_sort(F.array_distinct(states)), lambda s: F.concat(s, F.lit("="), F.size(F.filter(states, lambda x: x == s)).cast("string")))
        scored = F.transform(blocks, lambda b, i: F.struct(F.coalesce(number(b["score"]), F.lit(0.0)).alias("v"), i.alias("i"), status(b).alias("s"), b["index"].alias("index"), b["status"].alias("status"), b["actual_kind"].alias("a"), b["expected_kind"].alias("e")))
        pairs = F.array_sort(F.filter(scored, lambda p: (p["s"] != "paired") | (p["v"] < LOW_PAIR)))
        text_of = lambda p: F.concat(F.lit("(idx="), shown(p["index"]), F.lit(", status="), shown(p["status"]), F.lit(", actual="), shown(p["a"]), F.lit(", expected="), shown(p["e"]), F.lit(", score="), shown_score(p["v"]), F.lit(")"))
        return F.array(F.when(F.size(blocks) > 0, F.concat(F.lit("- text blocks: "), F.array_join(counts, ", "))), listed("- lowest text pairs: ", pairs, text_of))

    blocks = bound(objects(d["text"]["blocks"], BLOCK), of_blocks)

    failed = F.filter(objects(r["rules"], RULE), lambda x: x["status"].isin("fail", "error"))
    first = lambda x: F.concat(shown(x["check_id"]), F.lit(" / "), shown(x["check_type"]), F.lit(" / "), shown(x["message"]))
    rules = bound(failed, lambda x: F.when(F.size(x) > 0, F.concat(F.lit("- rules failed: "), F.size(x).cast("string"), F.lit(" (first: "), first(F.get(x, F.lit(0))), F.lit(")"))))

    def hinted(x: Column) -> Column:
        """The lines with one of hints at the end; x has the lines by topic."""
        told = {"style": F.exists(x["style"], lambda s: s.isNotNull()), "json": x["json"].isNotNull(), "blocks": x["shape"].isNotNull() | F.get(x["blocks"], F.lit(1)).isNotNull(), "tables": x["tables"].isNotNull(), "rules": x["rules"].isNotNull()}
        hints = F.array_compact(F.array(*[F.when(told[k], F.lit(v)) for k, v in HINTS.items()]))
        last = F.array(F.when(F.size(hints) > 0, F.concat(F.lit("- fix_hints: "), F.array_join(hints, ", "))))
        return F.array_compact(F.concat(F.array(x["low"]), x["style"], F.array(x["json"], x["tables"], x["shape"]), F.coalesce(x["blocks"], F.array().cast("array<string>")), F.array(x["rules"]), last))

    lines = F.struct(low.alias("low"), F.array(*style).alias("style"), json.alias("json"), tables.alias("tables"), shape.alias("shape"), blocks.alias("blocks"), rules.alias("rules"))
    reason = F.when(F.coalesce(parity["missing_reason"], F.lit("")) == "", "missing parity score").otherwise(parity["missing_reason"])
    without = F.array(F.concat(F.lit("- parity: unavailable ("), reason, F.lit(")")))
    return F.when(F.coalesce(parity["available"], F.lit(False)), bound(lines, hinted)).otherwise(without)
