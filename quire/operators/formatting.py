"""Regions to ordered Markdown and block lists.

A page's regions are one array after a single shuffle on (doc_id, page_index); the merges that
depend on order are folds over it, all in expressions that Catalyst sees.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import labels, text
from quire.functions.values import bound

KEYS = ["doc_id", "page_index"]


def format_content(regions: DataFrame) -> DataFrame:
    """Kinds and formatted contents; blank contents go, null ones stay; renumbered."""
    return renumber(_formatted(regions))


def _formatted(regions: DataFrame) -> DataFrame:
    kind = labels.kind_of(F.col("native_label"))
    out = text.format_column(regions.withColumn("kind", kind))
    # A generator of one row keeps the filter from being pushed into, and multiplied by, the steps.
    out = out.withColumn("content", F.explode(F.array("content")))
    return out.where(F.col("content").isNull() | (text.trim("content") != ""))


def renumber(regions: DataFrame) -> DataFrame:
    """Numbers a page's regions by idx; equal ones by ``offset``, their place in the input, if there is such a column."""
    w = Window.partitionBy(*KEYS).orderBy("idx", *[c for c in ("offset",) if c in regions.columns])
    return regions.withColumn("idx", (F.row_number().over(w) - 1).cast("int"))


def _pages(regions: DataFrame) -> DataFrame:
    """(keys, r): each page's regions in order, as an array."""
    order = ["idx", *[c for c in ("offset",) if c in regions.columns]]
    row = F.struct(*order, "native_label", "kind", "bbox", "content")
    return regions.groupBy(*KEYS).agg(F.array_sort(F.collect_list(row)).alias("r"))


def _rows(pages: DataFrame) -> DataFrame:
    return pages.select(*KEYS, F.posexplode("r").alias("p", "x")).select(*KEYS, F.col("p").cast("int").alias("idx"), "x.native_label", "x.kind", "x.bbox", "x.content")


def _with_content(x: Column, c: Column) -> Column:
    return x.withField("content", c)


def formula_numbers_merged(r: Column) -> Column:
    """A number joins the formula behind it, else the one before it; numbers without one go.

    A left fold with the state (rows so far, whether the next row is consumed).
    """
    number = lambda x: x["native_label"] == "formula_number"
    is_formula = lambda x: x["kind"] == "formula"

    def tagged(f: Column, n: Column) -> Column:
        joined = F.concat(F.substr(f["content"], F.lit(1), F.length(f["content"]) - 3), F.lit(" \\tag{"), text.formula_number(n["content"]), F.lit("}\n$$"))
        return _with_content(f, F.when(F.endswith(f["content"], F.lit("\n$$")), joined).otherwise(f["content"]))

    def step(acc: Column, e: Column) -> Column:
        x, y = e["x"], e["y"]
        ahead = y.isNotNull() & number(x) & is_formula(y)
        behind = y.isNotNull() & ~number(x) & is_formula(x) & number(y)
        none = F.slice(acc["out"], 1, 0)
        add = F.when(acc["skip"], none).when(ahead, F.array(tagged(y, x))).when(behind, F.array(tagged(x, y))).when(number(x), none).otherwise(F.array(x))
        return F.struct(F.concat(acc["out"], add).alias("out"), (~acc["skip"] & (ahead | behind)).alias("skip"))

    def folded(a: Column) -> Column:
        two = F.transform(a, lambda x, i: F.struct(x.alias("x"), F.get(a, i + 1).alias("y")))
        return F.aggregate(two, F.struct(F.slice(a, 1, 0).alias("out"), F.lit(False).alias("skip")), step, lambda s: s["out"])

    # Most pages have no number and stay as they are.
    return bound(r, lambda a: F.when(F.exists(a, number), folded(a)).otherwise(a))


def hyphens_merged(r: Column) -> Column:
    """A text that ends in a hyphen takes in the next text that starts with a lower-case letter.

    Texts in between are passed over, and whether that text was taken in before isn't asked, so
    one fragment can end up in two texts. A row that was taken in is skipped.
    """
    is_text = lambda x: x["kind"] == "text"
    hyphened = lambda x: F.coalesce(is_text(x) & x["content"].rlike(r"(?U)-\s*\z"), F.lit(False))
    word = lambda a, b: F.concat(a, b).rlike(r"\A[\p{L}\p{M}]{1,64}\z") & (F.length(a) > 0) & (F.length(b) > 0)

    def joined(s: Column) -> Column:
        """The text that x becomes with the next lower-case one, null if they don't make a word."""
        body = text.trim_right(s["x"]["content"])
        parts = F.struct(F.substr(body, F.lit(1), F.length(body) - 1).alias("head"), text.trim_left(s["y"]["content"]).alias("tail"))
        return bound(parts, lambda p: F.when(word(F.regexp_extract(p["head"], r"(?U)(\S+)\s*\z", 1), F.regexp_extract(p["tail"], r"(?U)\A(\S+)", 1)), F.concat(p["head"], p["tail"])))

    def merged(a: Column) -> Column:
        starts = F.filter(F.transform(a, lambda x, i: F.when(is_text(x) & text.trim_left(x["content"]).rlike(r"\A\p{Ll}"), i)), lambda i: i.isNotNull())

        def planned(low: Column) -> Column:
            """For each row the row itself or merged, and the place of the text that it takes in."""

            def of(x: Column, i: Column) -> Column:
                j = F.when(hyphened(x), F.get(F.filter(low, lambda k: k > i), F.lit(0)))
                found = F.when(j.isNotNull(), bound(F.struct(x.alias("x"), F.get(a, j).alias("y")), joined))
                return bound(found, lambda c: F.struct(F.when(c.isNotNull(), _with_content(x, c)).otherwise(x).alias("x"), F.when(c.isNotNull(), j).alias("takes"), i.alias("i")))

            return F.transform(a, of)

        def step(acc: Column, e: Column) -> Column:
            skipped = F.array_contains(acc["gone"], e["i"])
            out = F.when(skipped, acc["out"]).otherwise(F.concat(acc["out"], F.array(e["x"])))
            gone = F.when(e["takes"].isNotNull() & ~skipped, F.concat(acc["gone"], F.array(e["takes"]))).otherwise(acc["gone"])
            return F.struct(out.alias("out"), gone.alias("gone"))

        start = F.struct(F.slice(a, 1, 0).alias("out"), F.array().cast("array<int>").alias("gone"))
        return F.aggregate(bound(starts, planned), start, step, lambda s: s["out"])

    # Most pages have no text that ends in a hyphen.
    return bound(r, lambda a: F.when(F.exists(a, hyphened), merged(a)).otherwise(a))


def bullets_filled(r: Column, near: int = 10) -> Column:
    """A text between two bullets with about the same left edge becomes a bullet."""
    is_bullet = lambda x: F.coalesce((x["native_label"] == "text") & F.startswith(x["content"], F.lit("- ")), F.lit(False))

    def filled(a: Column) -> Column:
        def of(x: Column, i: Column) -> Column:
            around = [F.get(a, i - 1), F.get(a, i + 1)]
            fill = (x["native_label"] == "text") & ~F.startswith(x["content"], F.lit("- "))
            for y in around:
                fill = fill & is_bullet(y) & (F.abs(y["bbox"]["x1"] - x["bbox"]["x1"]) <= near)
            return F.when(fill, _with_content(x, F.concat(F.lit("- "), x["content"]))).otherwise(x)

        return F.transform(a, of)

    return bound(r, lambda a: F.when(F.exists(a, is_bullet), filled(a)).otherwise(a))


def _stepwise(step: Callable[[Column], Column]) -> Callable[[DataFrame], DataFrame]:
    return lambda regions: _rows(_pages(regions).withColumn("r", step(F.col("r"))))


#: The steps one by one, from rows to rows.
merge_formula_numbers, merge_hyphens, infill_bullets = (_stepwise(f) for f in (formula_numbers_merged, hyphens_merged, bullets_filled))


def format_pages(regions: DataFrame) -> DataFrame:
    """(keys, r): each page's formatted regions as an array, after one exchange."""
    pages = _pages(_formatted(regions))
    for step in (formula_numbers_merged, hyphens_merged, bullets_filled):
        pages = pages.withColumn("r", step(F.col("r")))
    return pages


def format_regions(regions: DataFrame) -> DataFrame:
    return _rows(format_pages(regions))


def _block(x: Column, page: Column) -> Column:
    return F.when(x["kind"] == "image", text.image_placeholder(page, x["bbox"])).otherwise(F.nullif(x["content"], F.lit("")))


def page_markdown(formatted: DataFrame) -> DataFrame:
    """(doc_id, page_index, markdown): contents and image placeholders, a blank line between. From rows, or from ``format_pages``."""
    pages = formatted if "r" in formatted.columns else _pages(formatted)
    parts = F.filter(F.transform("r", lambda x: _block(x, F.col("page_index"))), lambda b: b.isNotNull())
    return pages.select(*KEYS, F.array_join(parts, "\n\n").alias("markdown"))


def document_markdown(pages: DataFrame) -> DataFrame:
    """(doc_id, markdown): pages in order, a blank line between."""
    parts = F.array_sort(F.collect_list(F.struct("page_index", "markdown")))
    return pages.groupBy("doc_id").agg(F.array_join(F.transform(parts, lambda x: x["markdown"]), "\n\n").alias("markdown"))


def block_list(formatted: DataFrame) -> DataFrame:
    """(doc_id, blocks): JSON of pages of items, keys in the order index, label, content, bbox_2d. From rows, or from ``format_pages``."""
    pages = formatted if "r" in formatted.columns else _pages(formatted)

    def item(x: Column, i: Column) -> Column:
        label = F.when(x["kind"] == "unknown", "text").otherwise(x["kind"])
        return F.struct(i.alias("index"), label.alias("label"), F.coalesce(x["content"], F.lit("")).alias("content"), F.array(*[x["bbox"][e] for e in ("x1", "y1", "x2", "y2")]).alias("bbox_2d"))

    docs = pages.select(*KEYS, F.transform("r", item).alias("items")).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_index", "items"))).alias("p"))
    return docs.select("doc_id", F.to_json(F.transform("p", lambda x: x["items"])).alias("blocks"))


def document_json(formatted: DataFrame) -> DataFrame:
    """(doc_id, document): JSON with keys in alphabetical order; null fields are left out. From rows, or from ``format_pages``."""
    pages = formatted if "r" in formatted.columns else _pages(formatted)

    def region(x: Column, i: Column) -> Column:
        box = F.struct(*[x["bbox"][e].alias(e) for e in ("x1", "x2", "y1", "y2")])
        return F.struct(box.alias("bbox"), x["content"].alias("content"), i.alias("index"), x["kind"].alias("kind"), x["native_label"].alias("nativeLabel"))

    docs = pages.select(*KEYS, F.transform("r", region).alias("regions")).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_index", "regions"))).alias("p"))
    return docs.select("doc_id", F.to_json(F.struct(F.transform("p", lambda x: F.struct(x["page_index"].alias("index"), x["regions"].alias("regions"))).alias("pages"))).alias("document"))


def image_refs(pages: DataFrame, prefix: str = "cropped") -> DataFrame:
    """(doc_id, page_index, n_refs, markdown): each placeholder replaced by a link to its crop, first occurrence each."""
    tag = r"!\[\]\(page=\d+,\s*bbox=\[[^\]]*\]\)"
    found = F.filter(F.regexp_extract_all("markdown", F.lit(tag), F.lit(0)), lambda t: t.rlike(r"bbox=\[\s*\d+\s*,\s*\d+\s*,\s*\d+\s*,\s*\d+\s*\]"))

    def replace(acc: Column, t: Column) -> Column:
        at = F.instr(acc["md"], t)
        page = F.regexp_extract(t, r"page=(\d+)", 1)
        link = F.concat(F.lit("![Image "), page, F.lit("-"), acc["i"].cast("string"), F.lit(f"](imgs/{prefix}_page"), page, F.lit("_idx"), acc["i"].cast("string"), F.lit(".jpg)"))
        md = F.when(at > 0, F.concat(F.substr(acc["md"], F.lit(1), at - 1), link, F.substr(acc["md"], at + F.length(t)))).otherwise(acc["md"])
        return F.struct(md.alias("md"), (acc["i"] + 1).alias("i"))

    folded = F.aggregate(found, F.struct(F.col("markdown").alias("md"), F.lit(0).alias("i")), replace)
    return pages.select(*KEYS, F.size(found).alias("n_refs"), folded["md"].alias("markdown"))
