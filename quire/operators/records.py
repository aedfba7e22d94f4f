"""Selection, settings, gates and files around a run."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import labels, text
from quire.functions.values import as_bool, bound, safe_name
from quire.sources.namedfiles import document_files, write_named

# Spellings of settings.
BACKENDS = {"coreImageBicubic": ["coreimage", "core_image", "coreimagebicubic"], "deterministicBicubicCPU": ["deterministic", "deterministic_bicubic_cpu", "deterministicbicubiccpu"]}
DTYPES = {"float16": ["float16", "fp16"], "float32": ["float32", "fp32"], "bfloat16": ["bfloat16", "bf16"]}


def _spelled(raw: Column, spellings: dict[str, list[str]]) -> Column:
    value = F.lower(text.trim(raw))
    return F.coalesce(*[F.when(value.isin(names), F.lit(key)) for key, names in spellings.items()])


def select_regions(regions: DataFrame, indices: list[int] = (), names: list[str] = ()) -> DataFrame:
    """Regions that are recognised, of an index and a label asked for; an empty list asks for all."""
    task = labels.task_of(F.col("native_label"))
    tests = [task.isin("text", "table", "formula")]
    tests += [F.col("idx").isin(list(indices))] if indices else []
    tests += [F.col("native_label").isin(list(names))] if names else []
    return regions.where(reduce(lambda a, b: a & b, tests))


def route(regions: DataFrame) -> DataFrame:
    """Adds task and route: ``ocr``, ``keep`` (skipped: the row stays without content) or ``error`` (a region that should have been dropped)."""
    task = labels.task_of(F.col("native_label"))
    return regions.withColumns({"task": task, "route": F.when(task == "skip", "keep").when(task == "abandon", "error").otherwise("ocr")})


def scatter(regions: DataFrame, results: DataFrame, keys: list[str]) -> DataFrame:
    """Regions with the content recognised for them, by their offset in the page; others keep theirs."""
    found = results.select(*keys, F.col("content").alias("_found"), F.lit(True).alias("_is"))
    return regions.join(found, keys, "left").withColumn("content", F.when(F.col("_is"), F.col("_found")).otherwise(F.col("content"))).drop("_found", "_is")


def porcelain_path(line: Column) -> Column:
    """The path of a status line (after three characters; of a renaming the new one), unquoted; null without one."""
    rest = F.substring(line, 4, 1 << 20)
    at = F.instr(rest, " -> ")
    path = F.regexp_replace(text.trim(F.when(at > 0, F.substr(rest, at + 4)).otherwise(rest)), '^"+|"+$', "")
    return F.when((F.length(line) >= 4) & (path != ""), path)


def ignored(path: Column, prefixes: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.startswith(path, F.lit(p)) | (path == p.rstrip("/")) for p in prefixes])


def image_policy(backend: Column, quality: Column, align: Column, dtype: Column, preferred: Column, vision: Column, default_backend: str = "coreImageBicubic", default_dtype: str = "bfloat16") -> Column:
    """struct(backend, quality, align, dtype): a setting beats the preference, which beats the default; a dtype that is set ends alignment."""
    explicit, wanted = _spelled(dtype, DTYPES), F.coalesce(as_bool(align), F.lit(True))
    return F.struct(
        F.coalesce(_spelled(backend, BACKENDS), preferred, F.lit(default_backend)).alias("backend"),
        quality.try_cast("double").alias("quality"),
        (explicit.isNull() & wanted).alias("align"),
        F.coalesce(explicit, F.when(wanted, vision), F.lit(default_dtype)).alias("dtype"),
    )


def target_size(w: Column, h: Column, shortest: int, longest: int | None = None) -> Column:
    """struct(w, h): the shorter side becomes ``shortest``, unless the longer one then exceeds ``longest``; at least 1."""
    w, h = F.greatest(w, F.lit(1)).cast("double"), F.greatest(h, F.lit(1)).cast("double")
    near = lambda v: F.floor(v + 0.5)
    scale = F.lit(float(shortest)) / F.least(w, h)
    a, b = near(w * scale), near(h * scale)
    if longest:
        far, over = F.lit(float(longest)) / F.greatest(a, b), F.greatest(a, b) > longest
        a, b = F.when(over, near(a * far)).otherwise(a), F.when(over, near(b * far)).otherwise(b)
    return F.struct(F.greatest(a, F.lit(1)).cast("int").alias("w"), F.greatest(b, F.lit(1)).cast("int").alias("h"))


def markdown_images(markdown: Column) -> Column:
    """The targets of image links whose text starts with 'Image', in order."""
    return F.regexp_extract_all(markdown, F.lit(r"!\[Image[^\]]*\]\(([^)]+)\)"), F.lit(1))


def decimals(x: Column, places: int = 4) -> Column:
    """A double with ``places`` decimals, rounding its exact binary value, ties to even (Java's formatter rounds the shortest decimal half up).

    Exact below 2e11 for four places; larger values go through the formatter. nan, inf and the sign of -0.0 are kept.
    """
    power = float(10**places)

    def rounded(p: Column) -> Column:
        """The whole number nearest to a product and its error."""
        whole = F.floor(p["v"]).cast("double")
        over = p["v"] - whole - 0.5  # exact, and a multiple of the product's last bit: the error decides only at zero
        up = (over > 0) | ((over == 0) & ((p["error"] > 0) | ((p["error"] == 0) & (whole % 2 == 1))))
        return (whole + up.cast("double")).cast("long")

    def product(h: Column) -> Column:
        """a * power as the unevaluated sum of a rounded product and its error."""
        v = h["a"] * power
        return F.struct(v.alias("v"), ((h["high"] * power - v) + (h["a"] - h["high"]) * power).alias("error"))

    def shown(v: Column) -> Column:
        a = F.abs(v)
        split = a * 134217729.0
        halves = F.struct(a.alias("a"), (split - (split - a)).alias("high"))  # the upper half of a's bits
        sign = F.when((v < 0) | (v.cast("string") == "-0.0"), "-").otherwise("")
        digits = bound(bound(bound(halves, product), rounded), lambda n: F.concat(((n - n % 10**places) / 10**places).cast("long").cast("string"), F.lit("."), F.lpad((n % 10**places).cast("string"), places, "0")))
        odd = F.when(F.isnan(v), "nan").when(a == float("inf"), F.concat(sign, F.lit("inf")))
        return F.coalesce(odd, F.when(a * power < 2.0**51, F.concat(sign, digits)), F.when(v.isNotNull(), F.format_string(f"%.{places}f", v)))

    return bound(x, shown)


def score_text(score: Column) -> Column:
    return F.coalesce(decimals(score.cast("double")), F.lit("None"))


def delta_text(delta: Column) -> Column:
    return F.coalesce(bound(delta.cast("double"), lambda d: F.concat(F.when((d >= 0) & ~F.isnan(d), "+").otherwise(""), decimals(d))), F.lit(""))


def fails(lane: Column, markdown: Column, images: Column, json: Column, fail_on: list[str]) -> Column:
    """Whether a report fails a run under the conditions ``missing``, ``markdown``, ``images``, ``json``; only the parity lane has JSON."""
    parity, tests = (lane == "parity") & json.isNotNull(), []
    if "missing" in fail_on:
        tests += [markdown == "missing", images == "missing", parity & json.isin("missing", "error")]
    tests += [c != "match" for name, c in (("markdown", markdown), ("images", images)) if name in fail_on]
    tests += [parity & (json != "match")] if "json" in fail_on else []
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def parity_problems(both: DataFrame, tolerance: int = 15) -> DataFrame:
    """Adds ``problem`` to matched blocks (a, e: index, label, content, bbox): the first rule broken, null if none.

    Contents must be blank for images and not blank for others, on both sides; their texts needn't agree.
    """
    blank = lambda side: text.trim(F.coalesce(F.col(f"{side}.content"), F.lit(""))) == ""
    image = F.col("a.label") == "image"
    far = F.exists(F.zip_with("a.bbox", "e.bbox", lambda x, y: F.abs(x - y)), lambda d: d > tolerance)
    problem = (
        F.when(F.col("a").isNull() | F.col("e").isNull(), "count")
        .when(F.col("a.index") != F.col("e.index"), "index")
        .when(F.col("a.label") != F.col("e.label"), "label")
        .when(image & ~(blank("a") & blank("e")), "image not empty")
        .when(~image & (blank("a") | blank("e")), "empty")
        .when((F.size("a.bbox") != 4) | (F.size("e.bbox") != 4), "no bbox")
        .when(far, "bbox")
    )
    return both.withColumn("problem", problem)


def lowest(rows: DataFrame, key: str, score: str, n: int, order: list[str]) -> DataFrame:
    """The n rows of lowest score of each key, ties by ``order``, with their rank."""
    w = Window.partitionBy(key).orderBy(score, *order)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def manifest(regions: DataFrame, backends: list[str]) -> DataFrame:
    """(doc_id, page_index, entries): for each region in order, and each backend, the name of its preprocessed picture."""
    each = regions.withColumn("backend", F.explode(F.array(*[F.lit(b) for b in backends])))
    entry = F.struct("idx", "backend", F.format_string("region_%03d_%s_%s.png", F.col("idx"), safe_name(F.col("native_label")), F.col("backend")).alias("file"))
    return each.groupBy("doc_id", "page_index").agg(F.array_sort(F.collect_list(entry)).alias("entries"))


def pages_needed(rows: DataFrame, key: str, page: str) -> DataFrame:
    """(key, pages, last): the distinct pages asked for, ascending, and the last one."""
    return rows.groupBy(key).agg(F.array_sort(F.collect_set(page)).alias("pages"), F.max(page).alias("last"))


def write_markdown(docs: DataFrame, path: str) -> None:
    """``doc_id/doc_id.md`` for each document of (doc_id, markdown), all or none."""
    write_named(document_files(docs, "doc_id", md="markdown"), path)


def write_record(rows: DataFrame, path: str) -> None:
    """Rows as JSON lines, such as a run's metadata, an evaluation's record or a manifest."""
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def run_metadata(outcomes: DataFrame, settings: dict[str, str | None]) -> DataFrame:
    """One row: schema_version, status, settings (blank ones null) and the sorted lists of (path, outcome) by outcome.

    A run has failed if an input has. The lists hold every path, so this is for runs whose listing fits in a row.
    """
    listed = lambda o: F.sort_array(F.collect_list(F.when(F.col("outcome") == o, F.col("path")))).alias(o)
    given = F.struct(*[F.nullif(F.trim(F.lit(v or "")), F.lit("")).alias(k) for k, v in settings.items()])
    status = F.when(F.count_if(F.col("outcome") == "failed") > 0, "failed").otherwise("ok")
    row = outcomes.agg(status.alias("status"), F.struct(*[listed(o) for o in ("succeeded", "failed", "skipped")]).alias("run"))
    return row.select(F.lit(1).alias("schema_version"), "status", given.alias("settings"), "run")
