"""Prompts, chat templates and the positions of their tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

IMAGE = "<image>"
# The instruction of each task, of any other, and of a structured one.
PROMPTS = {"text": "Text Recognition:", "table": "Table Recognition:", "formula": "Formula Recognition:"}
DEFAULT_PROMPT = "Recognize the text in the image and output in Markdown format.\nPreserve the original layout (headings/paragraphs/tables/formulas).\nDo not fabricate content that does not exist in the image."
SCHEMA_PROMPT = "Extract structured data and return JSON that matches this schema:\n\n"


def task_prompt(task: Column, schema: Column | None = None) -> Column:
    """The image's placeholder and the instruction; a structured task has its schema behind."""
    known = F.create_map(*[F.lit(x) for kv in PROMPTS.items() for x in kv])
    text = F.coalesce(F.try_element_at(known, task), F.lit(DEFAULT_PROMPT))
    if schema is not None:
        text = F.when(task == "structured", F.concat(F.lit(SCHEMA_PROMPT), schema)).otherwise(text)
    return F.concat(F.lit(IMAGE + "\n"), text)


def split_placeholder(prompt: Column, placeholder: str = IMAGE) -> Column:
    """struct(before, after) of the first placeholder; null without one."""
    at = F.instr(prompt, F.lit(placeholder))
    both = F.struct(F.substr(prompt, F.lit(1), at - 1).alias("before"), F.substr(prompt, at + len(placeholder)).alias("after"))
    return F.when(at > 0, both)


def chat_prompt(before: Column, images: Column, after: Column, think: bool = True) -> Column:
    """One user turn with an image of ``images`` tokens (at least 1, else null), ready for the answer."""
    image = F.concat(F.lit("<|begin_of_image|>"), F.repeat(F.lit("<|image|>"), images), F.lit("<|end_of_image|>"))
    turn = F.concat(F.lit("[gMASK]<sop>\n<|user|>\n"), before, image, after, F.lit(("" if think else "\n/nothink") + "\n<|assistant|>\n"))
    return F.when(images > 0, turn)


def fuse(tokens: DataFrame, vision: DataFrame, key: str, image_id: int) -> DataFrame:
    """Adds the vision row of each image token: the k-th takes the k-th; a count that differs is an error.

    tokens: (key, pos, token); vision: (key, k, ...) with k from 1.
    """
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    is_image = F.col("token") == image_id
    placed = tokens.withColumn("k", F.when(is_image, F.sum(is_image.cast("int")).over(w)))
    counts = placed.groupBy(key).agg(F.count("k").alias("_asked")).join(vision.groupBy(key).agg(F.count("*").alias("_have")), key, "left")
    checked = counts.select(key, F.when(F.col("_asked") == F.coalesce("_have", F.lit(0)), F.lit(True)).otherwise(F.raise_error(F.lit("image tokens and vision rows differ")).cast("boolean")).alias("_ok"))
    return placed.join(checked, key).where("_ok").drop("_ok").join(vision, [key, "k"], "left")


#: The least number of parts by key; a number that is given isn't lowered by the size of what is shuffled, which packs well.
PARTS = 200


def token_runs(tokens: DataFrame, key: str, kind: str) -> DataFrame:
    """(key, run, kind, first, n): maximal runs of one kind. One exchange and one sort; a run's length is how far the next one begins behind it."""
    w = Window.partitionBy(key).orderBy("pos")
    parts = max(PARTS, int(tokens.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    begins = ~F.coalesce(F.lag(kind).over(w).eqNullSafe(F.col(kind)) & (F.row_number().over(w) > 1), F.lit(False))
    placed = tokens.repartition(parts, key).withColumns({"_b": begins, "_at": F.row_number().over(w), "_all": F.count("*").over(Window.partitionBy(key))})
    runs = placed.where("_b").withColumns({"run": F.row_number().over(w), "n": F.coalesce(F.lead("_at").over(w).cast("long"), F.col("_all") + 1) - F.col("_at")})
    return runs.select(key, "run", kind, F.col("pos").alias("first"), "n")


def rope_positions(tokens: DataFrame, key: str, image_id: int, merge: int = 2, video_start: int | None = None, video_end: int | None = None, strict: bool = False) -> DataFrame:
    """Adds p_t, p_h, p_w (time, row, column), delta and problem to (key, pos, token, grid_t, grid_h, grid_w).

    The grid is the image's in patches, of which ``merge`` by ``merge`` make a token. Text counts on in
    all three; the tokens of the one image count their time, row and column from where the text stood; text
    behind goes on after the largest of these. delta is one more than the last position less the length.
    Image tokens between the video marks are a video's. The first fault of a key is its ``problem``, and
    then the rest is null, or with ``strict`` an error: no grid, a grid that isn't filled exactly, a second image,
    a video. All windows share one partitioning by the key.
    """
    order, whole = Window.partitionBy(key).orderBy("pos"), Window.partitionBy(key)
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    marks = [F.when(F.col("token") == m, F.lit(on)) for m, on in ((video_end, False), (video_start, True)) if m is not None]
    in_video = F.coalesce(F.last(F.coalesce(*marks), ignorenulls=True).over(so_far), F.lit(False)) if marks else F.lit(False)
    t = tokens.withColumn("_kind", F.when(F.col("token") != image_id, "text").when(in_video, "video").otherwise("image"))
    t = t.withColumn("_new", ~F.coalesce(F.lag("_kind").over(order) == F.col("_kind"), F.lit(False)))
    t = t.withColumn("_group", F.count_if(F.col("_new") & (F.col("_kind") == "image")).over(so_far))
    begin = lambda test: F.min(F.when(F.col("_new") & test, F.col("pos").cast("long"))).over(whole)
    image, in_first = F.col("_kind") == "image", (F.col("_kind") == "image") & (F.col("_group") == 1)
    cell = lambda c, m=1: F.greatest(F.floor(F.col(c) / m), F.lit(1)).cast("int")
    t = t.withColumns({"_s": begin(in_first), "_s2": begin(image & (F.col("_group") == 2)), "_v": begin(F.col("_kind") == "video"), "_n": F.count_if(in_first).over(whole)})
    t = t.withColumns({"_t": cell("grid_t"), "_h": cell("grid_h", merge), "_w": cell("grid_w", merge)})
    cells, span = F.col("_t") * F.col("_h") * F.col("_w"), F.greatest("_t", "_h", "_w")
    fault = lambda test, pos, words: F.when(test, F.struct(pos.alias("pos"), words.alias("text")))
    faults = [
        fault(F.col("grid_t").isNull() | F.col("grid_h").isNull() | F.col("grid_w").isNull(), F.lit(-1).cast("long"), F.lit("no image grid")),
        fault(F.col("_s").isNotNull() & (F.col("_n") != cells), F.col("_s"), F.concat(F.lit("image tokens differ: expected "), cells.cast("string"), F.lit(", found "), F.col("_n").cast("string"))),
        fault(F.col("_s2").isNotNull(), F.col("_s2"), F.lit("more than one image")),
        fault(F.col("_v").isNotNull(), F.col("_v"), F.lit("video isn't supported")),
    ]
    t = t.withColumn("problem", F.array_min(F.array_compact(F.array(*faults)))["text"])
    if strict:
        t = t.withColumn("problem", F.when(F.col("problem").isNotNull(), F.raise_error(F.col("problem")).cast("string")))
    k, fine = F.col("pos") - F.col("_s"), F.col("problem").isNull()
    moved = F.when(F.col("pos") >= F.col("_s") + F.col("_n"), F.col("pos") - F.col("_n") + span).otherwise(F.col("pos"))
    at = lambda v: F.when(fine, F.when(in_first, F.col("_s") + F.floor(v)).otherwise(moved)).cast("int")
    delta = F.when(fine, F.when(F.col("_s").isNull(), 0).otherwise(span - F.col("_n"))).cast("int")
    places = {"p_t": k / (F.col("_h") * F.col("_w")), "p_h": k % (F.col("_h") * F.col("_w")) / F.col("_w"), "p_w": k % F.col("_w")}
    return t.select(*tokens.columns, *[at(v).alias(a) for a, v in places.items()], delta.alias("delta"), "problem")
