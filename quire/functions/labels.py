"""Fixed dimension values of the layout model: labels, tasks, kinds and merge modes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Class ids 0 .. 24 in order.
CLASSES = [
    "abstract", "algorithm", "aside_text", "chart", "content", "display_formula", "doc_title", "figure_title", "footer",
    "footer_image", "footnote", "formula_number", "header", "header_image", "image", "inline_formula", "number",
    "paragraph_title", "reference", "reference_content", "seal", "table", "text", "vertical_text", "vision_footnote",
]
# The labels of each task; any other label is abandoned.
TASKS = {
    "text": ["abstract", "algorithm", "content", "doc_title", "figure_title", "paragraph_title", "reference_content", "text", "vertical_text", "vision_footnote", "seal", "formula_number"],
    "table": ["table"],
    "formula": ["display_formula", "inline_formula", "formula"],
    "skip": ["chart", "image"],
    "abandon": ["header", "footer", "number", "footnote", "aside_text", "reference", "footer_image", "header_image"],
}
# Kinds differ from tasks only for skipped labels; any other label is unknown.
KIND_OF_TASK = {"text": "text", "table": "table", "formula": "formula", "skip": "image"}
#: Fixed value: the one class whose containers go and contents stay; in all others containers stay.
SMALL_CLASS = 18
#: Classes that are never removed for being contained.
PRESERVED = ["image", "seal", "chart"]
IMAGE_CLASS = 14

LABELS = [(label, task, KIND_OF_TASK.get(task, "unknown")) for task, labels in TASKS.items() for label in labels]


def dim_class(spark: SparkSession) -> DataFrame:
    rows = [(i, x, "small" if i == SMALL_CLASS else "large") for i, x in enumerate(CLASSES)]
    return spark.createDataFrame(rows, "class_id int, native_label string, merge_mode string")


def dim_label(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LABELS, "native_label string, task string, kind string")


def kind_of(label: Column) -> Column:
    """Label -> kind, ``unknown`` for any other label."""
    out = F.lit("unknown")
    for task, labels in TASKS.items():
        if task in KIND_OF_TASK:
            out = F.when(label.isin(labels), KIND_OF_TASK[task]).otherwise(out)
    return out


def task_of(label: Column) -> Column:
    """Label -> task, ``abandon`` for any other label."""
    out = F.lit("abandon")
    for task, labels in TASKS.items():
        out = F.when(label.isin(labels), task).otherwise(out)
    return out


def label_of(class_id: Column) -> Column:
    """Class id -> label, ``class_<id>`` for any other id."""
    known = F.create_map(*[F.lit(x) for pair in enumerate(CLASSES) for x in pair])
    return F.coalesce(F.try_element_at(known, class_id.cast("int")), F.concat(F.lit("class_"), class_id.cast("string")))


def named(class_id: Column) -> Column:
    """Class id -> struct<native_label, task, kind>, as the three functions above give them, by one look into a fixed array."""
    parts = lambda label, task, kind: F.struct(label.alias("native_label"), F.lit(task).alias("task"), F.lit(kind).alias("kind"))
    of = {label: (task, kind) for label, task, kind in LABELS}
    known = F.array(*[parts(F.lit(x), *of[x]) for x in CLASSES])
    return F.coalesce(F.get(known, class_id.cast("int")), parts(F.concat(F.lit("class_"), class_id.cast("string")), "abandon", "unknown"))


def sql_dims() -> str:
    """The dimensions as common table expressions for DuckDB."""
    classes = ", ".join(f"({i}, '{x}', '{'small' if i == SMALL_CLASS else 'large'}')" for i, x in enumerate(CLASSES))
    labels = ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in LABELS)
    return f"dim_class(class_id, native_label, merge_mode) AS (VALUES {classes}), dim_label(native_label, task, kind) AS (VALUES {labels})"
