"""Document inputs derived from the tables at hand, as DataFrames and as DuckDB expressions.

``detections`` come from lineitem by integer arithmetic (one page per order), ``regions`` from
the lines of documents, with markers put in by rule so that every formatting case occurs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_DET = {
    "page_id": "l_orderkey",
    "class_id": "CAST(l_partkey % 26 AS INT)",
    "score": "CAST((l_partkey * 31 + l_suppkey * 17 + l_linenumber) % 101 AS FLOAT) / CAST(100 AS FLOAT)",
    "x1": "CAST(l_partkey % 4 * 100 AS INT)",
    "y1": "CAST(l_suppkey % 4 * 100 - 50 * (CASE WHEN l_suppkey % 50 = 0 THEN 1 ELSE 0 END) AS INT)",
    "x2": "CAST(l_partkey % 4 * 100 + (CAST(l_quantity AS BIGINT) % 10) * 90 AS INT)",
    "y2": "CAST(l_suppkey % 4 * 100 + 100 + (CAST(l_quantity AS BIGINT) % 7) * 140 AS INT)",
    "order_seq": "CASE WHEN l_orderkey % 3 = 0 THEN NULL ELSE CAST(l_suppkey % 5 AS INT) END",
}


def detections(spark: SparkSession, sf_dir: str, class_id: str = _DET["class_id"]) -> DataFrame:
    """(page_id, det_idx, class_id, score, bbox, order_seq); some boxes are invalid on purpose."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    rows = table(spark, sf_dir, "lineitem").withColumn("det_idx", (F.row_number().over(w) - 1).cast("int"))
    cols = {k: F.expr(v) for k, v in (_DET | {"class_id": class_id}).items()}
    return rows.select(
        cols["page_id"].alias("page_id"),
        "det_idx",
        cols["class_id"].alias("class_id"),
        cols["score"].cast("float").alias("score"),
        F.struct(*[cols[c].alias(c) for c in ("x1", "y1", "x2", "y2")]).alias("bbox"),
        cols["order_seq"].alias("order_seq"),
    )


#: The same, flat (x1 .. y2), as a common table expression.
SQL_DETECTIONS = (
    "det AS (SELECT CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS INT) AS det_idx, "
    + ", ".join(f"{v} AS {k}" for k, v in _DET.items())
    + " FROM lineitem)"
)

_LABEL = """CASE WHEN pos = 0 THEN 'doc_title' WHEN (doc_id + pos) % 11 = 1 THEN 'paragraph_title' WHEN (doc_id + pos) % 13 = 2 THEN 'display_formula'
 WHEN (doc_id + pos) % 13 = 3 THEN 'formula_number' WHEN (doc_id + pos) % 17 = 4 THEN 'image' WHEN (doc_id + pos) % 19 = 5 THEN 'algorithm'
 WHEN (doc_id + pos) % 23 = 6 THEN 'footer' WHEN (doc_id + pos) % 29 = 7 THEN 'mystery' ELSE 'text' END"""
_CONTENT = r"""CASE WHEN label = 'image' THEN NULL WHEN label = 'formula_number' THEN concat('(', CAST(pos AS VARCHAR(9)), ')')
 WHEN label = 'display_formula' THEN CASE doc_id % 4 WHEN 0 THEN concat('$$ ', line, ' $$') WHEN 1 THEN concat('\[', line, '\]') WHEN 2 THEN concat('\(', line, '\)') ELSE line END
 WHEN label = 'doc_title' THEN concat('## ', line) WHEN label = 'paragraph_title' THEN concat('- #', line)
 WHEN label = 'algorithm' THEN CASE doc_id % 3 WHEN 0 THEN concat('```html', line, '<a/>') WHEN 1 THEN concat('```html<body>', line) ELSE concat('```html', line) END
 WHEN (doc_id * 7 + pos) % 31 = 1 THEN concat('· ', line) WHEN (doc_id * 7 + pos) % 31 = 2 THEN concat('(a)', line) WHEN (doc_id * 7 + pos) % 31 = 3 THEN concat('（12）', line)
 WHEN (doc_id * 7 + pos) % 31 = 4 THEN concat('3）', line) WHEN (doc_id * 7 + pos) % 31 = 5 THEN concat('\t\t  ', line, '.....\t') WHEN (doc_id * 7 + pos) % 31 = 6 THEN concat(line, '____\_\_\_\_\_x')
 WHEN (doc_id * 7 + pos) % 31 = 7 THEN '   ' WHEN (doc_id * 7 + pos) % 31 IN (8, 10) THEN concat('- ', line) WHEN (doc_id * 7 + pos) % 31 = 12 THEN concat(line, ' inter- ')
 WHEN (doc_id * 7 + pos) % 31 = 14 THEN concat('national ', line) WHEN (doc_id * 7 + pos) % 31 = 15 THEN concat('* ', line) WHEN (doc_id * 7 + pos) % 31 = 16 THEN concat(line, chr(10), 'second', chr(10), chr(10), 'third')
 ELSE line END"""
_BOX = {
    "x1": "CAST(100 + (doc_id * 3 + pos * 5) % 12 AS INT)",
    "y1": "CAST(pos % 40 * 20 AS INT)",
    "x2": "CAST(600 + pos % 300 AS INT)",
    "y2": "CAST(pos % 40 * 20 + 18 AS INT)",
}
#: Lines of a page of a derived document.
PAGE = 40


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, page_index, idx, native_label, bbox, content) from the lines of documents."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    rows = lines.withColumn("label", F.expr(_LABEL)).withColumn("content", F.expr(_CONTENT.replace("\\", "\\\\").replace("VARCHAR(9)", "STRING")))
    box = F.struct(*[F.expr(v).alias(k) for k, v in _BOX.items()])
    return rows.select("doc_id", F.expr(f"CAST(pos div {PAGE} AS INT)").alias("page_index"), F.expr(f"CAST(pos % {PAGE} AS INT)").alias("idx"), F.col("label").alias("native_label"), box.alias("bbox"), "content")


SQL_REGIONS = (
    "ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents), "
    f"lb AS (SELECT *, {_LABEL} AS label FROM ln), "
    f"reg AS (SELECT doc_id, CAST(pos // {PAGE} AS INT) AS page_index, CAST(pos % {PAGE} AS INT) AS idx, label AS native_label, "
    + ", ".join(f"{v} AS {k}" for k, v in _BOX.items())
    + f", {_CONTENT} AS content FROM lb)"
)
