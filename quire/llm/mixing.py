"""Mixing sources to target weights by weighted fair queueing.

Each source is a queue of its shuffled documents, served again from the start after the last.
A served document gets its virtual finish time, the source's cumulative tokens divided by its weight;
the mix is the global order by virtual time, truncated at the total budget. Sources run out
after ``repeats`` rounds, so the rest of the budget falls to the others by weight, which is
what the targets state in closed form.

Both cumulative sums (of a source, and of the global order) are two-level: rows are dealt to
many ranges of the shuffle key or of virtual time, each range is summed, and rows are summed
inside their range only. A source with a third of all rows spreads over as many tasks as any.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize

#: Whatever stands between white space; the pattern's text is the contract's.
TOKEN = r"[^\x20\x09-\x0D]+"
#: Sources are broadcast up to this many, else joined by a shuffle.
SOURCES = 100_000


def size_of(text: Column) -> Column:
    """The number of tokens; null is 0."""
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: list[float], share: float, repeats: int) -> DataFrame:
    """(source, weight, source_size, target) from rows of (source, size).

    Weights go round by the sources' order by code point, null last. Targets share ``share``
    of all tokens by weight, but none exceeds ``repeats`` times its source: whoever would is
    set to that, and the excess goes to the others by weight until none is above.
    """
    per = materialize(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    # Sources are few next to rows, but unbounded: they are numbered by range, not in one task.
    parts = materialize(per.repartitionByRange(F.col("source").asc_nulls_last()).sortWithinPartitions(F.col("source").asc_nulls_last()).withColumn("p", F.spark_partition_id()), "sources")
    w = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    before = parts.groupBy("p").count().withColumn("before", F.coalesce(F.sum("count").over(w), F.lit(0))).select("p", "before")
    number = F.row_number().over(Window.partitionBy("p").orderBy(F.col("source").asc_nulls_last())) - 1
    ranked = parts.withColumn("i", number).join(F.broadcast(before), "p").withColumn("i", F.col("i") + F.col("before"))
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod("i", F.lit(len(weights))) + 1).cast("int"))
    ranked = materialize(ranked.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * repeats).alias("cap")), "sources")
    budget = share * (ranked.agg(F.sum("source_size")).first()[0] or 0)
    level, capped = None, 0
    while True:
        full = F.lit(False) if level is None else F.col("cap") <= F.col("weight") * level
        n, cap, rest = ranked.select(full.alias("f"), "cap", "weight").agg(F.count_if("f"), F.sum(F.when(F.col("f"), F.col("cap"))), F.sum(F.when(~F.col("f"), F.col("weight")))).first()
        if level is not None and n == capped or not rest:
            break
        level, capped = (budget - (cap or 0)) / rest, n
    discard(per, parts)
    target = F.col("cap").cast("double") if level is None else F.least(F.col("cap").cast("double"), F.col("weight") * F.lit(level))
    return ranked.select("source", "weight", "source_size", target.alias("target"))


def _rows(docs: DataFrame, id_col: str, text: str, source: str) -> list:
    """The place of a row in its source's shuffle, (m, h), and its source."""
    h = F.xxhash64(F.col(text))
    return [F.col(source).alias("source"), F.coalesce(F.md5(F.col(id_col).cast("string")), F.md5(h.cast("string"))).alias("m"), h.alias("h")]


def plan(rows: DataFrame, weights: list[float], share: float = 1.5, repeats: int = 2) -> DataFrame:
    """(source, source_size, target, last): what the mix takes of each source, from rows (source, m, h, size).

    last has the last place (m, h) that is taken in each of ``repeats`` rounds, null for none.
    """
    cells = rows.withColumn("_k", F.conv(F.substring("m", 1, 3), 16, 10).cast("int"))
    per = targets(rows.select("source", "size"), weights, share, repeats)
    w = Window.partitionBy("source").orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.groupBy("source", "_k").agg(F.sum("size").alias("s")).select("source", "_k", F.coalesce(F.sum("s").over(w), F.lit(0)).alias("_start")).toDF("_s", "_j", "_start")
    inner = Window.partitionBy("source", "_k").orderBy("m", "h").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    queued = (
        cells.withColumn("_sum", F.sum("size").over(inner))
        .join(starts, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_k") == F.col("_j")))
        .join(_small(per.select(F.col("source").alias("_s2"), "weight", "source_size")), F.col("source").eqNullSafe(F.col("_s2")))
        .select("source", "m", "h", "size", "weight", "source_size", (F.col("_start") + F.col("_sum")).alias("_end"))
    )
    queued = materialize(queued, "queued")
    finish = [(F.col("_end") + F.col("source_size") * r) / F.col("weight") for r in range(repeats)]
    served = queued.where("size > 0").select("size", F.explode(F.array(*finish)).alias("v"))
    cut = _cut(served, share * (rows.agg(F.sum("size")).first()[0] or 0))
    last = queued.groupBy("source").agg(F.array(*[F.max(F.when(v <= cut, F.struct("m", "h"))) for v in finish]).alias("last"))
    out = materialize(per.join(last.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).select("source", "source_size", "target", "last"), "plan")
    discard(queued, per)
    return out


def _small(per: DataFrame) -> DataFrame:
    """A table of sources, to be broadcast if it is small."""
    return F.broadcast(per) if per.count() <= SOURCES else per


def _copies(repeats: int = 2):
    """How often the mix takes a row."""
    here = F.struct("m", "h")
    return sum(F.when(here <= F.get("last", F.lit(r)), 1).otherwise(0) for r in range(repeats))


def _cut(served: DataFrame, budget: float) -> float:
    """The last virtual time of the global order whose cumulative size fits the budget; equal times go together.

    The order is range-sorted; ranges are summed, and only the range where the sum crosses the
    budget is summed row by row.
    """
    ranges = served.where("size > 0").select("v", "size").repartitionByRange("v").sortWithinPartitions("v").withColumn("p", F.spark_partition_id())
    ranges = materialize(ranges, "ranges")
    before, cut = 0, -1.0
    for r in sorted(ranges.groupBy("p").agg(F.sum("size").alias("s"), F.max("v").alias("hi")).collect(), key=lambda r: r.p):
        if before + r.s > budget:
            running = F.sum("size").over(Window.partitionBy("p").orderBy("v").rangeBetween(Window.unboundedPreceding, 0))
            inside = ranges.where(F.col("p") == r.p).withColumn("c", running).where(F.col("c") + before <= budget)
            found = inside.agg(F.max("v")).first()[0]
            cut = cut if found is None else found
            break
        before, cut = before + r.s, r.hi
    discard(ranges)
    return cut


def mix_report(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(id_col, size, source_size, target, taken) of every row, for weights 3, 1, 2 and 150 % of all tokens.

    The shuffle of a source is by the md5 of the id as text (of the text's hash for a null id), then
    by the text's hash, so reruns agree; rows that are equal in both go together. Null sources are
    a source of their own, the last; an empty table gives an empty mix. Other columns are ignored.
    """
    rows = materialize(docs.select(F.col(id_col).alias("id"), *_rows(docs, id_col, text, source), size_of(F.col(text)).alias("size")), "sizes")
    mixed = rows.withColumnRenamed("source", "_s").join(_small(plan(rows, [3, 1, 2])), F.col("_s").eqNullSafe(F.col("source")))
    return mixed.select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("size") * _copies()).cast("long").alias("taken"))


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The rows that the mix takes, with the columns of ``docs``; a row taken twice comes twice.

    Rows without words are taken once. Texts aren't shuffled: a row knows from its place in its
    source's shuffle whether it is taken.
    """
    place = _rows(docs, id_col, text, source)
    rows = materialize(docs.select(*place, size_of(F.col(text)).alias("size")), "sizes")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), *place, F.coalesce(F.col(text).rlike(TOKEN), F.lit(False)).alias("_some"))
    mixed = packed.withColumnRenamed("source", "_s").join(_small(plan(rows, [3, 1, 2])), F.col("_s").eqNullSafe(F.col("source")))
    discard(rows)
    copies = F.when(F.col("_some"), _copies()).otherwise(1)
    return mixed.select("_row", copies.alias("_n")).where("_n > 0").select("_row", F.explode(F.sequence(F.lit(1), F.col("_n")))).select("_row.*")


#: The rows of mix_report in DuckDB.
SQL = """
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5(CAST(doc_id AS VARCHAR)) AS k FROM documents),
src AS (SELECT source, sum(size) AS ss, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM d GROUP BY source),
w AS (SELECT source, CAST(ss AS DOUBLE) AS ss, CASE i % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS wt, 2 * CAST(ss AS DOUBLE) AS cap FROM src),
b AS (SELECT 1.5::DOUBLE * sum(ss) AS budget FROM w),
lv AS (
  SELECT cap / wt AS ratio,
         ((SELECT budget FROM b) - coalesce(sum(cap) OVER (ORDER BY cap / wt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(wt) OVER (ORDER BY cap / wt ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS v
  FROM w),
lvl AS (SELECT arg_min(v, ratio) AS v FROM lv WHERE v < ratio),
t AS (SELECT w.*, least(cap, wt * (SELECT v FROM lvl)) AS target FROM w),
q AS (
  SELECT d.*, t.ss, t.wt, t.target, sum(size) OVER (PARTITION BY d.source ORDER BY k NULLS LAST, size ROWS UNBOUNDED PRECEDING) AS c
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT size, (c + ss * r) / wt AS v FROM q, (VALUES (0), (1)) AS x(r) WHERE size > 0),
cut AS (SELECT max(v) AS v FROM (SELECT v, sum(size) OVER (ORDER BY v RANGE UNBOUNDED PRECEDING) AS c FROM e) WHERE c <= (SELECT budget FROM b))
SELECT doc_id, size, CAST(ss AS BIGINT) AS source_size, target,
       CAST(size * (CASE WHEN c / wt <= (SELECT v FROM cut) THEN 1 ELSE 0 END
                    + CASE WHEN (c + ss) / wt <= (SELECT v FROM cut) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM q
"""
