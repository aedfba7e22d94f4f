"""Bounded, deterministic samples of labelled rows for fitting a classifier."""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(id_col: str = "doc_id") -> Column:
    """True for rows that are never learnt from: crc32 of the id as text is a multiple of 5 (a null id: false)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def is_held_out(x) -> bool:
    return x is not None and zlib.crc32(str(x).encode()) % 5 == 0


def sample_ids(labels: DataFrame, label: str, most: int, id_col: str = "doc_id") -> list[tuple[int, int]]:
    """Up to ``most`` (id, label) of each label 0 and 1 from the learning rows, by the hash of their id."""
    known = labels.where(F.col(label).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(id_col).agg(F.max(label).alias("y"))
    order = [F.xxhash64(F.col(id_col)), F.col(id_col)]
    return [(r[0], int(r[1])) for v in (0, 1) for r in known.where(F.col("y") == v).orderBy(*order).limit(most).collect()]


def sample_rows(docs: DataFrame, ids: list[tuple[int, int]], columns: list, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The sampled rows' columns and their label ``y``; one scan with a broadcast of the sampled ids.

    One row an id, that of the smallest text hash, so the sample is as many rows as ids, however often an id repeats.
    """
    spark = docs.sparkSession
    small = spark.createDataFrame(ids, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, y int")
    rows = docs.select(id_col, F.struct(*columns).alias("_row"), F.xxhash64(text).alias("_h"))  # no other column can clash
    found = rows.join(F.broadcast(small), id_col)
    return found.groupBy(id_col, "y").agg(F.min_by("_row", "_h").alias("_row")).select(id_col, "y", "_row.*")
