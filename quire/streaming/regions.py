"""Regions that arrive as files, formatted page by page. An extension: the batch operators do the work."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from quire.operators import formatting

SCHEMA = "doc_id long, page_index int, idx int, native_label string, bbox struct<x1: int, y1: int, x2: int, y2: int>, content string"


def format_stream(spark: SparkSession, source: str, sink: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Each micro-batch of region files becomes Markdown pages under ``sink``; a page must arrive in one file.

    Batches are written under their number, so that one that is run again replaces itself.
    """

    def write(batch: DataFrame, number: int) -> None:
        formatting.page_markdown(formatting.format_regions(batch)).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    rows = spark.readStream.schema(SCHEMA).parquet(source)
    writer = rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
