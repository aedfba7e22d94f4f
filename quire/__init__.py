"""Document dataflow on Spark: detections to ordered, formatted, evaluated documents."""
