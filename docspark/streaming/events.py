"""Streams of events. Windows with a watermark are Spark's own; the graph's edges are the batch function."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.operators.graph import event_edges


def edge_stream(events: DataFrame) -> DataFrame:
    """graph.event_edges of a stream: write it in update or complete mode."""
    return event_edges(events)


def windowed_counts(events: DataFrame, late: str = "1 hour", width: str = "1 day", slide: str | None = None) -> DataFrame:
    """start, event_type, n, total of each window of event time; rows later than the watermark are dropped by Spark once a window is closed."""
    marked = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return marked.groupBy(F.window("ts", width, slide) if slide else F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def complete_units(parts: DataFrame, late: str = "1 day") -> DataFrame:
    """unit_id, n of units all of whose parts (unit_id, n_parts, ts) have come: write it in update mode."""
    counted = parts.withWatermark("ts", late).groupBy("unit_id", "n_parts").agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") == F.col("n_parts")).select("unit_id", "n")
