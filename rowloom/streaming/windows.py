"""Sliding windows over an event stream, and the same over a batch."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def sliding_counts(events: DataFrame, size: str, slide: str) -> DataFrame:
    """(window_start, event_type, n, total) of rows with ts, event_type and value, a stream or a batch."""
    w = F.window("ts", size, slide)
    g = events.groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def run_to_end(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """All that a streaming query gives over what its source holds now."""
    name = f"stream_{uuid.uuid4().hex}"
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)


def event_stream(spark: SparkSession, folder: str, pattern: str = "events.parquet") -> DataFrame:
    """The events table as a stream, with a watermark of an hour."""
    schema = spark.read.parquet(f"{folder}/{pattern}").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)
    # a watermark needs an instant; results go back to the table's plain time
    return rows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 hour")
