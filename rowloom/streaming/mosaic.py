"""The tile mosaic as a stream: rows of the raster are finished when the watermark of row offsets has passed them.

Row offsets stand for event time (a second a row), so that the state holds only the stripe of rows that
later tiles can still reach.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.operators.raster import triangle_weight


def blend_stream(predicted: DataFrame, size: int) -> DataFrame:
    """(row, col, p) of tile predictions (row, col, row_off, col_off, p), in any output mode; see raster.blend()."""
    w = F.greatest(F.lit(1e-4), triangle_weight(F.col("row") - F.col("row_off"), size) * triangle_weight(F.col("col") - F.col("col_off"), size))
    timed = predicted.withColumn("w", w).withColumn("at", F.timestamp_seconds(F.col("row"))).withWatermark("at", f"{size} seconds")
    s = timed.groupBy("at", "row", "col").agg(F.sum(F.col("p") * F.col("w")).alias("a"), F.sum("w").alias("b"))
    return s.select("row", "col", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("a") / F.greatest("b", F.lit(1e-8)))).alias("p"))
