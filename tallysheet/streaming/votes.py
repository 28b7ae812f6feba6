"""Engine results as a stream: an extension, the batch operators' counterparts over event time.

State is bounded by the watermark: an image's results are aggregated in a
window of event time and dropped once the watermark has passed it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallysheet.functions.text import strip


def engine_totals(calls: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """A10 by window: calls, usable results, time and mean confidence of each engine."""
    good = F.col("error_message").isNull() & (strip(F.col("text")) != "")
    rows = calls.withWatermark("ts", late).groupBy(F.window("ts", window), "engine_name")
    out = rows.agg(F.count("*").alias("total_calls"), F.count_if(good).alias("successful_calls"), F.sum("processing_time").alias("total_time"), F.avg(F.when(good, F.col("confidence"))).alias("average_confidence"))
    return out.select(F.col("window.start").alias("window_start"), "engine_name", "total_calls", "successful_calls", "total_time", "average_confidence")


def votes(calls: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """A1, A2 by image and window: the most confident text and the self-weighted confidence."""
    good = calls.where(F.col("error_message").isNull() & (strip(F.col("text")) != ""))
    c = F.col("confidence")
    best = F.min_by(F.struct("text", "engine_name"), F.struct((-c).alias("c"), "engine_name"))
    out = good.withWatermark("ts", late).groupBy(F.window("ts", window), "image_id").agg(best.alias("b"), (F.sum(c * c) / F.nullif(F.sum(c), F.lit(0.0))).alias("confidence"))
    return out.select(F.col("window.start").alias("window_start"), "image_id", F.col("b.text").alias("text"), F.col("b.engine_name").alias("engine_name"), "confidence")
