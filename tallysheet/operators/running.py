"""A10: the mean confidence of an engine as it runs, call by call.

A usable result counts; one without text is folded into the mean without being
counted, so the mean depends on the order of calls. With n results counted so
far and S = n times the mean, a usable result of confidence c takes S to S + c,
and one without text takes it to S (n - 1) / n + c: both are affine in S, and
affine maps compose. So the calls are range-partitioned in their order, every
partition composes its own maps, a few numbers a partition say where each
begins, and no engine is gathered in one task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallysheet.functions.text import strip
from tallysheet.sources.shared import written

ORDER = ("engine_name", "ts", "event_id")
COMPOSED = "engine_name string, part int, event_id bigint, ts timestamp, counted bigint, scale double, shift double"
STARTS = "engine_name string, part int, start double"


def compose(rows: pd.DataFrame) -> pd.DataFrame:
    """One partition's calls of one engine in order (``folded, adds, counted, confidence``): each with the map from the sum before the partition to the sum after the call."""
    rows = rows.sort_values(["ts", "event_id"])
    scale, shift = np.empty(len(rows)), np.empty(len(rows))
    a, b = 1.0, 0.0
    for k, (folded, adds, n, c) in enumerate(zip(rows["folded"], rows["adds"], rows["counted"], rows["confidence"], strict=True)):
        if folded and n:
            keep = 1.0 if adds else (n - 1) / n
            a, b = a * keep, b * keep + c
        scale[k], shift[k] = a, b
    return rows.assign(scale=scale, shift=shift)[["engine_name", "part", "event_id", "ts", "counted", "scale", "shift"]]


def begin(maps: pd.DataFrame) -> pd.DataFrame:
    """The sum with which each partition of an engine begins, from the maps of the partitions before; one row a partition."""
    maps, total, starts = maps.sort_values("part"), 0.0, []
    for a, b in zip(maps["scale"], maps["shift"], strict=True):
        starts.append(total)
        total = a * total + b
    return maps.assign(start=starts)[["engine_name", "part", "start"]]


def running_means(calls: DataFrame) -> DataFrame:
    """One row per call: ``engine_name, event_id, successful_calls, average_confidence`` as they stand after it.

    Calls that failed change nothing; before the first usable result the mean is
    0. Calls stand in the order of ``ts`` and ``event_id``. A null confidence
    counts as 0. No calls, no rows.
    """
    spark = calls.sparkSession
    ran = F.col("error_message").isNull()
    rows = calls.select(*ORDER, F.coalesce("confidence", F.lit(0.0)).alias("confidence"), ran.alias("folded"), (ran & F.coalesce(strip(F.col("text")) != "", F.lit(False))).alias("adds"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(rows.repartitionByRange(parts, *ORDER).withColumn("part", F.spark_partition_id()))
    # At most one row for each partition and each engine, for an engine fills neighbouring partitions.
    counts = dealt.groupBy("engine_name", "part").agg(F.count_if("adds").alias("own"))
    before = Window.partitionBy("engine_name").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.col("engine_name").alias("e"), F.col("part").alias("p"), F.coalesce(F.sum("own").over(before), F.lit(0)).alias("earlier"))
    within = Window.partitionBy("engine_name", "part").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    numbered = dealt.join(counts, F.col("engine_name").eqNullSafe(F.col("e")) & (F.col("part") == F.col("p")))
    numbered = numbered.withColumn("counted", F.col("earlier") + F.count_if("adds").over(within)).drop("e", "p", "earlier")
    composed = written(numbered.groupBy("engine_name", "part").applyInPandas(compose, COMPOSED))
    last = F.max_by(F.struct("scale", "shift"), F.struct("ts", "event_id")).alias("m")
    starts = composed.groupBy("engine_name", "part").agg(last).select("engine_name", "part", "m.*").groupBy("engine_name").applyInPandas(begin, STARTS)
    starts = starts.select(F.col("engine_name").alias("e"), F.col("part").alias("p"), "start")
    done = composed.join(starts, F.col("engine_name").eqNullSafe(F.col("e")) & (F.col("part") == F.col("p")))
    mean = F.coalesce(F.try_divide(F.col("scale") * F.col("start") + F.col("shift"), F.col("counted").cast("double")), F.lit(0.0))
    return done.select("engine_name", "event_id", F.col("counted").alias("successful_calls"), mean.alias("average_confidence"))
