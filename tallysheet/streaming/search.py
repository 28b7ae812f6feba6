"""O5 and O7 over streams: the first of equal payloads, and engines up to the first confident one.

Both wait for the watermark, since a result that comes late may still stand
before another; both keep what can matter alone, and nothing once the watermark
has passed the window: a payload keeps its first detection, an image its results
up to the earliest confident one so far.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tallysheet.functions.text import strip

FOUND = "image_id bigint, window_end timestamp, event_id bigint, engine_name string, confidence double"
KEPT = "pending string"


def first_wins(detections: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """O5 by window: of equal payloads (``image_id, data``) the first by region, then by time and sequence."""
    first = F.min_by(F.struct("seq", "region"), F.struct("region_rank", "ts", "seq"))
    out = detections.withWatermark("ts", late).groupBy(F.window("ts", window), "image_id", "data").agg(first.alias("f"), F.count("*").alias("seen"))
    return out.select(F.col("window.end").alias("window_end"), "image_id", "data", F.col("f.seq").alias("seq"), F.col("f.region").alias("region"), "seen")


def _rows(calls: DataFrame, enough: float, window: str) -> DataFrame:
    sure = F.col("error_message").isNull() & (strip(F.col("text")) != "") & (F.col("confidence") >= enough)
    return calls.select("image_id", F.window("ts", window)["end"].alias("window_end"), "ts", "event_id", "engine_name", "confidence", F.coalesce(sure, F.lit(False)).alias("sure"))


def until_confident_so_far(calls: DataFrame, enough: float = 0.9, window: str = "1 hour") -> DataFrame:
    """The same as a batch: of each image and window the results in order of time up to the first confident one."""
    before = Window.partitionBy("image_id", "window_end").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = _rows(calls, enough, window).withColumn("done", F.coalesce(F.max("sure").over(before), F.lit(False)))
    return rows.where("NOT done").select("image_id", "window_end", "event_id", "engine_name", "confidence")


def kept(rows: list[list]) -> list[list]:
    """Results in order up to the first confident one; whatever comes later cannot bring back those behind it."""
    rows = sorted(rows)
    sure = next((k for k, r in enumerate(rows) if r[-1]), len(rows))
    return rows[: sure + 1]


def search(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    image_id, end = key
    pending = json.loads(state.get[0]) if state.exists else []
    if state.hasTimedOut:
        state.remove()
        yield pd.DataFrame([(image_id, end, number, engine, confidence) for _, number, engine, confidence, _ in pending], columns=["image_id", "window_end", "event_id", "engine_name", "confidence"])
        return
    for f in frames:
        new = zip(f["at"].tolist(), f["event_id"].tolist(), f["engine_name"].tolist(), f["confidence"].tolist(), f["sure"].tolist(), strict=True)
        pending = kept(pending + [list(r) for r in new])
    state.update((json.dumps(pending),))
    state.setTimeoutTimestamp(int(pd.Timestamp(end).timestamp() * 1000))


def until_confident(calls: DataFrame, enough: float = 0.9, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """O7 over a stream: :func:`until_confident_so_far` of each image and window, given out when the watermark passes its end."""
    rows = _rows(calls.withWatermark("ts", late), enough, window).withColumn("at", F.unix_micros("ts"))
    return rows.groupBy("image_id", "window_end").applyInPandasWithState(search, FOUND, KEPT, "append", GroupStateTimeout.EventTimeTimeout)
