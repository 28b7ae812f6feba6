"""First-wins and early exit over a stream of files against the same over the whole table."""

import os
import random

import pytest
from pyspark.sql import functions as F

from tallysheet.sources import relations as R
from tallysheet.streaming import search

CALLS = "image_id long, engine_name string, ts timestamp, event_id long, text string, confidence double, processing_time double, error_message string"
DETECTIONS = "image_id long, data string, region string, region_rank int, ts timestamp, seq long"


def streamed(spark, rows, ddl, f, folder, name, parts=12):
    """What ``f`` gives for rows that arrive in files, each a little out of order, with one far later at the end."""
    source, rnd = str(folder / "in"), random.Random(2)
    held = rows.orderBy("ts").toPandas()
    order = sorted(range(len(held)), key=lambda k: k + rnd.randrange(len(held) // 400 + 2))
    held = held.iloc[order].reset_index(drop=True)
    size = -(-len(held) // parts)
    for k in range(parts):
        spark.createDataFrame(held.iloc[k * size : (k + 1) * size], ddl).coalesce(1).write.mode("append").parquet(f"{source}/{k:03}")
    last = held.iloc[[0]].assign(ts=held["ts"].max() + (held["ts"].max() - held["ts"].min()), image_id=-1)
    for k in (parts, parts + 1):
        spark.createDataFrame(last, ddl).coalesce(1).write.parquet(f"{source}/{k:03}")
    # Files are taken in the order of their times.
    for k in range(parts + 2):
        for file in os.listdir(f"{source}/{k:03}"):
            os.utime(f"{source}/{k:03}/{file}", (1_700_000_000 + k * 10, 1_700_000_000 + k * 10))
    stream = f(spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(f"{source}/*"))
    query = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(folder / "state")).trigger(availableNow=True).start()
    query.awaitTermination(240)
    return spark.table(name).where("image_id >= 0"), query


@pytest.fixture
def calls(spark):
    d = "/root/testdata/sf0.001"
    if os.path.isdir(d):
        return R.engine_calls(spark, d).select(*[c.split()[0] for c in CALLS.split(", ")])
    return spark.range(600).select(
        (F.col("id") % 5).alias("image_id"), F.concat(F.lit("e"), F.col("id") % 3).alias("engine_name"), (F.lit("2024-01-01").cast("timestamp") + F.make_interval(mins=F.col("id").cast("int"))).alias("ts"), F.col("id").alias("event_id"),
        F.when(F.col("id") % 7 == 0, " ").otherwise("t").alias("text"), ((F.col("id") * 37 % 101) / 100).alias("confidence"), F.lit(1.0).alias("processing_time"), F.when(F.col("id") % 9 == 0, "x").alias("error_message"),
    )


def same(a, b):
    return sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_early_exit(spark, calls, tmp_path):
    f = lambda df: search.until_confident(df, 0.6, "6 hours", "2 hours")
    got, query = streamed(spark, calls, CALLS, f, tmp_path, "exit")
    want = search.until_confident_so_far(calls, 0.6, "6 hours")
    assert want.count() < calls.count() and same(got, want)
    # When the watermark has passed a window its state is gone: but for the far later row nothing is left.
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 1


def test_first_wins(spark, calls, tmp_path):
    rows = calls.select("image_id", F.concat(F.lit("d"), F.col("event_id") % 4).alias("data"), F.concat(F.lit("r"), F.col("event_id") % 3).alias("region"), (F.col("event_id") % 3).cast("int").alias("region_rank"), "ts", F.col("event_id").alias("seq"))
    f = lambda df: search.first_wins(df, "6 hours", "2 hours")
    got, query = streamed(spark, rows, DETECTIONS, f, tmp_path, "wins")
    want = f(rows)
    assert want.agg(F.max("seen")).first()[0] > 1 and same(got, want)
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 1


def test_only_what_can_matter_is_kept():
    rows = [[3, 1, "a", 0.1, False], [1, 2, "b", 0.2, False], [2, 3, "c", 0.9, True], [5, 4, "d", 0.95, True]]
    assert search.kept(rows) == [rows[1], rows[2]]
    assert search.kept(rows[:2]) == [rows[1], rows[0]] and search.kept([]) == []
