from pyspark.sql import functions as F

from tallysheet.streaming import votes

DDL = "image_id long, engine_name string, ts timestamp, text string, confidence double, processing_time double, error_message string"


def test_streams_agree_with_batches(spark, tmp_path):
    rows = spark.range(200).select(
        (F.col("id") % 5).alias("image_id"), F.concat(F.lit("e"), F.col("id") % 3).alias("engine_name"), (F.lit("2024-01-01").cast("timestamp") + F.make_interval(mins=F.col("id").cast("int"))).alias("ts"),
        F.when(F.col("id") % 7 == 0, " ").otherwise("t").alias("text"), ((F.col("id") * 37 % 101) / 100).alias("confidence"), F.lit(1.0).alias("processing_time"), F.when(F.col("id") % 9 == 0, "x").alias("error_message"),
    )
    rows.write.parquet(str(tmp_path / "in"))
    for f in (votes.engine_totals, votes.votes):
        name = f.__name__
        q = f(spark.readStream.schema(DDL).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(60)
        assert sorted(map(str, spark.table(name).collect())) == sorted(map(str, f(rows).collect()))
