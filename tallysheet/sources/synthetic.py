"""Made-up inputs: grey test pages, sample assignments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def pages(spark: SparkSession, n: int, height: int = 32, width: int = 48, noise: int = 0, blur: bool = False, seed: int = 7) -> DataFrame:
    """White pages with dark lines of text-like strokes; seeded noise and a flattened contrast if asked for."""
    cells = F.sequence(F.lit(0), F.lit(height * width - 1))

    def grey(k: Column) -> Column:
        r, c = F.floor(k / width), k % width
        ink = (r % 8 < 2) & ((c * 7 + r * 3 + F.col("id")) % 5 < 3)
        v = F.when(ink, F.lit(150 if blur else 20)).otherwise(F.lit(180 if blur else 250)).cast("long")
        if noise:
            v = v + F.pmod(F.xxhash64(F.lit(seed), F.col("id"), k), F.lit(2 * noise + 1)) - noise
        return F.least(F.greatest(v, F.lit(0).cast("long")), F.lit(255).cast("long")).cast("int")

    return spark.range(n).select(F.col("id").alias("image_id"), F.lit(height).alias("height"), F.lit(width).alias("width"), F.transform(cells, grey).alias("pixels"))


#: S20. The fields of the sample assignment. Fixed values.
SAMPLE = ("AG_abc12345_123456", "Linear Equations Practice", "algebra1", "Period 3", "Ms. Johnson", "2025-06-20", 100, None, "1.0")


def sample_assignment(spark: SparkSession) -> DataFrame:
    from tallysheet.schemas import ASSIGNMENT_CORE

    return spark.createDataFrame([SAMPLE], ASSIGNMENT_CORE)
