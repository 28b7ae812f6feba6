"""Files: image scans, validation, attributes of QR files, sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SUFFIXES = (".jpg", ".jpeg", ".png", ".pdf")
MOST_BYTES = 50 * 1024 * 1024


def scan(spark: SparkSession, folder: str, glob: str = "*", recursive: bool = True) -> DataFrame:
    """Paths, sizes and times of the files of a folder. Contents are read only if a query asks for them."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower()).load(folder)


def checked(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """S3: files that pass (known suffix, size within bounds), and those that don't with the reason."""
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1))
    reason = F.when(~suffix.isin(*SUFFIXES), F.concat(F.lit("unsupported suffix "), suffix)).when(F.col("length") > MOST_BYTES, F.lit("too large"))
    rows = files.withColumns({"suffix": suffix, "error": reason, "file_size_mb": F.col("length") / (1024 * 1024)})
    return rows.where("error IS NULL").drop("error"), rows.where("error IS NOT NULL").select("path", "length", "error")


def images(spark: SparkSession, folder: str, drop_invalid: bool = True) -> DataFrame:
    """Decoded images by Spark's image source (``image`` struct; bytes in blue, green, red order)."""
    return spark.read.format("image").option("dropInvalid", str(drop_invalid).lower()).load(folder)


def in_memory(spark: SparkSession, pictures: list[tuple[int, list[list[int]]]]) -> DataFrame:
    """Grey images given as lists of rows."""
    from tallysheet.schemas import RASTERS

    return spark.createDataFrame([(k, len(p), len(p[0]) if p else 0, [v for row in p for v in row]) for k, p in pictures], RASTERS)


def with_source(codes: DataFrame, files: DataFrame) -> DataFrame:
    """Codes (``path``) with the file they came from and its time of modification in seconds."""
    meta = files.select("path", F.unix_micros("modificationTime").alias("us"))
    return codes.join(meta, "path").withColumn("extraction_timestamp", F.col("us") / 1e6).withColumnRenamed("path", "source_file").drop("us")


def write(frame: DataFrame, path: str, mode: str = "errorifexists", by: tuple[str, ...] = ()) -> None:
    """Results, rasters and payloads as Parquet."""
    frame.write.mode(mode).partitionBy(*by).parquet(path)
