"""QR detections: size and payload checks, first-wins duplicates, early exit by region, payload fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

REQUIRED = ("assignment_id", "assignment_name", "subject")
#: Detection methods in the order they are tried. Fixed values.
METHOD_ORDER = ("pyzbar", "opencv")


def right_size(detections: DataFrame, least: int = 50, most: int = 500) -> DataFrame:
    """The longer side is within bounds."""
    return detections.where(F.greatest("w", "h").between(least, most))


def has_keys(data: Column, keys: tuple[str, ...] = REQUIRED) -> Column:
    """A JSON object with all keys; a key with a null value counts as present."""
    held = F.json_object_keys(data)
    return F.coalesce(F.forall(F.array(*map(F.lit, keys)), lambda k: F.array_contains(held, k)), F.lit(False))


def has_prefix(data: Column, prefix: str = "AG") -> Column:
    """P8, and the id begins with the prefix."""
    return has_keys(data) & F.coalesce(F.startswith(F.get_json_object(data, "$.assignment_id"), F.lit(prefix)), F.lit(False))


def _method_rank() -> Column:
    return F.coalesce(*[F.when(F.col("method") == m, F.lit(k)) for k, m in enumerate(METHOD_ORDER)], F.lit(len(METHOD_ORDER)))


def first_region(detections: DataFrame, regions: DataFrame) -> DataFrame:
    """Of an image the detections of the first region that has any; give it those of right size."""
    w = Window.partitionBy("image_id").orderBy("region_rank")
    return detections.join(F.broadcast(regions.select("region", "region_rank")), "region").withColumn("__r", F.rank().over(w)).where("__r = 1").drop("__r")


def first_wins(detections: DataFrame) -> DataFrame:
    """Of equal payloads of an image the one detected first, by region, method and sequence.

    A minimum by key, not a sort of all duplicates.
    """
    first = F.min_by(F.struct(*detections.columns), F.struct("region_rank", _method_rank().alias("m"), "seq"))
    return detections.groupBy("image_id", "data").agg(first.alias("f")).select("f.*")


def parsed(detections: DataFrame) -> DataFrame:
    """The payload's fields and the detection's, for valid payloads only."""
    field = lambda k: F.get_json_object("data", f"$.{k}").alias(k)
    return detections.where(has_keys(F.col("data"))).select(
        "image_id", "seq", F.struct(F.struct("x", "y", "w", "h").alias("bbox"), "method", "region", "confidence").alias("qr_detection"), *map(field, REQUIRED), F.get_json_object("data", "$.total_points").cast("int").alias("total_points"), F.lit(True).alias("extraction_success")
    )


def primary(parsed_codes: DataFrame) -> DataFrame:
    """The first successful code of each image."""
    ok = F.col("extraction_success")
    first = F.min_by(F.struct("assignment_id", "assignment_name", "subject", "total_points"), F.when(ok, F.col("seq")))
    return parsed_codes.groupBy("image_id").agg(first.alias("p"), F.count_if(ok).alias("codes")).select("image_id", "codes", "p.*")


def region_boxes(images: DataFrame, regions: DataFrame) -> DataFrame:
    """The pixel rectangle of each region of each image (``width, height``), cut to the image. Regions are a handful."""
    rows = images.crossJoin(F.broadcast(regions))
    at = lambda share, size: F.least(F.greatest(F.floor(F.col(share) * F.col(size)).cast("int"), F.lit(0)), F.col(size))
    rows = rows.withColumns({"x0": at("x", "width"), "y0": at("y", "height")})
    return rows.select("image_id", "region", "region_rank", "x0", "y0", F.least(F.col("x0") + F.floor(F.col("w") * F.col("width")).cast("int"), F.col("width")).alias("x1"), F.least(F.col("y0") + F.floor(F.col("h") * F.col("height")).cast("int"), F.col("height")).alias("y1"))


def page_position(detections: DataFrame, boxes: DataFrame) -> DataFrame:
    """Boxes are relative to their region; ``page_x`` and ``page_y`` add the region's offset."""
    return detections.join(boxes.select("image_id", "region", "x0", "y0"), ["image_id", "region"]).withColumns({"page_x": F.col("x") + F.col("x0"), "page_y": F.col("y") + F.col("y0")})


def extract(detections: DataFrame, regions: DataFrame) -> DataFrame:
    """The whole chain: size, first region, first of equal payloads, valid payloads with their fields."""
    return parsed(first_wins(first_region(right_size(detections), regions)))


def extraction_report(detections: DataFrame, regions: DataFrame) -> DataFrame:
    """One row for each image: codes found, success, error, primary assignment."""
    found = primary(extract(detections, regions))
    rows = detections.select("image_id").distinct().join(found, "image_id", "left")
    ok = F.coalesce(F.col("codes"), F.lit(0)) > 0
    return rows.select("image_id", ok.alias("success"), F.coalesce("codes", F.lit(0)).alias("codes"), F.when(~ok, F.lit("no valid code")).alias("error_message"), "assignment_id", "assignment_name", "subject", "total_points")
