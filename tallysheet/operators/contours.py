"""Regions of connected pixels, their convex hulls and smallest rectangles, from which the skew of a page is read.

Labels are found within an image by passes over its arrays; only the first and
last pixel of each region in each row are grouped by region, so what is shuffled
is a few numbers a row of pixels. Hulls and rectangles are folds over these.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallysheet.functions.text import let
from tallysheet.operators.raster import otsu_level


def bright(pixels: Column) -> Column:
    """Which pixels are above the Otsu grey, turned round if that leaves the page dark (a mean under 127 of 0 and 255)."""

    def turned(level: Column) -> Column:
        return let(F.transform(pixels, lambda v: v > level), lambda on: let(F.size(F.filter(on, lambda x: x)) * 255 < 127 * F.size(on), lambda dark: F.transform(on, lambda x: x != dark)))

    return let(otsu_level(pixels), turned)


def labels(on: Column, height: Column, width: Column) -> Column:
    """For each pixel of an object the least place of its region (rows one after another, eight neighbours), for others -1.

    Every pass gives a pixel the least label around it, and then that label's own
    label; passes end when nothing changes, after as many as a region winds at most.
    """
    n = F.size(on)

    def least(s: Column, v: Column, i: Column) -> Column:
        r, c = F.floor(i / width).cast("int"), (i % width).cast("int")
        around = []
        for dr in (-1, 0, 1):
            for dc in (-1, 0, 1):
                if dr or dc:
                    inside = (r + dr >= 0) & (r + dr < height) & (c + dc >= 0) & (c + dc < width)
                    around.append(F.when(inside, F.nullif(F.get(s, i + dr * width + dc), F.lit(-1))))
        return F.when(v < 0, v).otherwise(F.least(v, *around))

    def step(s: Column, _: Column) -> Column:
        def settled(now: Column) -> Column:
            return F.struct(now.alias("of"), (now == s["of"]).alias("done"))

        nearest = F.transform(s["of"], lambda v, i: least(s["of"], v, i))
        follow = let(nearest, lambda m: F.transform(m, lambda v: F.when(v < 0, v).otherwise(F.get(m, v))))
        return F.when(s["done"], s).otherwise(let(follow, settled))

    start = F.struct(F.transform(on, lambda x, i: F.when(x, i).otherwise(-1)).alias("of"), F.lit(False).alias("done"))
    return F.aggregate(F.sequence(F.lit(0), n), start, step, lambda s: s["of"])


def regions(images: DataFrame, objects: str = "light") -> DataFrame:
    """One row per region: ``image_id, region, area, image_area, points``; ``area`` in pixels, ``points`` the ends of its rows.

    Objects are the ``light`` pixels of a page turned bright, or the ``dark``
    ones, its ink. An image without pixels has no regions.
    """
    on = bright(F.col("pixels"))
    on = on if objects == "light" else F.transform(on, lambda x: ~x)
    labelled = images.where(F.size("pixels") > 0).select("image_id", "width", (F.col("height").cast("long") * F.col("width")).alias("image_area"), labels(on, F.col("height"), F.col("width")).alias("of"))
    pixels = labelled.select("image_id", "width", "image_area", F.posexplode("of").alias("place", "region")).where("region >= 0")
    x, y = (F.col("place") % F.col("width")).cast("long"), F.floor(F.col("place") / F.col("width")).cast("long")
    rows = pixels.groupBy("image_id", "region", y.alias("y")).agg(F.count("*").alias("n"), F.min(x).alias("low"), F.max(x).alias("high"), F.first("image_area").alias("image_area"))
    point = lambda c: F.struct(F.col(c).alias("x"), F.col("y").alias("y"))
    # As many entries as the image is high.
    ends = rows.groupBy("image_id", "region").agg(F.sum("n").alias("area"), F.first("image_area").alias("image_area"), F.flatten(F.collect_list(F.array(point("low"), point("high")))).alias("points"))
    return ends.withColumn("points", F.array_sort(F.array_distinct("points")))


def _turn(a: Column, b: Column, c: Column) -> Column:
    return (b["x"] - a["x"]) * (c["y"] - a["y"]) - (b["y"] - a["y"]) * (c["x"] - a["x"])


def hull(points: Column) -> Column:
    """Corners of the convex hull of sorted, distinct points, in turn, without points on its sides (monotone chain)."""

    def chain(points: Column) -> Column:
        def add(kept: Column, p: Column) -> Column:
            back = lambda k, _: F.when((F.size(k) >= 2) & (_turn(F.element_at(k, -2), F.element_at(k, -1), p) <= 0), F.slice(k, F.lit(1), F.size(k) - 1)).otherwise(k)
            steps = F.slice(kept, F.lit(2), F.size(kept))  # one step back for each point but the first
            return let(F.aggregate(steps, kept, back), lambda k: F.concat(k, F.array(p)))

        return F.aggregate(F.slice(points, F.lit(2), F.greatest(F.size(points), F.lit(1))), F.slice(points, 1, 1), add)

    def closed(halves: Column) -> Column:
        inner = lambda half: F.slice(half, F.lit(1), F.size(half) - 1)
        return F.concat(inner(halves["under"]), inner(halves["over"]))

    both = F.struct(chain(points).alias("under"), chain(F.reverse(points)).alias("over"))
    return F.when(F.size(points) < 3, points).otherwise(let(both, closed))


def smallest_rectangle(corners: Column) -> Column:
    """The rectangle of least area around a hull: ``area, angle, length, breadth``, by calipers laid along each side.

    ``angle`` is that of a side, in degrees between -45 (excluded) and 45; of
    equal areas the least angle. A point has no extent and angle 0.
    """

    def along(a: Column, i: Column, corners: Column) -> Column:
        b = F.get(corners, (i + 1) % F.size(corners))
        return let(F.struct((b["x"] - a["x"]).alias("x"), (b["y"] - a["y"]).alias("y")), lambda d: laid(d, corners))

    def laid(d: Column, corners: Column) -> Column:
        on = F.transform(corners, lambda p: p["x"] * d["x"] + p["y"] * d["y"])
        off = F.transform(corners, lambda p: p["y"] * d["x"] - p["x"] * d["y"])
        extent = lambda values: F.array_max(values) - F.array_min(values)
        squared = (d["x"] * d["x"] + d["y"] * d["y"]).cast("double")
        degrees = F.pmod(F.degrees(F.atan2(d["y"].cast("double"), d["x"].cast("double"))), F.lit(90.0))

        def shown(e: Column) -> Column:
            side = F.sqrt(e["squared"])
            angle = F.round(F.when(e["degrees"] > 45.000001, e["degrees"] - 90).otherwise(e["degrees"]), 6)
            return F.struct(F.round(e["on"] * e["off"] / e["squared"], 6).alias("area"), (angle + 0.0).alias("angle"), (e["on"] / side).alias("length"), (e["off"] / side).alias("breadth"))

        return let(F.struct(let(on, extent).cast("double").alias("on"), let(off, extent).cast("double").alias("off"), squared.alias("squared"), degrees.alias("degrees")), shown)

    none = F.struct(*[F.lit(0.0).alias(c) for c in ("area", "angle", "length", "breadth")])
    return F.when(F.size(corners) < 2, none).otherwise(F.array_min(F.transform(corners, lambda a, i: along(a, i, corners))))


def rectangles(images: DataFrame, objects: str = "light") -> DataFrame:
    """One row per region: ``image_id, region, area, image_area, corners, rectangle_area, angle``: what :func:`raster.dominant_angle` takes."""
    found = regions(images, objects).withColumn("hull", hull(F.col("points")))
    found = found.withColumns({"corners": F.size("hull"), "box": let(F.col("hull"), smallest_rectangle)})
    return found.select("image_id", "region", "area", "image_area", "corners", F.col("box.area").alias("rectangle_area"), F.col("box.angle").alias("angle"))
