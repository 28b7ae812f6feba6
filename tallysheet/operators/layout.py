"""Lines and reading order of recognised words.

Boxes: ``page_id, idx, text, conf, left, top, width, height``; idx is the order
within a page that breaks ties. Lines grow from an anchor that changes along
the way, which no window can follow; the distinct places of a page's boxes are
folded to the places where lines start, and the texts of the lines are then put
together by ordered aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallysheet.functions.text import let, strip


def confident(boxes: DataFrame, least: float = 0.0, shortest: int = 1, strictly: bool = True) -> DataFrame:
    """Boxes over a confidence (or at it) with a text of some length, trimmed; integer confidences are cut, not rounded."""
    conf = F.col("conf").cast("int") > least if strictly else F.col("conf") >= least
    return boxes.withColumn("text", strip(F.col("text"))).where(conf & (F.char_length("text") >= shortest))


def corners_to_box(boxes: DataFrame, corners: str = "corners") -> DataFrame:
    """Left, top, width, height and centre of ``array<struct<x, y>>``."""
    xs, ys = F.transform(corners, lambda p: p["x"]), F.transform(corners, lambda p: p["y"])
    mean = lambda v: F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / F.size(v)
    return boxes.withColumns({"left": F.array_min(xs), "top": F.array_min(ys), "width": F.array_max(xs) - F.array_min(xs), "height": F.array_max(ys) - F.array_min(ys), "center_x": mean(xs), "center_y": mean(ys)})


def _line_numbers(boxes: DataFrame, place: str, starts: Column, *held: Column) -> DataFrame:
    """Boxes with ``line_no``: how many lines of their page start at their place or before it.

    Lines are runs of a page's places in ascending order, so the places at which
    lines start tell everything. ``starts`` folds ``places``, a row for each
    distinct place of a page: pre-aggregated before the shuffle and bounded by the
    pixels of a page's height, not by its boxes. Boxes without a place stand before
    the first line, on line 0.
    """
    places = boxes.where(F.col(place).isNotNull()).groupBy("page_id", place).agg(*(held or (F.count("*").alias("n"),)))
    of_page = places.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct(place, *[c for c in places.columns if c not in ("page_id", place)]))).alias("places"))
    found = of_page.select(F.col("page_id").alias("__page"), starts.alias("__starts"))
    number = F.when(F.col(place).isNull() | F.col("__starts").isNull(), 0).otherwise(F.size(F.filter("__starts", lambda at: at <= F.col(place))))
    return boxes.join(found, F.col("page_id").eqNullSafe(F.col("__page")), "left").withColumn("line_no", number).drop("__page", "__starts")


def anchor_lines(boxes: DataFrame, threshold: float = 20.0) -> DataFrame:
    """A box joins the line whose first box is at most ``threshold`` above it; boxes of one top share a line, whatever their order."""

    def step(acc: Column, x: Column) -> Column:
        new = acc["anchor"].isNull() | (x["top"] - acc["anchor"] > threshold)
        return F.struct(F.when(new, x["top"]).otherwise(acc["anchor"]).alias("anchor"), F.when(new, F.concat(acc["starts"], F.array(x["top"]))).otherwise(acc["starts"]).alias("starts"))

    start = F.struct(F.lit(None).cast("double").alias("anchor"), F.array().cast("array<double>").alias("starts"))
    rows = boxes.withColumn("top", F.col("top").cast("double"))
    return _line_numbers(rows, "top", F.aggregate("places", start, step, lambda acc: acc["starts"]))


def weighted_lines(boxes: DataFrame, threshold: float = 50.0) -> DataFrame:
    """A box joins the line if its centre is near the mean centre of the line so far, weighted by width.

    A line of one box has that box's own centre; where all widths are 0 the last
    centre counts. Boxes of one centre are weighed together: the first of them
    draws the mean towards all others.
    """
    rows = boxes.withColumn("center_y", (F.col("top") + F.col("height") / 2).cast("double"))

    def step(acc: Column, x: Column) -> Column:
        y = x["center_y"]
        return let(acc["cy"].isNull() | (F.abs(y - acc["cy"]) > threshold), lambda new: joined(acc, x, new))

    def joined(acc: Column, x: Column, new: Column) -> Column:
        y = x["center_y"]
        yw, w = F.when(new, 0.0).otherwise(acc["yw"]) + y * x["weight"], F.when(new, 0.0).otherwise(acc["w"]) + x["weight"]
        cy = F.when(new, y).otherwise(F.coalesce(F.try_divide(yw, w), y))
        return F.struct(cy.alias("cy"), yw.alias("yw"), w.alias("w"), F.when(new, F.concat(acc["starts"], F.array(y))).otherwise(acc["starts"]).alias("starts"))

    start = F.struct(F.lit(None).cast("double").alias("cy"), F.lit(0.0).alias("yw"), F.lit(0.0).alias("w"), F.array().cast("array<double>").alias("starts"))
    return _line_numbers(rows, "center_y", F.aggregate("places", start, step, lambda acc: acc["starts"]), F.coalesce(F.sum("width").cast("double"), F.lit(0.0)).alias("weight"))


def line_texts(lined: DataFrame, gap: float = 10.0, any_start: bool = False, key: str = "left") -> DataFrame:
    """The text of each line from left to right; a space where the gap to the box before exceeds ``gap``.

    Unless ``any_start`` is set, no space follows a box that ends at 0 or left of it.
    A line is one row in the end, so its boxes are gathered; each looks at the one before it.
    """
    rows = lined.withColumn("k", F.col("left") + F.col("width") / 2 if key == "center" else F.col(key))
    held = rows.groupBy("page_id", "line_no").agg(F.collect_list(F.struct("k", "idx", "text", "left", "width")).alias("b"))

    def text(b: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            before = F.get(b, i - 1)
            right = before["left"] + before["width"]
            return F.concat(F.when((x["left"] - right > gap) & (F.lit(any_start) | (right > 0)), " ").otherwise(""), x["text"])

        return F.array_join(F.transform(b, one), "")

    return held.select("page_id", "line_no", strip(let(F.array_sort("b"), text)).alias("line_text"), F.size("b").cast("long").alias("boxes"))


def page_texts(lines: DataFrame, separator: str = "\n") -> DataFrame:
    """The lines of a page joined in order; blank lines are left out."""
    rows = lines.where("line_text <> ''").groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "line_text"))).alias("l"), F.count("*").alias("lines"))
    return rows.select("page_id", F.array_join(F.transform("l", lambda x: x["line_text"]), separator).alias("text"), "lines")


def simple_text(boxes: DataFrame) -> DataFrame:
    """The words of a page in their order with a space between."""
    rows = boxes.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("idx", "text"))).alias("b"), F.avg("conf").alias("mean_conf"))
    return rows.select("page_id", F.array_join(F.transform("b", lambda x: strip(x["text"])), " ").alias("text"), "mean_conf")


def mean_confidence(boxes: DataFrame) -> DataFrame:
    """Mean confidence of the boxes that passed."""
    return boxes.groupBy("page_id").agg(F.avg("conf").alias("mean_conf"), F.count("*").alias("boxes"))


def with_fallback(math_text: Column, math_conf: Column, general_text: Column, general_conf: Column, least: float = 30.0) -> Column:
    """The general result where the mathematical one is weak and the general one strictly better."""
    general = (math_conf < least) & (general_conf > math_conf)
    return F.struct(F.when(general, general_text).otherwise(math_text).alias("text"), F.when(general, general_conf).otherwise(math_conf).alias("conf"))
