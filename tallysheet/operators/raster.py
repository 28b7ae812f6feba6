"""Measures and enhancements of grey images: ``image_id, height, width, pixels array<int>`` (rows one after another).

Measures are array functions: no pixel leaves its row, so nothing is shuffled.
Neighbourhood filters run in numpy over Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallysheet.functions.text import let
from tallysheet.schemas import RASTERS


def _sum(values: Column, of: Callable[[Column], Column] = lambda x: x) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + of(x))


def brightness(pixels: Column) -> Column:
    """Mean grey; null for no pixels."""
    return F.try_divide(_sum(pixels), F.size(pixels).cast("double"))


def _variance(values: Column) -> Column:
    def of(x: Column) -> Column:
        n = F.size(x).cast("double")
        return let(F.try_divide(_sum(x), n), lambda m: F.try_divide(_sum(x, lambda v: (v - m) * (v - m)), n))

    return let(values, of)


def contrast(pixels: Column) -> Column:
    """Population standard deviation of grey."""
    return F.sqrt(_variance(pixels))


def laplacian(pixels: Column, height: Column, width: Column) -> Column:
    """The four-neighbour Laplacian of each pixel; the border is mirrored without repeating the edge."""
    mirror = lambda k, size: F.when(size == 1, F.lit(0)).when(k < 0, -k).when(k >= size, 2 * size - 2 - k).otherwise(k)

    def at(r: Column, c: Column) -> Column:
        return F.get(pixels, (mirror(r, height) * width + mirror(c, width)).cast("int"))

    def one(v: Column, i: Column) -> Column:
        r, c = F.floor(i / width).cast("int"), (i % width).cast("int")
        return at(r - 1, c) + at(r + 1, c) + at(r, c - 1) + at(r, c + 1) - 4 * v

    return F.transform(pixels, one)


def sharpness(pixels: Column, height: Column, width: Column) -> Column:
    """Population variance of the Laplacian."""
    return _variance(laplacian(pixels, height, width))


def dark_share(pixels: Column, below: int = 128) -> Column:
    """Share of pixels darker than a grey."""
    return F.try_divide(F.size(F.filter(pixels, lambda v: v < below)).cast("double"), F.size(pixels).cast("double"))


def measures(images: DataFrame) -> DataFrame:
    """Brightness, contrast and sharpness of each image."""
    p = F.col("pixels")
    return images.select("image_id", "height", "width", brightness(p).alias("brightness"), contrast(p).alias("contrast"), sharpness(p, F.col("height"), F.col("width")).alias("sharpness"))


def basic_quality(measured: DataFrame) -> DataFrame:
    """I4: three flags, 40 + 30 + 30 points, fit for recognition from 70; images without pixels have zeros."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0)).alias(c)
    rows = measured.select("image_id", zero("sharpness"), zero("contrast"), zero("brightness"))
    sharp, strong, lit = F.col("sharpness") >= 50, F.col("contrast") >= 30, F.col("brightness").between(80, 200)
    score = F.when(sharp, 40).otherwise(0) + F.when(strong, 30).otherwise(0) + F.when(lit, 30).otherwise(0)
    return rows.withColumns({"is_sharp": sharp, "has_good_contrast": strong, "is_well_lit": lit, "overall_score": score, "is_suitable_for_ocr": score >= 70})


def full_quality(measured: DataFrame) -> DataFrame:
    """Six scores from 0 to 100 and their mean; below 70 an image needs enhancement.

    ``noise_level`` and ``edge_density`` come from :func:`neighbourhood`.
    """
    b, c, s = F.col("brightness"), F.col("contrast"), F.col("sharpness")
    hundred, zero = F.lit(100.0), F.lit(0.0)
    n = F.col("height").cast("bigint") * F.col("width")
    scores = {
        "brightness_score": F.when(b < 80, b / 80 * 100).when(b > 200, F.greatest(zero, 100 - (b - 200))).otherwise(hundred),
        "contrast_score": F.least(hundred, c / 30 * 100),
        "sharpness_score": F.least(hundred, s / 50 * 100),
        "noise_score": F.greatest(zero, 100 - F.col("noise_level") / 15 * 100),
        "resolution_score": F.when(n < 300000, 30.0).when(n < 1000000, 60.0).otherwise(100.0),
        "text_clarity_score": F.when(F.col("edge_density").between(0.05, 0.4), hundred).otherwise(F.greatest(zero, 100 - F.abs(F.col("edge_density") - 0.2) * 200)),
    }
    rows = measured.withColumns(scores)
    total = sum((F.col(k) for k in scores), F.lit(0.0)) / len(scores)
    rows = rows.withColumn("overall_score", F.coalesce(total, zero))
    return rows.withColumns({"brightness_optimal": b.between(80, 200), "contrast_adequate": c >= 30, "sharpness_adequate": s >= 50, "noise_acceptable": F.col("noise_level") <= 15, "needs_enhancement": F.col("overall_score") < 70})


def enhancement_plan(quality: DataFrame) -> DataFrame:
    """Needed enhancements in the order found, and steps by priority, stable."""
    item = lambda cond, need, step, rank: F.when(cond, F.struct(F.lit(need).alias("need"), F.lit(step).alias("step"), F.lit(rank).alias("rank")))
    b = F.col("brightness")
    needs = F.array_compact(F.array(
        item(b < 80, "brighten", "brightness_correction", 1), item(b > 200, "darken", "brightness_correction", 1), item(~F.col("contrast_adequate"), "contrast_enhancement", "contrast_enhancement", 1),
        item(~F.col("sharpness_adequate"), "sharpening", "sharpening", 2), item(~F.col("noise_acceptable"), "denoising", "denoising", 2), item(F.col("resolution_score") < 60, "upscaling", "upscaling", 3),
    ))
    rows = quality.withColumn("needs", needs)
    ordered = F.array_sort(F.transform("needs", lambda x, i: F.struct(x["rank"].alias("rank"), i.alias("i"), x["step"].alias("step"))))
    return rows.withColumns({"enhancements_needed": F.array_join(F.transform("needs", lambda x: x["need"]), ","), "steps": F.array_join(F.transform(ordered, lambda x: x["step"]), ",")}).drop("needs")


def adjusted(pixels: Column) -> Column:
    """I8: brightness moved to 128 if more than 10 off, then contrast stretched if the spread before was under 50."""

    def stretch(s: Column) -> Column:
        move = F.when(F.abs(128 - s["m"]) > 10, 128 - s["m"]).otherwise(0.0)
        gain = F.when((s["d"] < 50) & (s["d"] > 0), F.least(F.lit(2.0), 50 / s["d"])).otherwise(1.0)
        clip = lambda v: F.least(F.greatest(v, F.lit(0.0)), F.lit(255.0))
        return F.transform(pixels, lambda v: clip((clip(v + move) - 128) * gain + 128).cast("int"))

    return let(F.struct(brightness(pixels).alias("m"), contrast(pixels).alias("d")), stretch)


def fitted_size(width: Column, height: Column, most: int = 2000) -> Column:
    """Width and height scaled down to a greatest width."""
    return F.struct(F.least(width, F.lit(most)).alias("width"), F.when(width > most, F.floor(height / width * most)).otherwise(height).cast("int").alias("height"))


def upscaled_size(width: Column, height: Column) -> Column:
    """Small images grow to a width of 1600, threefold at most."""
    factor = F.when((width < 1200) | (height < 800), F.least(F.lit(3.0), F.lit(1600.0) / width)).otherwise(1.0)
    return F.struct(F.floor(width * factor).cast("int").alias("width"), F.floor(height * factor).cast("int").alias("height"))


def otsu_level(pixels: Column) -> Column:
    """I16: the grey level that best splits an image in two; null for no pixels.

    A fold over the sorted greys: at the last pixel of each grey the variance
    between those up to it and those above it is known; the least of equals counts.
    """

    def best(greys: Column) -> Column:
        n = F.size(greys).cast("double")

        def at(total: Column) -> Column:
            def step(s: Column, i: Column) -> Column:
                v = F.get(greys, i)
                return let(F.struct(v.alias("v"), (i + 1).cast("double").alias("w"), (s["sum"] + v).alias("sum")), lambda x: weighed(s, x, i))

            def weighed(s: Column, x: Column, i: Column) -> Column:
                gap = x["sum"] / x["w"] - F.try_divide(total - x["sum"], n - x["w"])
                between = F.coalesce(F.round(x["w"] * (n - x["w"]) * gap * gap, 6), F.lit(0.0))
                last = ~F.get(greys, i + 1).eqNullSafe(x["v"])
                better = lambda b: last & (b > s["most"])
                return let(between, lambda b: F.struct(x["sum"].alias("sum"), F.when(better(b), b).otherwise(s["most"]).alias("most"), F.when(better(b), x["v"]).otherwise(s["level"]).alias("level")))

            start = F.struct(F.lit(0.0).alias("sum"), F.lit(-1.0).alias("most"), F.lit(None).cast("int").alias("level"))
            return F.aggregate(F.sequence(F.lit(0), F.size(greys) - 1), start, step, lambda s: s["level"])

        return F.when(F.size(greys) > 0, let(_sum(greys), at))

    return let(F.array_sort(pixels), best)


def otsu(images: DataFrame) -> DataFrame:
    """I16: the Otsu grey of each image, within its row."""
    return images.select("image_id", otsu_level(F.col("pixels")).alias("threshold"))


def dominant_angle(contours: DataFrame, least_share: float = 0.001, top: int = 10, least_angle: float = 0.5) -> DataFrame:
    """Skew of an image from ``image_id, area, angle, image_area``.

    Small contours go, the ten largest stay, angles are brought to (-45, 45],
    and the median is the skew if it is half a degree at least.
    """
    from pyspark.sql import Window

    big = contours.where(F.col("area") > F.col("image_area") * least_share)
    w = Window.partitionBy("image_id").orderBy(F.desc("area"), "angle")
    few = big.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= top)
    a = F.when(F.col("angle") < -45, F.col("angle") + 90).when(F.col("angle") > 45, F.col("angle") - 90).otherwise(F.col("angle"))
    out = few.groupBy("image_id").agg(F.median(a).alias("angle"), F.count("*").alias("contours"))
    turn = F.abs("angle") >= least_angle
    return out.select("image_id", "angle", "contours", turn.alias("rotate"), F.when(turn, F.format_string("deskew_%.2fdeg", "angle")).alias("step"))


def math_structure(images: DataFrame) -> DataFrame:
    """Wide images are complex, tall ones hold fractions, dark ones exponents."""
    density = dark_share(F.col("pixels"))
    rows = images.select("image_id", (F.col("width") / F.col("height")).alias("aspect_ratio"), density.alias("text_density"), (F.col("height") > F.col("width") * 0.8).alias("has_fractions"))
    return rows.withColumns({"has_complex_structure": F.col("aspect_ratio") > 3, "has_exponents": F.col("text_density") > 0.15})


# --- Neighbourhood filters: numpy over the arrays of a batch -----------------


def _windows(image: np.ndarray, size: int, mode: str = "reflect") -> np.ndarray:
    pad = size // 2
    wide = np.pad(image, pad, mode=mode if min(image.shape) > pad else "edge")
    return np.lib.stride_tricks.sliding_window_view(wide, (size, size))


def median_filter(image: np.ndarray, size: int = 5) -> np.ndarray:
    return np.median(_windows(image, size, "edge"), axis=(2, 3)).astype(np.int64)


def convolve(image: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    return (_windows(image.astype(float), len(kernel)) * kernel).sum(axis=(2, 3))


#: The tangent of 22.5 degrees in parts of 2**15.
SLOPE = round((2**0.5 - 1) * 2**15)


#: The gradient that an edge begins above. Fixed value.
STRONG = 150.0


def edges(image: np.ndarray, low: float = 50.0, high: float = STRONG) -> np.ndarray:
    """Edge pixels: gradients above ``low`` that are greatest across the edge and hang together with one above ``high``.

    Gradients are sums of the absolute Sobel differences, the border repeated.
    Weak pixels grow from strong ones, eight neighbours at a time, until none is added.
    """
    kernel = np.array([[-1, 0, 1], [-2, 0, 2], [-1, 0, 1]])
    around = _windows(image.astype(np.int64), 3, "edge")
    gx, gy = (around * kernel).sum(axis=(2, 3)), (around * kernel.T).sum(axis=(2, 3))
    size = np.abs(gx) + np.abs(gy)
    wide = np.pad(size, 1)
    at = lambda dr, dc: wide[1 + dr : 1 + dr + size.shape[0], 1 + dc : 1 + dc + size.shape[1]]
    run, rise = np.abs(gx) * SLOPE, np.abs(gy) << 15
    flat, steep, falling = rise < run, rise > run + (np.abs(gx) << 16), (gx < 0) != (gy < 0)
    across = np.where(flat, (size > at(0, -1)) & (size >= at(0, 1)), np.where(steep, (size > at(-1, 0)) & (size >= at(1, 0)), np.where(falling, (size > at(-1, 1)) & (size > at(1, -1)), (size > at(-1, -1)) & (size > at(1, 1)))))
    weak = across & (size > low)
    found = weak & (size > high)
    while True:
        grown = weak & _windows(np.pad(found, 1), 3, "edge").any(axis=(2, 3))[1:-1, 1:-1]
        if (grown == found).all():
            return found
        found = grown


def sharpen(image: np.ndarray) -> np.ndarray:
    """A kernel by edge density: against all eight neighbours below .05, against the four nearest to .15, and against half of those above."""
    density = edges(image).mean()
    kernel = np.full((3, 3), -1.0) if density < 0.05 else np.array([[0, 1, 0], [1, 0, 1], [0, 1, 0]]) * (-1.0 if density < 0.15 else -0.5)
    kernel[1, 1] = 9 if density < 0.05 else 5 if density < 0.15 else 3
    return convolve(image, kernel)


def sharpen_all_round(image: np.ndarray) -> np.ndarray:
    """Sharpening against all eight neighbours: strong below an edge density of .05, middling to .15, mild above."""
    density = edges(image).mean()
    side = -1.0 if density < 0.05 else -0.5 if density < 0.15 else -0.25
    kernel = np.full((3, 3), side)
    kernel[1, 1] = 1 - 8 * side
    return convolve(image, kernel)


def lit(image: np.ndarray) -> np.ndarray:
    """I8 as a step: brightness moved, then contrast stretched by the spread before; cut to whole greys after each, where :func:`adjusted` cuts once."""
    if not image.size:
        return image
    move, spread = 128 - image.mean(), image.std()
    x = np.trunc(np.clip(image + move, 0, 255)) if abs(move) > 10 else image
    return np.trunc(np.clip((x - 128) * min(2.0, 50 / max(spread, 1.0)) + 128, 0, 255)) if spread < 50 else x


def adaptive_threshold(image: np.ndarray, size: int = 11, offset: float = 2.0) -> np.ndarray:
    """I16: white where a pixel is brighter than the mean around it less an offset."""
    return np.where(image > _windows(image.astype(float), size, "edge").mean(axis=(2, 3)) - offset, 255, 0)


def gaussian_threshold(image: np.ndarray, size: int = 11, offset: float = 2.0) -> np.ndarray:
    """White where a pixel is brighter than the bell-weighted mean around it, rounded, less an offset."""
    at = np.arange(size) - size // 2
    bell = np.exp(-(at**2) / (2 * (0.3 * ((size - 1) / 2 - 1) + 0.8) ** 2))
    bell /= bell.sum()
    x = image.astype(float)
    for _ in range(2):
        x = np.lib.stride_tricks.sliding_window_view(np.pad(x, ((size // 2, size // 2), (0, 0)), mode="edge"), size, axis=0) @ bell
        x = x.T
    return np.where(image > np.rint(np.round(x, 6)) - offset, 255, 0)


#: The sharpening of handwriting after its contrast is evened out. Fixed values.
STROKES = np.array([[-0.5, -1, -0.5], [-1, 7, -1], [-0.5, -1, -0.5]])


def bilateral(image: np.ndarray, size: int = 9, greys: float = 75.0, distance: float = 75.0) -> np.ndarray:
    """Each pixel as the mean of those within half of ``size``, weighed by nearness in place and in grey, so that edges stay."""
    h, w = image.shape
    far = size // 2
    wide = np.pad(image.astype(float), far, mode="reflect" if min(h, w) > 1 else "edge")
    total, weights = np.zeros((h, w)), np.zeros((h, w))
    for dr in range(-far, far + 1):
        for dc in range(-far, far + 1):
            gap = dr * dr + dc * dc
            if gap <= far * far:
                near = wide[far + dr : far + dr + h, far + dc : far + dc + w]
                weight = np.exp(-gap / (2 * distance**2) - (near - image) ** 2 / (2 * greys**2))
                total, weights = total + weight * near, weights + weight
    return np.round(total / weights, 6)


def equalised(image: np.ndarray, clip: float = 3.0, grid: int = 8) -> np.ndarray:
    """Histogram equalisation by tiles: each of ``grid`` by ``grid`` tiles has a map of greys, and a pixel blends the maps of the four nearest tiles.

    Counts above the clip limit are dealt out again: evenly, and what is left
    over to greys at equal distances. The image is mirrored up to whole tiles.
    """
    h, w = image.shape
    th, tw = -(-h // grid), -(-w // grid)
    pad = ((0, th * grid - h), (0, tw * grid - w))
    wide = np.pad(image, pad, mode="reflect" if min(h, w) > 1 else "edge")
    tiles = wide.reshape(grid, th, grid, tw).swapaxes(1, 2).reshape(grid * grid, th * tw)
    counts = np.zeros((grid * grid, 256), np.int64)
    np.add.at(counts, (np.arange(grid * grid)[:, None], tiles), 1)
    most = max(1, int(clip * th * tw / 256))
    surplus = np.maximum(counts - most, 0).sum(axis=1)
    batch, rest = surplus // 256, surplus % 256
    step = np.maximum(1, 256 // np.maximum(rest, 1))[:, None]
    greys = np.arange(256)[None]
    counts = np.minimum(counts, most) + batch[:, None] + ((greys % step == 0) & (greys // step < rest[:, None]))
    maps = np.clip(np.rint(np.cumsum(counts, axis=1) * 255.0 / (th * tw)), 0, 255).reshape(grid, grid, 256)

    def near(n: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.arange(n) / size - 0.5
        first = np.floor(at).astype(int)
        return np.maximum(first, 0), np.minimum(first + 1, grid - 1), at - first

    (r0, r1, fr), (c0, c1, fc) = near(h, th), near(w, tw)
    of = lambda r, c: maps[r[:, None], c[None, :], image]
    fr, fc = fr[:, None], fc[None, :]
    return (of(r0, c0) * (1 - fc) + of(r0, c1) * fc) * (1 - fr) + (of(r1, c0) * (1 - fc) + of(r1, c1) * fc) * fr


def non_local_means(image: np.ndarray, strength: float = 10.0, patch: int = 7, window: int = 21) -> np.ndarray:
    """Each pixel as the mean of those in a window around it, weighed by how alike their patches are.

    For each shift of the image the squared differences of all patches are sums
    along rows and then columns, whole numbers for an image of whole greys; as many
    shifts are taken together as fit into some megabytes.
    """
    h, w = image.shape
    near, far = patch // 2, window // 2
    greys = image.astype(np.int32 if np.issubdtype(image.dtype, np.integer) else float)
    wide = np.pad(greys, near + far, mode="reflect" if min(h, w) > 1 else "edge")
    own = wide[far : far + h + 2 * near, far : far + w + 2 * near]
    shifts = np.lib.stride_tricks.sliding_window_view(wide, own.shape)
    total, weights = np.zeros((h, w)), np.zeros((h, w))
    rows = max(1, min(window, (1 << 19) // (window * own.size)))
    for first in range(0, window, rows):
        shifted = shifts[first : first + rows].reshape(-1, *own.shape)
        area = shifted - own
        gap = _run_sums(_run_sums(area * area, patch).swapaxes(1, 2), patch).swapaxes(1, 2)
        weight = np.exp(gap / (-patch * patch * strength * strength))
        total += (weight * shifted[:, near : near + h, near : near + w]).sum(axis=0)
        weights += weight.sum(axis=0)
    return total / weights


def _run_sums(x: np.ndarray, n: int) -> np.ndarray:
    """Sums of ``n`` neighbours along the second axis, from sums of twice as many step by step."""
    size, out, at, step = x.shape[1] - n + 1, None, 0, 1
    while n:
        if n & 1:
            part = x[:, at : at + size]
            out, at = part if out is None else out + part, at + step
        x, n, step = x[:, :-step] + x[:, step:] if n > 1 else x, n >> 1, step * 2
    return out


#: The slope of the cubic kernel. Fixed value.
CUBIC = -0.75


def _cubic_weight(distance: np.ndarray) -> np.ndarray:
    """What an old pixel at a distance of less than two weighs."""
    d = np.abs(distance)
    return np.where(d <= 1, ((CUBIC + 2) * d - (CUBIC + 3)) * d * d + 1, ((CUBIC * d - 5 * CUBIC) * d + 8 * CUBIC) * d - 4 * CUBIC)


def cubic(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Resampling to a size by cubic convolution; rounded to six places, so that halves don't hang on the last bits.

    Rows and then columns: each new one is a sum of the four old ones around its
    centre; beyond the border the edge is repeated.
    """

    def rows(x: np.ndarray, new: int) -> np.ndarray:
        at = (np.arange(new) + 0.5) * len(x) / new - 0.5
        first, out = np.floor(at).astype(int), np.zeros((new, x.shape[1]))
        for k in (-1, 0, 1, 2):
            out += _cubic_weight(at - first - k)[:, None] * x[np.clip(first + k, 0, len(x) - 1)]
        return out

    return np.round(rows(rows(image.astype(float), height).T, width).T, 6)


def fitted(image: np.ndarray, most: int = 2000) -> np.ndarray:
    """A wide image brought to the greatest width."""
    h, w = image.shape
    return image if w <= most else cubic(image, int(most * (h / w)), most)


def upscaled(image: np.ndarray) -> np.ndarray:
    """A small image brought to a width of 1600, threefold at most."""
    h, w = image.shape
    factor = min(3.0, 1600 / w)
    return cubic(image, int(h * factor), int(w * factor)) if w < 1200 or h < 800 else image


def widened(image: np.ndarray, least: int = 1200) -> np.ndarray:
    """The last scaling: a narrow image brought to the least width that a recogniser likes."""
    h, w = image.shape
    return image if w >= least else cubic(image, int(h * (least / w)), least)


def binarised(image: np.ndarray) -> np.ndarray:
    """Black and white at the Otsu threshold: the grey up to which is black."""
    counts = np.bincount(image.ravel(), minlength=256)
    below, total = np.cumsum(counts), np.cumsum(counts * np.arange(256))
    above = below[-1] - below
    with np.errstate(divide="ignore", invalid="ignore"):
        between = np.nan_to_num(below * above * (total / below - (total[-1] - total) / above) ** 2)
    return np.where(image > np.round(between, 6).argmax(), 255, 0)


def _square(image: np.ndarray, before: bool, outside: int) -> np.ndarray:
    """Each pixel's 2 by 2 square, with the pixels before it or after it; pixels outside have a grey that never counts."""
    pad = (1, 0) if before else (0, 1)
    return np.lib.stride_tricks.sliding_window_view(np.pad(image, (pad, pad), constant_values=outside), (2, 2))


def closed(image: np.ndarray) -> np.ndarray:
    """Morphological closing with a 2 by 2 square: greatest grey, then least."""
    return _square(_square(image, True, 0).max(axis=(2, 3)), False, 255).min(axis=(2, 3))


def opened(image: np.ndarray) -> np.ndarray:
    """Morphological opening with a 2 by 2 square: least grey, then greatest."""
    return _square(_square(image, True, 255).min(axis=(2, 3)), False, 0).max(axis=(2, 3))


#: Steps by name; each takes and gives an image of greys.
STEPS: dict[str, Callable[[np.ndarray], np.ndarray]] = {
    "sharpening": sharpen, "denoising": non_local_means, "contrast_enhancement": equalised, "equalised_by_quarters": lambda x: equalised(x, grid=2), "lightly_denoised": lambda x: non_local_means(x, patch=3, window=5), "threshold": adaptive_threshold, "binarise": binarised, "close": closed, "open": opened,
    "upscaling": upscaled, "fitting": fitted, "widening": widened, "fitted_to_five": lambda x: fitted(x, 5), "widened_to_thirteen": lambda x: widened(x, 13),
    "double": lambda x: cubic(x, *(2 * n for n in x.shape)), "half_as_large_again": lambda x: cubic(x, *(3 * n // 2 for n in x.shape)),
    "strokes": lambda x: convolve(x, STROKES), "bilateral": bilateral, "gaussian_threshold": gaussian_threshold, "gentle_contrast": lambda x: equalised(x, clip=2.0), "gentle_denoising": lambda x: non_local_means(x, strength=3.0),
    "brightness_correction": lit, "sharpening_all_round": sharpen_all_round,
}
#: The steps before recognition by engine. Fixed values.
CHAINS = {
    "printed": "double,gentle_denoising,binarise,close,open", "handwriting": "half_as_large_again,contrast_enhancement,strokes,bilateral", "formula": "half_as_large_again,gentle_contrast,denoising,gaussian_threshold",
}


@F.pandas_udf(T.StructType([T.StructField("noise_level", T.DoubleType()), T.StructField("edge_density", T.DoubleType())]))
def neighbourhood(pixels: pd.Series, height: pd.Series, width: pd.Series) -> pd.DataFrame:
    """Noise (mean distance from the 5 by 5 median) and edge density of each image, as a struct beside its row; null for no pixels."""
    grids = [np.asarray(p).reshape(h, w) for p, h, w in zip(pixels, height, width, strict=True)]
    of = lambda measure: pd.Series([float(measure(g).mean()) if g.size else None for g in grids], dtype=float)
    return pd.DataFrame({"noise_level": of(lambda g: np.abs(g - median_filter(g))), "edge_density": of(edges)})


# --- Measures of large images, in numpy: whole, or once for places that are alike ------

#: What :func:`measured` gives of an image.
MEASURES = ("brightness", "contrast", "sharpness", "noise_level", "edge_density")
#: The pairs of a network that puts five in order.
FIVE = ((0, 1), (3, 4), (2, 4), (2, 3), (1, 4), (0, 3), (0, 2), (1, 3), (1, 2))


def _in_order(five: list[np.ndarray]) -> list[np.ndarray]:
    """Five arrays put in order, element by element."""
    x = list(five)
    for i, j in FIVE:
        x[i], x[j] = np.minimum(x[i], x[j]), np.maximum(x[i], x[j])
    return x


def _median_of_25(wide: np.ndarray) -> np.ndarray:
    """The median of the 5 by 5 around each place but the outer two; further axes are apart.

    Columns of five are put in order, then rows of them. In a square in order both
    ways, a place with 14 or more at most as great, or at least as great, itself
    counted, is not needed. From more than half of the 13 others the least and the
    greatest are dropped, and again with the next one, until one is left.
    """
    h, w = wide.shape[0] - 4, wide.shape[1] - 4
    square = [_in_order([c[:, k : k + w] for k in range(5)]) for c in _in_order([wide[k : k + h] for k in range(5)])]
    rest = [square[a][b] for a in range(5) for b in range(5) if (a + 1) * (b + 1) <= 13 and (5 - a) * (5 - b) <= 13]
    some = [rest.pop() for _ in range(len(rest) // 2 + 2)]
    while len(some) > 1:
        for i in range(1, len(some)):
            some[0], some[i] = np.minimum(some[0], some[i]), np.maximum(some[0], some[i])
        for i in range(1, len(some) - 1):
            some[i], some[-1] = np.minimum(some[i], some[-1]), np.maximum(some[i], some[-1])
        some = some[1:-1] + [rest.pop() for _ in rest[:1]]
    return some[0]


def _sums(parts: np.ndarray, ends: tuple[int, int, int, int]) -> np.ndarray:
    """Sums over parts of images (rows, columns, parts): greys, their squares, Laplacians, their squares, distances from the 5 by 5 median; and the steepest gradient.

    ``ends`` has 1 where the image ends (above, below, left, right); on the other
    sides two more rows or columns of the image stand around a part.
    """
    top, bottom, left, right = ends
    wide = np.pad(parts, ((2 * top, 2 * bottom), (2 * left, 2 * right), (0, 0)), mode="edge")
    own, signed = wide[2:-2, 2:-2], np.int16 if parts.dtype == np.uint8 else np.int64
    middle = _median_of_25(wide)
    noise = np.maximum(own, middle) - np.minimum(own, middle)
    x = wide[1:-1, 1:-1].astype(signed)
    down, along = x[:-2] + 2 * x[1:-1] + x[2:], x[:, :-2] + 2 * x[:, 1:-1] + x[:, 2:]
    steep = np.abs(down[:, 2:] - down[:, :-2]) + np.abs(along[2:] - along[:-2])
    x = np.pad(parts.astype(signed), ((top, bottom), (left, right), (0, 0)), mode="reflect")
    x = x[1 - top : len(x) - 1 + bottom, 1 - left : x.shape[1] - 1 + right]
    bend = x[:-2, 1:-1] + x[2:, 1:-1] + x[1:-1, :-2] + x[1:-1, 2:] - 4 * x[1:-1, 1:-1]
    total = lambda y: y.sum(axis=(0, 1), dtype=float)  # noqa: E731  whole numbers, exact
    squares = lambda y: total((y := y.astype(np.int32 if signed is np.int16 else float)) * y)
    return np.array([total(own), squares(own), total(bend), squares(bend), total(noise), steep.max(axis=(0, 1))])


def _measures(sums: np.ndarray, pixels: int, edge_density: Callable[[], float]) -> tuple[float, ...]:
    """The measures of an image from the sums over it. Without a gradient above the greater bound no edge begins."""
    total, squares, bend, bends, noise, steepest = map(int, sums)
    variance = lambda s, s2: (pixels * s2 - s * s) / pixels**2  # noqa: E731  of whole numbers without bounds
    return total / pixels, variance(total, squares) ** 0.5, variance(bend, bends), noise / pixels, edge_density() if steepest > STRONG else 0.0


def measured(image: np.ndarray) -> tuple[float | None, ...]:
    """I1 to I3, noise and edge density of an image of whole greys; null for no pixels."""
    if not image.size:
        return (None,) * len(MEASURES)
    greys = image.astype(np.uint8) if image.min() >= 0 and image.max() <= 255 else image
    return _measures(_sums(greys[..., None], (1, 1, 1, 1))[:, 0], image.size, lambda: float(edges(image).mean()))


def greyed(image: np.ndarray) -> np.ndarray:
    """The whole greys of a step's image."""
    return np.clip(np.rint(image), 0, 255).astype(np.int64)


#: Parts that are scaled and measured at a time.
PARTS = 64


def measured_widened(images: list[np.ndarray], least: int = 1200) -> list[tuple[int | float | None, ...]]:
    """Height, width and measures of each image after the last scaling; every pixel counts, but those of places that are alike are made once.

    In an image of black and white that grows a whole number of times, the
    pixels that one old pixel becomes, and two around them, hang on the 5 by 5
    old ones around it and on where the image ends. So each such
    neighbourhood of the images is scaled and measured once, and an image's sums
    are those of its old pixels. Other images are scaled whole.
    """
    out: list[tuple[int | float | None, ...]] = [()] * len(images)
    alike: dict[tuple[int, int], list[int]] = {}
    for k, x in enumerate(images):
        h, w = x.shape
        if x.size and w < least and least % w == 0 and least // w >= 6 and ((x == 0) | (x == 255)).all():
            alike.setdefault((h, w), []).append(k)
        else:
            y = greyed(widened(x, least)) if x.size else x
            out[k] = (*y.shape, *measured(y))
    for (h, w), which in alike.items():
        times = least // w
        sums = _sums_by_neighbourhood(np.stack([images[k] for k in which]) > 0, times)
        for k, s in zip(which, sums, strict=True):
            out[k] = (h * times, least, *_measures(s, h * times * least, lambda k=k: float(edges(greyed(widened(images[k], least))).mean())))
    return out


def _sums_by_neighbourhood(white: np.ndarray, times: int) -> np.ndarray:
    """:func:`_sums` over images of black and white (images, rows, columns) that grow ``times`` times: a row for each image."""
    n, h, w = white.shape
    code = np.zeros((n, h, w), np.int64)
    wide = np.pad(white, ((0, 0), (2, 2), (2, 2)), mode="edge")
    for k in range(25):
        code |= wide[:, k // 5 : k // 5 + h, k % 5 : k % 5 + w].astype(np.int64) << k
    for k, end in enumerate(((slice(None), 0), (slice(None), -1), (slice(None), slice(None), 0), (slice(None), slice(None), -1))):
        code[end] |= 1 << 25 + k
    kinds, of = np.unique(code, return_inverse=True)
    sums = np.empty((6, len(kinds)))
    at = (np.arange(-2, times + 2) + 0.5) / times - 0.5
    weights = np.stack([np.where(np.abs(at - k) < 2, _cubic_weight(at - k), 0.0) for k in (-2, -1, 0, 1, 2)], axis=1)
    first = 0
    while first < len(kinds):  # in order, so that those at the same ends stand together
        ends = tuple(int(kinds[first] >> 25 + k & 1) for k in range(4))
        last = min(first + PARTS, np.searchsorted(kinds, (kinds[first] >> 25) + 1 << 25))
        old = (kinds[first:last] >> np.arange(25)[:, None] & 1).reshape(5, 5, -1) * 255.0
        rows, columns = (weights[2 * a : len(weights) - 2 * b] for a, b in (ends[:2], ends[2:]))
        x = np.matmul(columns, (rows @ old.reshape(5, -1)).reshape(len(rows), 5, -1))
        x = np.clip(np.rint(np.round(x, 6, out=x), out=x), 0, 255, out=x).astype(np.uint8)
        sums[:, first:last] = _sums(x, ends)
        first = last
    each = sums[:, of.reshape(n, -1)]
    return np.concatenate([each[:5].sum(axis=2), each[5:].max(axis=2)]).T


#: Images of a batch that a Python task gets at a time.
BATCH = 512
BATCH_BOUND = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(images: DataFrame) -> DataFrame:
    """Bound the batches that Python tasks get, for steps make images many times as large.

    A setting of the session, since Spark reads it only when the returned frame
    is run; a smaller bound that the caller set stays.
    """
    conf = images.sparkSession.conf
    if not 0 < int(conf.get(BATCH_BOUND)) <= BATCH:
        conf.set(BATCH_BOUND, str(BATCH))
    return images


def analysed(images: DataFrame) -> DataFrame:
    """The images with their measures, I5's scores and I6's plan; every image passes once, nothing is shuffled."""
    images = small_batches(images)
    p, h, w = F.col("pixels"), F.col("height"), F.col("width")
    rows = images.withColumns({"brightness": brightness(p), "contrast": contrast(p), "sharpness": sharpness(p, h, w), "around": neighbourhood(p, h, w)})
    return enhancement_plan(full_quality(rows.select("*", "around.*").drop("around")))


def _after(image: np.ndarray, plan: str | None) -> tuple[np.ndarray, list[str]]:
    """An image after its comma-separated steps, and those that ran."""
    done = []
    for step in filter(None, (plan or "").split(",")):
        try:
            image = greyed(STEPS[step](image))
            done.append(step)
        except (KeyError, ValueError, IndexError, ZeroDivisionError):
            continue
    return image, done


def apply_steps(images: DataFrame, steps: str = "steps", keep: tuple[str, ...] = ()) -> DataFrame:
    """Each image after its comma-separated steps, and the columns in ``keep``; a step that fails is passed over, ``applied`` lists those that ran."""

    def run(pixels: pd.Series, height: pd.Series, width: pd.Series, plans: pd.Series) -> pd.DataFrame:
        out = []
        for p, h, w, plan in zip(pixels, height, width, plans, strict=True):
            x, done = _after(np.asarray(p).reshape(h, w), plan)
            out.append((x.shape[0], x.shape[1], x.ravel().astype(np.int32), ",".join(done)))
        return pd.DataFrame(out, columns=["height", "width", "pixels", "applied"])

    images = small_batches(images)
    done = F.pandas_udf(run, "height int, width int, pixels array<int>, applied string")("pixels", "height", "width", F.col(steps).cast("string"))
    return images.select("image_id", *keep, done.alias("done")).select("image_id", *keep, "done.*")


def prepared(images: DataFrame, chains: dict[str, str] = CHAINS) -> DataFrame:
    """Each image as each recogniser wants it: ``image_id, chain`` and the image after the chain's steps."""
    each = F.explode(F.create_map(*[F.lit(x) for pair in chains.items() for x in pair])).alias("chain", "steps")
    return apply_steps(images.select("image_id", "height", "width", "pixels", each), keep=("chain",))


#: What follows the plan: symbols mended, lines of even thickness, black and white, the recogniser's width. Fixed values.
LAST = "close,open,gaussian_threshold,binarise,widening"


def processed_for_recognition(images: DataFrame, last: str = LAST, pixels: bool = True) -> DataFrame:
    """Analysis, plan, its steps, then those of ``last``; the score before and after and the improvement.

    The plan and the score before travel with the image, so nothing is joined,
    and the image is measured where its steps run. ``unscaled`` has what it was
    before a last ``widening``. Without ``pixels`` the widened image, over a
    million pixels, never leaves its task; see :func:`measured_widened`.
    """

    def run(pictures: pd.Series, height: pd.Series, width: pd.Series, plans: pd.Series) -> pd.DataFrame:
        out, narrow = [], []
        for p, h, w, plan in zip(pictures, height, width, plans, strict=True):
            before, _, after = plan.rpartition(",")
            x, done = _after(np.asarray(p).reshape(h, w), before if after == "widening" else plan)
            unscaled = {"height": x.shape[0], "width": x.shape[1], "applied": ",".join(done)} | dict(zip(MEASURES[:2], (float(x.mean()), float(x.std())) if x.size else (None, None), strict=True))
            if after == "widening" and pixels:
                x, more = _after(x, after)
                done += more
            elif after == "widening" and x.size:
                narrow.append((len(out), x))
                done.append(after)
            out.append([*x.shape, ",".join(done), unscaled, *([x.ravel().astype(np.int32), *measured(x)] if pixels else [] if after == "widening" and x.size else measured(x))])
        for (k, _), (h, w, *found) in zip(narrow, measured_widened([x for _, x in narrow]), strict=True):
            out[k] = [h, w, *out[k][2:], *found]
        return pd.DataFrame(out, columns=names)

    names = ["height", "width", "applied", "unscaled", *["pixels"] * pixels, *MEASURES]
    kinds = {"applied": "string", "unscaled": "struct<height:int,width:int,applied:string,brightness:double,contrast:double>", "pixels": "array<int>", "height": "int", "width": "int"}
    plan = F.concat_ws(",", F.when(F.col("steps") != "", F.col("steps")), F.lit(last))
    done = F.pandas_udf(run, ", ".join(f"{c} {kinds.get(c, 'double')}" for c in names))("pixels", "height", "width", plan)
    out = analysed(images).select("image_id", F.col("overall_score").alias("score_before"), F.col("enhancements_needed").alias("enhancements_applied"), done.alias("done")).select("*", "done.*").drop("done")
    after = enhancement_plan(full_quality(out)).withColumnRenamed("overall_score", "score_after")
    return after.withColumns({"improvement": F.col("score_after") - F.col("score_before"), "recommended": F.col("score_after") >= 70})


def processing_log(images: DataFrame, angles: DataFrame, most: int = 2000, denoise: bool = True, deskew: bool = True, contrast: bool = True) -> DataFrame:
    """What the standard chain does to each image (``image_id, height, width``), in order, and the size it gives.

    The skew comes from :func:`dominant_angle`; an image without usable
    contours, or with less than half a degree, is logged with none.
    """
    rows = images.join(angles.select("image_id", F.when(F.col("rotate"), F.col("angle")).alias("skew")), "image_id", "left").withColumn("skew", F.coalesce("skew", F.lit(0.0)))
    steps = F.array(
        F.when(F.lit(denoise), F.lit("denoise")), F.when(F.lit(deskew), F.format_string("deskew_%.2fdeg", "skew")), F.when(F.lit(contrast), F.lit("enhance_contrast")),
        F.when(F.col("width") > most, F.lit(f"resize_to_{most}px")),
    )
    size = fitted_size(F.col("width"), F.col("height"), most)
    return rows.select("image_id", F.array_join(F.array_compact(steps), ",").alias("steps"), size["width"].alias("width"), size["height"].alias("height"))


def from_images(files: DataFrame) -> DataFrame:
    """``image`` structs of Spark's image source as grey rasters; bytes come as blue, green, red."""
    i = F.col("image")

    def gray(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for k, h, w, n, data in zip(f["image_id"], f["height"], f["width"], f["n"], f["data"], strict=True):
                x = np.frombuffer(data, np.uint8).reshape(h, w, n)
                g = x[..., 0] if n == 1 else np.rint(x[..., 0] * 0.114 + x[..., 1] * 0.587 + x[..., 2] * 0.299)
                out.append((k, h, w, g.ravel().astype(np.int32)))
            yield pd.DataFrame(out, columns=RASTERS.names)

    rows = files.select(F.xxhash64(i["origin"]).alias("image_id"), i["height"].alias("height"), i["width"].alias("width"), i["nChannels"].alias("n"), i["data"].alias("data"))
    return rows.mapInPandas(gray, RASTERS)
