"""Queries over resampled and filtered images, each with SQL over their pixels."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallysheet.operators import raster
from tallysheet.plans.catalog import summed
from tallysheet.plans.registry import query
from tallysheet.sources import relations as R


def grey(x: str) -> str:
    """The grey of an exact value."""
    return f"CAST(least(greatest(round_even({x}, 0), 0), 255) AS BIGINT)"


def sums(source: str, width: int) -> str:
    return f"SELECT image_id, CAST(sum(v) AS BIGINT) AS total, CAST(sum(v * (r * {width} + c + 1)) AS BIGINT) AS placed FROM {source} GROUP BY image_id"


def mirrored(at: str, size: int) -> str:
    return f"CASE WHEN {at} < 0 THEN -({at}) WHEN {at} >= {size} THEN {2 * size - 2} - ({at}) ELSE {at} END"


def resampled_sql(source: str, old: int, new: int, name: str) -> str:
    """Cubic convolution: the weights of one side serve both."""
    return f"""{name}_at AS (SELECT n, k, floor(mid) AS f, abs(mid - floor(mid) - k) AS d FROM (SELECT n, (n + CAST(0.5 AS DOUBLE)) * {old} / {new} - 0.5 AS mid FROM range({new}) t(n)), (VALUES (-1), (0), (1), (2)) o(k)),
{name}_w AS (SELECT n, least(greatest(f + k, 0), {old - 1}) AS src, CASE WHEN d <= 1 THEN 1.25 * d * d * d - 2.25 * d * d + 1 ELSE -0.75 * d * d * d + 3.75 * d * d - 6 * d + 3 END AS w FROM {name}_at),
{name} AS (SELECT g.image_id, a.n AS r, b.n AS c, {grey("round(sum(a.w * b.w * g.v), 6)")} AS v FROM {source} g JOIN {name}_w a ON g.r = a.src JOIN {name}_w b ON g.c = b.src GROUP BY g.image_id, a.n, b.n)"""


def equalised_sql(source: str, size: int, grid: int, clip: int, name: str) -> str:
    """Equalisation by tiles, the image being mirrored up to whole ones."""
    t = -(-size // grid)
    most = max(1, int(clip * t * t / 256))
    return f"""{name}_wide AS (SELECT g.image_id, y.n AS r, x.n AS c, g.v FROM {source} g JOIN range({grid * t}) y(n) ON g.r = {mirrored("y.n", size)} JOIN range({grid * t}) x(n) ON g.c = {mirrored("x.n", size)}),
{name}_cnt AS (SELECT image_id, r // {t} AS tr, c // {t} AS tc, v AS g, count(*) AS n FROM {name}_wide GROUP BY ALL),
{name}_til AS (SELECT image_id, tr, tc, CAST(sum(greatest(n - {most}, 0)) AS BIGINT) AS over FROM {name}_cnt GROUP BY image_id, tr, tc),
{name}_bin AS (SELECT t.image_id, t.tr, t.tc, b.g, least(coalesce(n, 0), {most}) + over // 256 + CASE WHEN b.g % (256 // greatest(over % 256, 1)) = 0 AND b.g // (256 // greatest(over % 256, 1)) < over % 256 THEN 1 ELSE 0 END AS n
  FROM {name}_til t CROSS JOIN range(256) b(g) LEFT JOIN {name}_cnt k ON k.image_id = t.image_id AND k.tr = t.tr AND k.tc = t.tc AND k.g = b.g),
{name}_lut AS (SELECT image_id, tr, tc, g, least(round_even(CAST(sum(n) OVER (PARTITION BY image_id, tr, tc ORDER BY g) AS DOUBLE) * 255 / {t * t}, 0), 255) AS m FROM {name}_bin),
{name}_pos AS (SELECT *, CAST(r AS DOUBLE) / {t} - 0.5 AS y, CAST(c AS DOUBLE) / {t} - 0.5 AS x FROM {source}),
{name}_sum AS (SELECT p.image_id, p.r, p.c, sum(m * CASE WHEN k.i = 0 THEN 1 - (y - floor(y)) ELSE y - floor(y) END * CASE WHEN k.j = 0 THEN 1 - (x - floor(x)) ELSE x - floor(x) END) AS v
  FROM {name}_pos p, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) k(i, j), {name}_lut l WHERE l.image_id = p.image_id AND l.g = p.v AND l.tr = least(greatest(floor(y) + k.i, 0), {grid - 1}) AND l.tc = least(greatest(floor(x) + k.j, 0), {grid - 1}) GROUP BY p.image_id, p.r, p.c),
{name} AS (SELECT image_id, r, c, {grey("v")} AS v FROM {name}_sum)"""


def strokes_sql(source: str, size: int, name: str) -> str:
    return f"""{name} AS (SELECT g.image_id, g.r, g.c, {grey("CAST(sum(n.v * CASE abs(y.o) + abs(x.o) WHEN 0 THEN 7 WHEN 1 THEN -1 ELSE -0.5 END) AS DOUBLE)")} AS v FROM {source} g, range(-1, 2) y(o), range(-1, 2) x(o), {source} n
  WHERE n.image_id = g.image_id AND n.r = {mirrored("g.r + y.o", size)} AND n.c = {mirrored("g.c + x.o", size)} GROUP BY g.image_id, g.r, g.c)"""


def bilateral_sql(source: str, size: int, name: str) -> str:
    return f"""{name}_gap AS (SELECT g.image_id, g.r, g.c, n.v, exp(-CAST(y.o * y.o + x.o * x.o AS DOUBLE) / 11250 - CAST((n.v - g.v) * (n.v - g.v) AS DOUBLE) / 11250) AS w FROM {source} g, range(-4, 5) y(o), range(-4, 5) x(o), {source} n
  WHERE y.o * y.o + x.o * x.o <= 16 AND n.image_id = g.image_id AND n.r = {mirrored("g.r + y.o", size)} AND n.c = {mirrored("g.c + x.o", size)}),
{name} AS (SELECT image_id, r, c, {grey("round(sum(w * v) / sum(w), 6)")} AS v FROM {name}_gap GROUP BY image_id, r, c)"""


def stepped(spark, d, steps: str):
    """The size and the sums of each image after some steps."""
    return raster.apply_steps(R.rasters(spark, d).withColumn("steps", F.lit(steps))).select("image_id", *summed("pixels"))


@query("i15_upscaled", f"WITH {R.RASTERS_SQL}, {resampled_sql('grid', 8, 24, 'big')} {sums('big', 24)}")
def upscaled(spark, d):
    """Small images grow threefold."""
    return stepped(spark, d, "upscaling")


@query("i14_fitted", f"WITH {R.RASTERS_SQL}, {resampled_sql('grid', 8, 5, 'small')} {sums('small', 5)}")
def fitted(spark, d):
    """Wide images shrink to a greatest width, here five."""
    return stepped(spark, d, "fitted_to_five")


@query("i15_i18_widened", f"WITH {R.RASTERS_SQL}, {resampled_sql('grid', 8, 13, 'wide')} {sums('wide', 13)}")
def widened(spark, d):
    """The last scaling, here to a width of thirteen."""
    return stepped(spark, d, "widened_to_thirteen")


@query("i12_bilateral", f"WITH {R.RASTERS_SQL}, {bilateral_sql('grid', 8, 'smooth')} {sums('smooth', 8)}")
def bilateral(spark, d):
    return stepped(spark, d, "bilateral")


@query("i16_gaussian_threshold", f"""WITH {R.RASTERS_SQL}, bell AS (SELECT o, exp(-CAST(o * o AS DOUBLE) / 8) / sum(exp(-CAST(o * o AS DOUBLE) / 8)) OVER () AS w FROM range(-5, 6) t(o)),
loc AS (SELECT g.image_id, g.r, g.c, any_value(g.v) AS v, round_even(round(sum(y.w * x.w * n.v), 6), 0) AS m FROM grid g, bell y, bell x, grid n WHERE n.image_id = g.image_id AND n.r = least(greatest(g.r + y.o, 0), 7) AND n.c = least(greatest(g.c + x.o, 0), 7) GROUP BY g.image_id, g.r, g.c),
cut AS (SELECT image_id, r, c, CASE WHEN v > m - 2 THEN 255 ELSE 0 END AS v FROM loc) {sums('cut', 8)}""")
def gaussian_threshold(spark, d):
    return stepped(spark, d, "gaussian_threshold")


@query("i19_handwriting_chain", f"WITH {R.RASTERS_SQL}, {resampled_sql('grid', 8, 12, 'big')}, {equalised_sql('big', 12, 8, 3, 'even')}, {strokes_sql('even', 12, 'sharp')}, {bilateral_sql('sharp', 12, 'smooth')} {sums('smooth', 12)}")
def handwriting_chain(spark, d):
    """All steps before handwriting is recognised: larger, evened out, sharpened, smoothed."""
    return stepped(spark, d, raster.CHAINS["handwriting"])


@query("i19_chains")
def chains(spark, d):
    """Each image as each recogniser wants it; denoising in windows of 21 is beyond SQL, so the tests hold it against a plain version."""
    images = R.rasters(spark, d).repartition(spark.sparkContext.defaultParallelism, "image_id")
    return raster.prepared(images).select("image_id", "chain", "height", "width", "applied", *summed("pixels"))
