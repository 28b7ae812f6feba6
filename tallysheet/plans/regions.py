"""Queries over regions of connected pixels, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallysheet.operators import contours, raster
from tallysheet.plans.registry import query, rounded
from tallysheet.sources import relations as R

#: Pixels of objects and, by reaching out from pixel to pixel, the least pixel that each is connected with.
REGIONS_SQL = f"""{R.RASTERS_SQL}, gc AS (SELECT image_id, v AS g, count(*) AS n FROM pix GROUP BY ALL),
gw AS (SELECT *, sum(n) OVER w AS w0, sum(n * g) OVER w AS s0, sum(n) OVER (PARTITION BY image_id) AS w, sum(n * g) OVER (PARTITION BY image_id) AS s FROM gc WINDOW w AS (PARTITION BY image_id ORDER BY g)),
gt AS (SELECT image_id, first(g ORDER BY coalesce(round(CAST(w0 AS DOUBLE) * (w - w0) * (s0 / w0 - (s - s0) / nullif(w - w0, 0)) ^ 2, 6), 0) DESC, g) AS level FROM gw GROUP BY image_id),
tu AS (SELECT image_id, level, count(*) FILTER (v > level) * 255.0 / count(*) < 127 AS dark FROM pix JOIN gt USING (image_id) GROUP BY image_id, level),
obj AS (SELECT image_id, r, c FROM grid JOIN tu USING (image_id) WHERE (v > level) <> dark),
near AS (SELECT a.image_id, a.r * 8 + a.c AS p, b.r * 8 + b.c AS q FROM obj a JOIN obj b ON a.image_id = b.image_id AND abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1),
reach AS (SELECT image_id, p, q FROM near UNION SELECT reach.image_id, reach.p, near.q FROM reach JOIN near ON reach.image_id = near.image_id AND reach.q = near.p),
lab AS (SELECT image_id, p, min(q) AS region FROM reach GROUP BY image_id, p)"""


@query("i13_regions", f"WITH RECURSIVE {REGIONS_SQL} SELECT image_id, region, count(*) AS area, min(p % 8) AS first_column, max(p // 8) AS last_row FROM lab GROUP BY image_id, region")
def regions(spark, d):
    found = contours.regions(R.rasters(spark, d))
    side = lambda c, f: f(F.transform("points", lambda p: p[c])).cast("long")
    return found.select("image_id", "region", "area", side("x", F.array_min).alias("first_column"), side("y", F.array_max).alias("last_row"))


#: A side of the hull leaves every point of the region on one side of its line.
RECTANGLES_SQL = f"""{REGIONS_SQL}, pt AS (
  SELECT image_id, region, p // 8 AS y, unnest(CASE WHEN min(p % 8) = max(p % 8) THEN [min(p % 8)] ELSE [min(p % 8), max(p % 8)] END) AS x FROM lab GROUP BY image_id, region, p // 8),
sid AS (SELECT a.image_id, a.region, a.x AS ax, a.y AS ay, b.x - a.x AS dx, b.y - a.y AS dy FROM pt a JOIN pt b ON a.image_id = b.image_id AND a.region = b.region AND (a.x <> b.x OR a.y <> b.y)),
ext AS (
  SELECT sid.image_id, sid.region, dx, dy, ax, ay, max(x * dx + y * dy) - min(x * dx + y * dy) AS on_, max(y * dx - x * dy) - min(y * dx - x * dy) AS off_
  FROM sid JOIN pt ON pt.image_id = sid.image_id AND pt.region = sid.region GROUP BY sid.image_id, sid.region, dx, dy, ax, ay HAVING min(dx * (y - ay) - dy * (x - ax)) >= 0),
deg AS (SELECT *, round(on_ * off_ / CAST(dx * dx + dy * dy AS DOUBLE), 6) AS size, degrees(atan2(CAST(dy AS DOUBLE), CAST(dx AS DOUBLE))) AS t FROM ext),
box AS (SELECT image_id, region, min({{'a': size, 'b': round(CASE WHEN t - 90 * floor(t / 90) > 45.000001 THEN t - 90 * floor(t / 90) - 90 ELSE t - 90 * floor(t / 90) END, 6) + 0.0}}) AS s FROM deg GROUP BY image_id, region),
rec AS (SELECT lab.image_id, lab.region, count(*) AS area, any_value(coalesce(s.a, 0)) AS rectangle_area, any_value(coalesce(s.b, 0)) AS angle FROM lab LEFT JOIN box ON lab.image_id = box.image_id AND lab.region = box.region GROUP BY lab.image_id, lab.region)"""


@query("i13_smallest_rectangles", f"WITH RECURSIVE {RECTANGLES_SQL} SELECT image_id, region, area, round(rectangle_area, 6) AS rectangle_area, round(angle, 6) + 0.0 AS angle FROM rec")
def smallest_rectangles(spark, d):
    return rounded(contours.rectangles(R.rasters(spark, d)).select("image_id", "region", "area", "rectangle_area", "angle"))


@query("i13_skew_of_regions", f"""WITH RECURSIVE {RECTANGLES_SQL}, few AS (SELECT * FROM rec WHERE area > 64 * 0.001 QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY area DESC, angle) <= 10),
med AS (SELECT image_id, CAST(median(angle) AS DOUBLE) AS angle, count(*) AS contours FROM few GROUP BY image_id)
SELECT image_id, round(angle, 6) + 0.0 AS angle, contours, abs(angle) >= 0.5 AS rotate FROM med""")
def skew_of_regions(spark, d):
    """The whole way from pixels to skew."""
    return rounded(raster.dominant_angle(contours.rectangles(R.rasters(spark, d))).drop("step"))
