"""Queries over plug-ins, files, builders and the image chain, each with its SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tallysheet.functions.text import preview
from tallysheet.operators import layout, metadata, plugins, qr, raster
from tallysheet.plans.catalog import TEMPLATES_SQL
from tallysheet.plans.registry import query, rounded
from tallysheet.sources import files
from tallysheet.sources import relations as R
from tallysheet.sources.templates import templates
from tallysheet.streaming import search

# --- Engines as plug-ins -------------------------------------------------------


def mean_grey(image: np.ndarray) -> tuple[str, float]:
    """Reads a page's mean grey: a measuring plug-in."""
    return f" {int(image.mean())} ", image.mean() / 255


def darkest_grey(image: np.ndarray) -> tuple[str, float]:
    """Reads the darkest grey; a page without ink is an error."""
    if image.min() > 20:
        raise ValueError("no ink")
    return str(image.min()), 1 - image.min() / 255


def measuring_engines() -> plugins.Registry:
    registry = plugins.Registry()
    registry.register("mean_grey", mean_grey, priority=1, needs=("numpy",))
    registry.register("darkest_grey", darkest_grey, priority=2)
    registry.register("absent", mean_grey, priority=3, needs=("a_package_that_is_not_there",))
    return registry


@query("u1_u3_u6_k4_engines_by_images", f"""WITH {R.RASTERS_SQL}, m AS (SELECT image_id, avg(v) AS a, min(v) AS low FROM pix GROUP BY image_id)
SELECT image_id, 'mean_grey' AS engine_name, 0 AS pos, ' ' || CAST(CAST(floor(a) AS INTEGER) AS VARCHAR) || ' ' AS text, round(a / 255, 6) AS confidence, NULL AS error_message FROM m
UNION ALL SELECT image_id, 'darkest_grey', 1, CASE WHEN low > 20 THEN '' ELSE CAST(low AS VARCHAR) END, round(CASE WHEN low > 20 THEN 0 ELSE 1 - low / 255 END, 6), CASE WHEN low > 20 THEN 'no ink' END FROM m""")
def engines_by_images(spark, d):
    return rounded(measuring_engines().recognise(R.rasters(spark, d)).drop("processing_time"))


@query("o7_u3_cascade", f"""WITH {R.RESULTS_SQL}, s AS (SELECT *, coalesce(bool_or(error_message IS NULL AND regexp_replace(text, '^\\s+|\\s+$', '', 'g') <> '' AND confidence >= 0.7) OVER (PARTITION BY image_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), FALSE) AS done FROM ocr)
SELECT image_id, engine_name, text, round(confidence, 6) AS confidence, error_message FROM s WHERE NOT done""")
def cascade(spark, d):
    """Engines whose answers are recorded, each asked only about images that none before was sure of."""
    recorded = R.ocr_results(spark, d)
    images = R.table(spark, d, "events").select(F.col("user_id").alias("image_id")).distinct()
    run = lambda name, left: recorded.where(F.col("engine_name") == name).join(left, "image_id", "left_semi")
    order = [e[0] for e in sorted(R.ENGINES, key=lambda e: e[-1])]
    return rounded(plugins.cascade(run, images, order, 0.7).select("image_id", "engine_name", "text", "confidence", "error_message"))


@query("o7_search_windows", f"""WITH {R.CALLS_SQL}, w AS (SELECT *, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') + INTERVAL 6 HOUR AS window_end, error_message IS NULL AND regexp_replace(text, '^\\s+|\\s+$', '', 'g') <> '' AND confidence >= 0.6 AS sure FROM calls),
s AS (SELECT *, coalesce(bool_or(sure) OVER (PARTITION BY image_id, window_end ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), FALSE) AS done FROM w)
SELECT image_id, strftime(window_end, '%Y-%m-%d %H:%M') AS window_end, event_id, engine_name, round(confidence, 6) AS confidence FROM s WHERE NOT done""")
def search_windows(spark, d):
    """The early exit that :func:`search.until_confident` makes over a stream, over all calls at once."""
    found = search.until_confident_so_far(R.engine_calls(spark, d), 0.6, "6 hours")
    return rounded(found.withColumn("window_end", F.date_format("window_end", "yyyy-MM-dd HH:mm")))


@query("o5_first_wins_windows", """WITH w AS (SELECT event_id AS seq, user_id AS image_id, 'd' || CAST(event_id % 4 AS VARCHAR) AS data, 'r' || CAST(event_id % 3 AS VARCHAR) AS region, event_id % 3 AS region_rank, ts, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') + INTERVAL 6 HOUR AS window_end FROM events)
SELECT strftime(window_end, '%Y-%m-%d %H:%M') AS window_end, image_id, data, first(seq ORDER BY region_rank, ts, seq) AS seq, first(region ORDER BY region_rank, ts, seq) AS region, count(*) AS seen FROM w GROUP BY ALL""")
def first_wins_windows(spark, d):
    """The first of equal payloads of each window, as :func:`search.first_wins` finds it over a stream."""
    k = F.col("event_id")
    found = search.first_wins(R.table(spark, d, "events").select(k.alias("seq"), F.col("user_id").alias("image_id"), F.concat(F.lit("d"), k % 4).alias("data"), F.concat(F.lit("r"), k % 3).alias("region"), (k % 3).cast("int").alias("region_rank"), "ts"), "6 hours")
    return found.withColumn("window_end", F.date_format("window_end", "yyyy-MM-dd HH:mm"))


@query("s18_o17_previews", """SELECT doc_id, CASE WHEN length(text) > 100 THEN left(text, 100) || '...' ELSE text END AS short, CASE WHEN length(text) > 200 THEN left(text, 200) || '...' ELSE text END AS long FROM documents""")
def previews(spark, d):
    """What a terminal shows of a text."""
    t = F.col("text")
    return R.table(spark, d, "documents").select("doc_id", preview(t, 100).alias("short"), preview(t, 200).alias("long"))


@query("a13_mean_confidence", f"WITH {R.BOXES_SQL}, b AS (SELECT page_id, conf FROM boxes WHERE conf >= 10 AND length(text) >= 2) SELECT page_id, round(avg(conf), 6) AS mean_conf, count(*) AS boxes FROM b GROUP BY page_id")
def mean_confidence(spark, d):
    return rounded(layout.mean_confidence(layout.confident(R.word_boxes(spark, d), 10.0, 2, strictly=False)))


@query("p20_p21_u2_registry", """WITH e(engine_name, enabled, priority, config_pos) AS (VALUES ('mean_grey', TRUE, 1, 0), ('darkest_grey', TRUE, 2, 1), ('absent', FALSE, 3, 2))
SELECT asked, enabled, priority, config_pos, asks FROM (SELECT CASE event_id % 4 WHEN 0 THEN 'mean_grey' WHEN 1 THEN 'darkest_grey' WHEN 2 THEN 'absent' ELSE event_type END AS asked, count(*) AS asks FROM events GROUP BY ALL) LEFT JOIN e ON asked = engine_name""")
def registry_lookup(spark, d):
    """What is known of the engines that are asked for; nothing of unknown ones."""
    k = F.col("event_id") % 4
    asked = R.table(spark, d, "events").select(F.when(k == 0, "mean_grey").when(k == 1, "darkest_grey").when(k == 2, "absent").otherwise(F.col("event_type")).alias("asked"))
    known = measuring_engines().frame(spark)
    return asked.groupBy("asked").agg(F.count("*").alias("asks")).join(known, F.col("asked") == F.col("engine_name"), "left").select("asked", "enabled", "priority", "config_pos", "asks")


# --- Files -----------------------------------------------------------------------

PATHS_SQL = """p AS (SELECT page_id, url || '#' || CAST(page_id AS VARCHAR) || CASE page_id % 5 WHEN 0 THEN '.JPG' WHEN 1 THEN '.png' WHEN 2 THEN '.txt' WHEN 3 THEN '.Pdf' ELSE '' END AS path,
  CAST(length(html) AS BIGINT) * (page_id % 60) * 1024 AS length, CAST(page_id AS BIGINT) * 1000 + 250 AS ms FROM pages)"""


def paths(spark, d):
    """Every page as a file: a name with one of some suffixes or none, a size, a time."""
    k = F.col("page_id")
    suffix = F.element_at(F.array(*map(F.lit, (".JPG", ".png", ".txt", ".Pdf", ""))), (k % 5 + 1).cast("int"))
    return R.table(spark, d, "pages").select("page_id", F.concat("url", F.lit("#"), k.cast("string"), suffix).alias("path"), (F.char_length("html").cast("long") * (k % 60) * 1024).alias("length"), F.timestamp_millis(k.cast("long") * 1000 + 250).alias("modificationTime"))


@query("s3_file_checks", f"""WITH {PATHS_SQL}, s AS (SELECT *, lower(regexp_extract(path, '(\\.[^./]*)$', 1)) AS suffix FROM p)
SELECT path, CASE WHEN suffix NOT IN ('.jpg', '.jpeg', '.png', '.pdf') THEN 'unsupported suffix ' || suffix WHEN length > 52428800 THEN 'too large' END AS error, CASE WHEN suffix IN ('.jpg', '.jpeg', '.png', '.pdf') AND length <= 52428800 THEN round(length / 1048576, 6) END AS file_size_mb FROM s""")
def file_checks(spark, d):
    good, bad = files.checked(paths(spark, d))
    return rounded(good.select("path", F.lit(None).cast("string").alias("error"), "file_size_mb").unionByName(bad.select("path", "error", F.lit(None).cast("double").alias("file_size_mb"))))


@query("s5_source_files", f"WITH {PATHS_SQL} SELECT page_id, path AS source_file, CAST(ms AS DOUBLE) / 1000 AS extraction_timestamp FROM p")
def source_files(spark, d):
    found = paths(spark, d)
    return files.with_source(found.select("page_id", "path"), found).select("page_id", "source_file", "extraction_timestamp")


# --- Assignments -----------------------------------------------------------------


@query("j5_created_with_payload", """WITH w AS (SELECT o_orderkey AS request_id, 'Work ' || CAST(o_orderkey AS VARCHAR) AS name, o_orderpriority AS subject, CASE WHEN o_orderkey % 3 = 0 THEN 'Period ' || CAST(o_orderkey % 7 AS VARCHAR) ELSE 'Unknown' END AS period,
  CASE WHEN o_orderkey % 5 < 2 THEN o_orderkey % 5 * 60 ELSE 100 END AS points, o_orderdate AS made FROM orders),
a AS (SELECT *, 'AG_' || md5(name || '_' || strftime(made, '%Y%m%d_%H%M%S'))[:8] || '_' || strftime(made, '%H%M%S') AS assignment_id FROM w)
SELECT request_id, assignment_id, strftime(made, '%Y-%m-%d') AS due_date, '{"assignment_id":"' || assignment_id || '","assignment_name":"' || name || '","subject":"' || subject || '","class_period":"' || period || '","teacher_name":null,"due_date":"' || strftime(made, '%Y-%m-%d')
  || '","total_points":' || CAST(points AS VARCHAR) || ',"created_date":"' || strftime(made, '%Y-%m-%dT%H:%M:%S') || '","qr_version":"1.0"}' AS payload FROM a""")
def created_with_payload(spark, d):
    wanted = R.requests(spark, d).withColumnRenamed("custom_points", "total_points").drop("due_date").join(R.table(spark, d, "orders").select(F.col("o_orderkey").alias("request_id"), F.col("o_orderpriority").alias("subject")), "request_id")
    return metadata.created(wanted).select("request_id", "assignment_id", "due_date", "payload")


@query("p16_required_fields", f"""WITH {TEMPLATES_SQL}, {R.REQUESTS_SQL}, g AS (SELECT request_id, CASE WHEN request_id % 5 <> 0 THEN template_id END AS template_id, CASE WHEN request_id % 7 = 0 THEN '' ELSE assignment_name END AS name, CASE WHEN request_id % 11 <> 0 THEN due_date END AS due FROM req)
SELECT request_id, CASE WHEN g.template_id IS NULL THEN 'no template' WHEN g.name = '' THEN 'no name' WHEN due IS NULL THEN 'no due date' WHEN t.template_id IS NULL THEN 'unknown template ' || g.template_id WHEN due = 'soon' THEN 'due date is no date' END AS error,
  CASE WHEN t.template_id IS NOT NULL AND g.name <> '' AND due <> 'soon' THEN t.subject END AS subject FROM g LEFT JOIN tpl t ON g.template_id = t.template_id""")
def required_fields(spark, d):
    k = F.col("request_id")
    asked = R.requests(spark, d).withColumns({"template_id": F.when(k % 5 != 0, F.col("template_id")), "assignment_name": F.when(k % 7 == 0, "").otherwise(F.col("assignment_name")), "due_date": F.when(k % 11 != 0, F.col("due_date"))})
    return metadata.instantiate(asked, templates(spark)).select("request_id", "error", "subject")


@query("j7_builder", f"""WITH {TEMPLATES_SQL}, o AS (SELECT *, ['fractions_intro', 'ratios_review', 'angles_practice'][o_orderkey % 3 + 1] AS template_id FROM orders)
SELECT o_orderkey AS request_id, o.template_id, upper(subject)[:3] || '-' || strftime(o_orderdate, '%Y%m%d') || '-' || upper(md5(CAST(o_orderkey AS VARCHAR))[:8]) AS assignment_id, 'Sheet ' || o_orderkey AS assignment_name, strftime(o_orderdate + INTERVAL 14 DAY, '%Y-%m-%d') AS due_date,
  'Period 2' AS class_period, 'T.' AS teacher_name, coalesce(nullif(CAST(o_orderkey % 90 AS INTEGER), 0), total_points) AS total_points, CAST(year(o_orderdate) - CASE WHEN month(o_orderdate) >= 8 THEN 0 ELSE 1 END AS VARCHAR) || '-' || CAST(year(o_orderdate) + CASE WHEN month(o_orderdate) >= 8 THEN 1 ELSE 0 END AS VARCHAR) AS academic_year
FROM o JOIN tpl ON o.template_id = tpl.template_id""")
def builder(spark, d):
    """One builder makes an assignment for every order; some of its parts are the same for all."""
    k, day = F.col("request_id"), F.col("created_at")
    orders = R.table(spark, d, "orders").select(F.col("o_orderkey").alias("request_id"), F.col("o_orderdate").alias("created_at"))
    chosen = F.element_at(F.array(*map(F.lit, ("fractions_intro", "ratios_review", "angles_practice"))), (k % 3 + 1).cast("int"))
    made = metadata.AssignmentBuilder(templates(spark)).template(chosen).name(F.concat(F.lit("Sheet "), k.cast("string"))).due(F.date_format(F.date_add(day, 14), "yyyy-MM-dd")).period("Period 2").teacher("T.").worth(k % 90).build_each(orders)
    return made.select("request_id", F.col("additional_data")["template_id"].alias("template_id"), "assignment_id", "assignment_name", "due_date", "class_period", "teacher_name", "total_points", "academic_year")


# --- Images ----------------------------------------------------------------------


@query("i21_page_position", f"""WITH {R.DETECTIONS_SQL}, i AS (SELECT c_custkey AS image_id, CAST(400 + c_custkey % 900 AS INTEGER) AS width, CAST(300 + c_custkey % 700 AS INTEGER) AS height FROM customer)
SELECT d.image_id, seq, d.x + least(CAST(floor(g.x * width) AS INTEGER), width) AS page_x, d.y + least(CAST(floor(g.y * height) AS INTEGER), height) AS page_y FROM det d JOIN i ON d.image_id = i.image_id JOIN regions g ON d.region = g.region""")
def page_position(spark, d):
    k = F.col("c_custkey")
    images = R.table(spark, d, "customer").select(k.alias("image_id"), (400 + k % 900).cast("int").alias("width"), (300 + k % 700).cast("int").alias("height"))
    return qr.page_position(R.qr_detections(spark, d), qr.region_boxes(images, R.regions(spark))).select("image_id", "seq", "page_x", "page_y")


@query("i23_processing_log", """WITH i AS (SELECT p_partkey AS image_id, 300 + p_partkey * 37 % 2500 AS w, 200 + p_partkey * 53 % 1900 AS h FROM part),
c AS (SELECT l_partkey AS image_id, l_quantity AS area, CAST(l_suppkey % 181 - 90 AS DOUBLE) AS angle FROM lineitem WHERE l_quantity > 20),
t AS (SELECT image_id, CASE WHEN angle < -45 THEN angle + 90 WHEN angle > 45 THEN angle - 90 ELSE angle END AS a FROM c QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY area DESC, angle) <= 10),
m AS (SELECT image_id, median(a) AS a FROM t GROUP BY image_id)
SELECT i.image_id, printf('denoise,deskew_%.2fdeg,enhance_contrast', CASE WHEN abs(a) >= 0.5 THEN a ELSE 0 END + 0.0) || CASE WHEN w > 2000 THEN ',resize_to_2000px' ELSE '' END AS steps,
  CAST(least(w, 2000) AS INTEGER) AS width, CAST(CASE WHEN w > 2000 THEN floor(CAST(h AS DOUBLE) / w * 2000) ELSE h END AS INTEGER) AS height FROM i LEFT JOIN m ON i.image_id = m.image_id""")
def processing_log(spark, d):
    k = F.col("p_partkey")
    images = R.table(spark, d, "part").select(k.alias("image_id"), (300 + k * 37 % 2500).cast("int").alias("width"), (200 + k * 53 % 1900).cast("int").alias("height"))
    contours = R.table(spark, d, "lineitem").select(F.col("l_partkey").alias("image_id"), F.col("l_quantity").alias("area"), (F.col("l_suppkey") % 181 - 90).cast("double").alias("angle"), F.lit(20000.0).alias("image_area"))
    return raster.processing_log(images, raster.dominant_angle(contours))
