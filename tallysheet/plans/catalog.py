"""Queries by name over the driver tables, each with its SQL where SQL can express it.

Names begin with the rows of the inventory they cover. Doubles are rounded to
six places on both sides, since sums may be taken in any order; means of a few
numbers of few digits, which would tie at the sixth place, to ten.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tallysheet.functions import text as T
from tallysheet.functions import validate as V
from tallysheet.operators import layout, metadata, qr, raster, reports, running, votes
from tallysheet.plans import sql_text as S
from tallysheet.plans.registry import ORACLE_SQL, QUERIES, query, rounded
from tallysheet.sources import relations as R
from tallysheet.sources.templates import BUILT_IN, templates

OK = "error_message IS NULL AND regexp_replace(text, '^\\s+|\\s+$', '', 'g') <> ''"
BEST = "first({0} ORDER BY confidence DESC, priority, engine_name)"
USABLE = f"{R.RESULTS_SQL}, ok AS (SELECT *, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS said FROM ocr WHERE {OK})"
R6 = "round({0}, 6)"
WEIGHTED = f"""w AS (SELECT image_id, {BEST.format('text')} AS text, CASE WHEN count(*) = 1 THEN max(confidence) ELSE coalesce(sum(confidence * confidence) / nullif(sum(confidence), 0), {BEST.format('confidence')}) END AS confidence,
  CASE WHEN count(*) = 1 THEN 'single_result' ELSE 'weighted_vote' END AS method FROM ok GROUP BY image_id)"""


# --- Votes ---------------------------------------------------------------------


@query("a1_highest_confidence", f"WITH {USABLE} SELECT image_id, {BEST.format('text')} AS text, round(max(confidence), 6) AS confidence, 'highest_confidence' AS method FROM ok GROUP BY image_id")
def highest_confidence(spark, d):
    return rounded(votes.highest_confidence(R.ocr_results(spark, d)))


@query("a2_weighted_vote", f"WITH {USABLE}, {WEIGHTED} SELECT image_id, text, round(confidence, 6) AS confidence, method FROM w")
def weighted_vote(spark, d):
    return rounded(votes.weighted_vote(R.ocr_results(spark, d)))


@query("a3_consensus", f"""WITH {USABLE}, g AS (SELECT image_id, said, count(*) AS n, avg(confidence) AS mean, min(priority * 1000000 + ascii(engine_name)) AS f FROM ok GROUP BY ALL)
SELECT image_id, said AS text, round(least(mean + least(n * 0.1, 0.3), 1.0), 6) AS confidence, 'consensus' AS method FROM g QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY n DESC, f) = 1""")
def consensus(spark, d):
    return rounded(votes.consensus(R.ocr_results(spark, d)))


@query("a4_first_success", f"WITH {USABLE} SELECT image_id, first(text ORDER BY pos, engine_name) AS text, round(first(confidence ORDER BY pos, engine_name), 6) AS confidence, 'first_success' AS method FROM ok GROUP BY image_id")
def first_success(spark, d):
    return rounded(votes.first_success(R.ocr_results(spark, d)))


@query("a5_aggregate", f"""WITH {USABLE}, {WEIGHTED} SELECT i.image_id, coalesce(text, '') AS text, round(coalesce(confidence, 0), 6) AS confidence, coalesce(method, 'no_results') AS method
FROM (SELECT DISTINCT c_custkey AS image_id FROM customer) i LEFT JOIN w ON i.image_id = w.image_id""")
def aggregate(spark, d):
    images = R.table(spark, d, "customer").select(F.col("c_custkey").alias("image_id"))
    return rounded(votes.aggregate(R.ocr_results(spark, d), images))


QUALITY_SQL = f"""q AS (SELECT o.image_id, count(*) AS total, count(*) FILTER (error_message IS NULL) AS good, count(DISTINCT CASE WHEN {OK.replace('text', 'o.text')} THEN regexp_replace(o.text, '^\\s+|\\s+$', '', 'g') END) AS texts,
  avg(processing_time) FILTER (error_message IS NULL) AS t, stddev_pop(o.confidence) FILTER (error_message IS NULL) AS sd, any_value(w.confidence) AS mean FROM ocr o LEFT JOIN w ON o.image_id = w.image_id GROUP BY o.image_id)"""


@query("a6_a9_quality", f"""WITH {USABLE}, {WEIGHTED}, {QUALITY_SQL}
SELECT image_id, CASE WHEN good = 0 THEN 'poor' WHEN mean >= 0.8 THEN 'excellent' WHEN mean >= 0.6 THEN 'good' WHEN mean >= 0.4 THEN 'fair' ELSE 'poor' END AS overall_quality,
  round(CASE WHEN texts = 0 THEN 0 ELSE 1.0 / texts END, 6) AS engine_agreement, round(CASE WHEN good = 0 THEN 0 ELSE greatest(0, 1 - t / 60) END, 10) AS processing_efficiency,
  round(CASE WHEN good = 0 THEN 0 WHEN good = 1 THEN 1 ELSE greatest(0, 1 - sd) END, 6) AS confidence_consistency, nullif(good, 0) AS successful_engines, CASE WHEN good > 0 THEN total END AS total_engines FROM q""")
def quality(spark, d):
    results = R.ocr_results(spark, d)
    return rounded(votes.quality(results, votes.weighted_vote(results)), processing_efficiency=10)


@query("a10_a11_a27_engine_statistics", f"""WITH {R.ENGINES_SQL}, {R.CALLS_SQL}
SELECT e.engine_name, enabled, count(event_id) AS total_calls, count(*) FILTER ({OK}) AS successful_calls, round(coalesce(sum(processing_time), 0), 6) AS total_time,
  round(coalesce(avg(confidence) FILTER ({OK}), 0), 10) AS average_confidence, round(coalesce(CAST(count(*) FILTER ({OK}) AS DOUBLE) / nullif(count(event_id), 0), 0), 6) AS success_rate
FROM engines e LEFT JOIN calls c ON e.engine_name = c.engine_name GROUP BY e.engine_name, enabled""")
def engine_statistics(spark, d):
    return rounded(votes.engine_statistics(R.engine_calls(spark, d), R.engines(spark)), average_confidence=10)


@query("a10_running_means", f"""WITH RECURSIVE {R.CALLS_SQL}, num AS (SELECT engine_name, event_id, confidence, error_message IS NULL AS ran, {OK} AS good, row_number() OVER (PARTITION BY engine_name ORDER BY ts, event_id) AS k FROM calls),
run AS (SELECT DISTINCT engine_name, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS event_id, CAST(0 AS BIGINT) AS n, CAST(0 AS DOUBLE) AS m FROM num
  UNION ALL SELECT r.engine_name, num.k, num.event_id, r.n + CAST(good AS BIGINT), CASE WHEN ran AND r.n + CAST(good AS BIGINT) > 0 THEN (m * (r.n + CAST(good AS BIGINT) - 1) + confidence) / (r.n + CAST(good AS BIGINT)) ELSE m END
  FROM run r JOIN num ON num.engine_name = r.engine_name AND num.k = r.k + 1)
SELECT engine_name, event_id, n AS successful_calls, round(m, 10) AS average_confidence FROM run WHERE k > 0""")
def running_means(spark, d):
    return rounded(running.running_means(R.engine_calls(spark, d)), average_confidence=10)


@query("a23_compare_engines", f"WITH {R.CALLS_SQL} SELECT image_id, engine_name, count(*) AS calls, round(max(confidence), 6) AS best, round(avg(confidence), 10) AS mean, count(error_message) AS failures FROM calls GROUP BY ALL")
def compare_engines(spark, d):
    return rounded(votes.compare_engines(R.engine_calls(spark, d)), mean=10)


@query("a26_engines_used", f"WITH {R.RESULTS_SQL} SELECT image_id, coalesce(string_agg(engine_name, ',' ORDER BY priority, engine_name) FILTER ({OK}), '') AS engines_used, string_agg(engine_name, ',' ORDER BY priority, engine_name) AS engines_run FROM ocr GROUP BY image_id")
def engines_used(spark, d):
    return votes.engines_used(R.ocr_results(spark, d))


@query("p1_o1_engine_order", f"WITH {R.CONFIGURED_SQL} SELECT engine_name, row_number() OVER (ORDER BY coalesce(priority, 999), config_pos) AS engine_rank FROM configured WHERE enabled")
def engine_order(spark, d):
    return votes.enabled(R.configured_engines(spark, d)).select("engine_name", "engine_rank")


@query("p2_successful", f"WITH {USABLE} SELECT image_id, engine_name, said, round(confidence, 6) AS confidence FROM ok")
def successful(spark, d):
    return rounded(votes.successful(R.ocr_results(spark, d)).select("image_id", "engine_name", T.strip(F.col("text")).alias("said"), "confidence"))


@query("o7_early_exit", f"""WITH {R.RESULTS_SQL}, s AS (SELECT *, coalesce(bool_or({OK} AND confidence >= 0.9) OVER (PARTITION BY image_id ORDER BY priority, pos, engine_name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), FALSE) AS done FROM ocr)
SELECT image_id, engine_name, round(confidence, 6) AS confidence FROM s WHERE NOT done""")
def early_exit(spark, d):
    return rounded(votes.until_confident(R.ocr_results(spark, d)).select("image_id", "engine_name", "confidence"))


@query("t29_p13_p19_response", f"""WITH {USABLE}, {WEIGHTED}, texts AS (SELECT image_id AS id, text FROM w WHERE text <> ''), {S.corrected_ctes()[0]}, f AS (SELECT id, original, CASE WHEN {S.expression_sql('text')} THEN text ELSE original END AS final_text FROM fixed)
SELECT w.image_id, final_text, round(confidence, 6) AS confidence, method, final_text <> original AS symbol_corrections_applied, length(final_text) AS character_count, t.total_time,
  confidence >= 0.5 AND t.total_time <= 15 AND length(final_text) >= 2 AS passed, CASE WHEN t.total_time <= 5 THEN 'excellent' WHEN t.total_time <= 10 THEN 'good' ELSE 'slow' END AS speed
FROM w JOIN f ON w.image_id = f.id JOIN (SELECT image_id, round(sum(processing_time), 6) AS total_time FROM ocr GROUP BY image_id) t ON w.image_id = t.image_id""")
def response(spark, d):
    """The texts of these calls have two characters, so runs pass from two; the operator's own bound is ten."""
    results = R.ocr_results(spark, d)
    out = votes.corrected_aggregate(votes.weighted_vote(results)).withColumn("success", F.lit(True))
    times = results.groupBy("image_id").agg(F.round(F.sum("processing_time"), 6).alias("total_time"))
    return rounded(votes.passes(out.join(times, "image_id"), least_characters=2).drop("success"))


@query("a25_before_and_after", f"""WITH {USABLE}, a AS (SELECT image_id, max(confidence) AS c, max(length(text)) AS n, sum(processing_time) AS t FROM ok GROUP BY image_id),
b AS (SELECT image_id, first(confidence ORDER BY pos, engine_name) AS c, first(length(text) ORDER BY pos, engine_name) AS n, first(processing_time ORDER BY pos, engine_name) AS t FROM ok GROUP BY image_id)
SELECT a.image_id, round(a.c - b.c, 6) AS confidence_change, a.n - b.n AS character_count_change, round(a.t - b.t, 6) AS total_time_change FROM a JOIN b ON a.image_id = b.image_id""")
def before_and_after(spark, d):
    ok = votes.successful(R.ocr_results(spark, d))
    n = F.char_length("text").cast("long")
    after = ok.groupBy("image_id").agg(F.max("confidence").alias("confidence"), F.max(n).alias("character_count"), F.sum("processing_time").alias("total_time"))
    first = F.min_by(F.struct("confidence", n.alias("character_count"), F.col("processing_time").alias("total_time")), F.struct("pos", "engine_name"))
    return rounded(votes.before_and_after(ok.groupBy("image_id").agg(first.alias("f")).select("image_id", "f.*"), after))


# --- Text ----------------------------------------------------------------------


@query("t1_t10_corrector", S.corrector_query())
def corrector(spark, d):
    return R.math_texts(spark, d).select("id", T.corrected(F.col("text")).alias("corrected"))


@query("t5_a14_correction_types", S.types_query())
def correction_types(spark, d):
    return reports.correction_counts(T.with_substitution_types(R.math_texts(spark, d)).select("types"))


@query("t11_t12_tesseract_notation", S.rule_query(S.PRINTED, S.COLLAPSED))
def tesseract_notation(spark, d):
    return R.math_texts(spark, d).select("id", T.tesseract_notation(F.col("text")).alias("fixed"))


@query("t13_easyocr_symbols", S.rule_query(S.EASY))
def easyocr_symbols(spark, d):
    return R.math_texts(spark, d).select("id", T.easyocr_symbols(F.col("text")).alias("fixed"))


@query("t14_handwriting_cleanup", S.rule_query(S.HAND))
def handwriting_cleanup(spark, d):
    return R.math_texts(spark, d).select("id", T.handwriting_cleanup(F.col("text")).alias("fixed"))


@query("t16_t19_formulas", S.formula_query())
def formulas(spark, d):
    f = F.col("text")
    rows = R.math_texts(spark, d).select("id", T.formula_analysis(f).alias("a"), T.to_latex(f).alias("latex"), T.character_count(f).cast("long").alias("characters"), T.preview(f).alias("preview"))
    return rounded(rows.select("id", "a.type", "a.type_confidence", F.array_join("a.components", ",").alias("components"), "a.complexity", "a.confidence", "latex", "characters", "preview"))


@query("v1_v4_t28_validation", S.validation_query())
def validation(spark, d):
    rows = reports.corrections(R.math_texts(spark, d))
    return rows.select("id", "original_parses", "corrected_parses", V.validated(F.col("text"), F.col("corrected")).alias("final_text"), "estimated_improvement")


@query("a15_validation_rate", f"WITH {R.TEXTS_SQL} SELECT count(*) AS attempts, count(*) FILTER ({S.expression_sql('text')}) AS successes, round(CAST(count(*) FILTER ({S.expression_sql('text')}) AS DOUBLE) / count(*), 6) AS success_rate FROM texts")
def validation_rate(spark, d):
    return rounded(reports.validation_rate(R.math_texts(spark, d).select(V.is_expression(F.col("text")).alias("corrected_parses"))))


@query("a21_t20_recognition_rate", f"WITH {R.TEXTS_SQL}, s AS (SELECT id, replace(text, ' ', '') AS t FROM texts) SELECT id, round(CAST({' + '.join(f'CAST(contains(t, {S.repr_sql(x)}) AS INTEGER)' for x in ('2x', '+', '3', '=', '7', 'x', '2'))} AS DOUBLE) / 7, 6) AS rate FROM s")
def recognition_rate(spark, d):
    tokens = F.array(*map(F.lit, ("2x", "+", "3", "=", "7", "x", "2")))
    return rounded(R.math_texts(spark, d).select("id", T.recognition_rate(F.col("text"), tokens).alias("rate")))


@query("t15_confidence_fraction", "SELECT l_orderkey, l_linenumber, round(CASE WHEN l_quantity - 5 > 0 THEN least((l_quantity - 5) / 40 * 2, 1) ELSE 0 END, 6) AS confidence FROM lineitem")
def confidence_fraction(spark, d):
    return rounded(R.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", T.confidence_fraction((F.col("l_quantity") - 5) / 40 * 200).alias("confidence")))


@query("o5_first_wins_documents", "SELECT min(doc_id) AS doc_id, text FROM documents GROUP BY text")
def first_wins_documents(spark, d):
    docs = R.table(spark, d, "documents")
    return docs.groupBy("text").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "text")


# --- Layout --------------------------------------------------------------------

ROUND_TRIP = "CAST(trunc(conf) AS INTEGER)"


def lines_sql(kind: str) -> str:
    """Lines by recursion over the boxes of a page in order, then their texts."""
    order = {"anchor": 'top, "left", idx', "variant": "top, idx", "weighted": "cy, idx"}[kind]
    gap, first = {"anchor": (10, "prev > 0 AND"), "variant": (15, "prev > 0 AND"), "weighted": (30, "")}[kind]
    keep = f"{ROUND_TRIP} > 0" if kind == "anchor" else "conf >= 0.3 AND length(text) >= 2" if kind == "variant" else "conf >= 0.3"
    side = '"left" + width / 2' if kind == "weighted" else '"left"'
    state = ("cy AS a, cy * width AS yw, width AS w", "CASE WHEN abs(b.cy - a) > 50 THEN b.cy ELSE coalesce((yw + b.cy * b.width) / nullif(r.w + b.width, 0), b.cy) END, CASE WHEN abs(b.cy - a) > 50 THEN 0 ELSE yw END + b.cy * b.width, CASE WHEN abs(b.cy - a) > 50 THEN 0 ELSE r.w END + b.width", "abs(b.cy - a) > 50") if kind == "weighted" else ("top AS a", "CASE WHEN abs(b.top - a) > 20 THEN b.top ELSE a END", "abs(b.top - a) > 20")
    return f"""WITH RECURSIVE {R.BOXES_SQL}, b AS (SELECT *, top + height / 2 AS cy, row_number() OVER (PARTITION BY page_id ORDER BY {order.replace('cy', 'top + height / 2')}) AS rn FROM boxes WHERE {keep}),
r AS (SELECT page_id, rn, idx, {state[0]}, 1 AS line_no FROM b WHERE rn = 1
  UNION ALL
  SELECT b.page_id, b.rn, b.idx, {state[1]}, line_no + CASE WHEN {state[2]} THEN 1 ELSE 0 END FROM r JOIN b ON b.page_id = r.page_id AND b.rn = r.rn + 1),
x AS (SELECT b.*, r.line_no, lag(b."left" + b.width) OVER (PARTITION BY b.page_id, r.line_no ORDER BY {side.replace('"left"', 'b."left"').replace('width', 'b.width')}, b.idx) AS prev FROM b JOIN r ON b.page_id = r.page_id AND b.rn = r.rn)
SELECT page_id, line_no, string_agg(CASE WHEN {first} "left" - prev > {gap} THEN ' ' ELSE '' END || text, '' ORDER BY {side}, idx) AS line_text, count(*) AS boxes FROM x GROUP BY page_id, line_no"""


@query("p4_o9_o10_anchor_lines", lines_sql("anchor"))
def anchor_lines(spark, d):
    return layout.line_texts(layout.anchor_lines(layout.confident(R.word_boxes(spark, d))))


@query("p5_o11_o12_weighted_lines", lines_sql("weighted"))
def weighted_lines(spark, d):
    boxes = layout.confident(R.word_boxes(spark, d), 0.3, strictly=False)
    return layout.line_texts(layout.weighted_lines(boxes), 30.0, any_start=True, key="center")


@query("p6_o14_variant_lines", lines_sql("variant"))
def variant_lines(spark, d):
    boxes = layout.confident(R.word_boxes(spark, d), 0.3, 2, strictly=False)
    return layout.line_texts(layout.anchor_lines(boxes), 15.0)


@query("o15_a12_simple_text", f"WITH {R.BOXES_SQL} SELECT page_id, string_agg(text, ' ' ORDER BY idx) AS text, round(avg(conf), 10) AS mean_conf FROM boxes WHERE {ROUND_TRIP} > 0 GROUP BY page_id")
def simple_text(spark, d):
    return rounded(layout.simple_text(layout.confident(R.word_boxes(spark, d))), mean_conf=10)


@query("o8_low_confidence_fallback", "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity < 30 AND l_partkey % 50 > l_quantity THEN 'general' ELSE 'math' END AS text, CASE WHEN l_quantity < 30 AND l_partkey % 50 > l_quantity THEN CAST(l_partkey % 50 AS DOUBLE) ELSE l_quantity END AS conf FROM lineitem")
def low_confidence_fallback(spark, d):
    li = R.table(spark, d, "lineitem")
    pick = layout.with_fallback(F.lit("math"), F.col("l_quantity"), F.lit("general"), (F.col("l_partkey") % 50).cast("double"))
    return li.select("l_orderkey", "l_linenumber", pick.alias("p")).select("l_orderkey", "l_linenumber", "p.text", "p.conf")


@query("o13_corner_boxes", """SELECT l_orderkey, l_linenumber, "left", top, width, height, round("left" + width / 2, 6) AS center_x, round(top + height / 2, 6) AS center_y
FROM (SELECT l_orderkey, l_linenumber, CAST(l_suppkey AS DOUBLE) AS "left", CAST(l_partkey AS DOUBLE) AS top, l_quantity AS width, CAST(12 AS DOUBLE) AS height FROM lineitem)""")
def corner_boxes(spark, d):
    li = R.table(spark, d, "lineitem")
    x, y = F.col("l_suppkey").cast("double"), F.col("l_partkey").cast("double")
    at = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    corners = F.array(at(x, y), at(x + F.col("l_quantity"), y), at(x + F.col("l_quantity"), y + 12), at(x, y + 12))
    return rounded(layout.corners_to_box(li.select("l_orderkey", "l_linenumber", corners.alias("corners"))).drop("corners"))


# --- QR ------------------------------------------------------------------------

KEYS = "coalesce(CASE WHEN json_valid(data) AND json_type(data) = 'OBJECT' THEN list_contains(json_keys(data), 'assignment_id') AND list_contains(json_keys(data), 'assignment_name') AND list_contains(json_keys(data), 'subject') END, FALSE)"
SIZED = f"{R.DETECTIONS_SQL}, sized AS (SELECT * FROM det WHERE greatest(w, h) BETWEEN 50 AND 500)"
REGIONED = f"{SIZED}, reg AS (SELECT s.*, region_rank FROM sized s JOIN regions r ON s.region = r.region QUALIFY rank() OVER (PARTITION BY image_id ORDER BY region_rank) = 1)"
FIRSTS = f"{REGIONED}, fst AS (SELECT * FROM reg QUALIFY row_number() OVER (PARTITION BY image_id, data ORDER BY region_rank, CASE method WHEN 'pyzbar' THEN 0 ELSE 1 END, seq) = 1)"
PARSED = f"{FIRSTS}, par AS (SELECT image_id, seq, json_extract_string(data, '$.assignment_id') AS assignment_id, json_extract_string(data, '$.assignment_name') AS assignment_name, json_extract_string(data, '$.subject') AS subject, CAST(json_extract_string(data, '$.total_points') AS INTEGER) AS total_points, method, region FROM (SELECT * FROM fst WHERE {KEYS}))"


@query("p7_p9_qr_valid", f"WITH {SIZED} SELECT image_id, seq, {KEYS} AS valid, {KEYS} AND coalesce(CASE WHEN json_valid(data) THEN starts_with(json_extract_string(data, '$.assignment_id'), 'AG') END, FALSE) AS strictly_valid FROM sized")
def qr_valid(spark, d):
    return qr.right_size(R.qr_detections(spark, d)).select("image_id", "seq", qr.has_keys(F.col("data")).alias("valid"), qr.has_prefix(F.col("data")).alias("strictly_valid"))


@query("o6_qr_first_region", f"WITH {REGIONED} SELECT image_id, seq, region, region_rank FROM reg")
def qr_first_region(spark, d):
    return qr.first_region(qr.right_size(R.qr_detections(spark, d)), R.regions(spark)).select("image_id", "seq", "region", "region_rank")


@query("o5_qr_first_wins", f"WITH {FIRSTS} SELECT image_id, seq, data FROM fst")
def qr_first_wins(spark, d):
    return qr.first_wins(qr.first_region(qr.right_size(R.qr_detections(spark, d)), R.regions(spark))).select("image_id", "seq", "data")


@query("p8_p12_qr_extract", f"WITH {PARSED} SELECT image_id, seq, assignment_id, assignment_name, subject, total_points, method, region FROM par")
def qr_extract(spark, d):
    return qr.extract(R.qr_detections(spark, d), R.regions(spark)).select("image_id", "seq", "assignment_id", "assignment_name", "subject", "total_points", "qr_detection.method", "qr_detection.region")


@query("p18_qr_report", f"""WITH {PARSED}, p AS (SELECT *, count(*) OVER (PARTITION BY image_id) AS codes FROM par QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY seq) = 1)
SELECT i.image_id, p.image_id IS NOT NULL AS success, coalesce(codes, 0) AS codes, CASE WHEN p.image_id IS NULL THEN 'no valid code' END AS error_message, assignment_id, assignment_name, subject, total_points
FROM (SELECT DISTINCT image_id FROM det) i LEFT JOIN p ON i.image_id = p.image_id""")
def qr_report(spark, d):
    return qr.extraction_report(R.qr_detections(spark, d), R.regions(spark))


@query("p15_k5_region_boxes", f"""WITH {R.REGIONS_SQL}, i AS (SELECT c_custkey AS image_id, CAST(400 + c_custkey % 900 AS INTEGER) AS width, CAST(300 + c_custkey % 700 AS INTEGER) AS height FROM customer),
o AS (SELECT *, least(CAST(floor(x * width) AS INTEGER), width) AS x0, least(CAST(floor(y * height) AS INTEGER), height) AS y0 FROM i, regions)
SELECT image_id, region, region_rank, x0, y0, least(x0 + CAST(floor(w * width) AS INTEGER), width) AS x1, least(y0 + CAST(floor(h * height) AS INTEGER), height) AS y1 FROM o""")
def region_boxes(spark, d):
    k = F.col("c_custkey")
    images = R.table(spark, d, "customer").select(k.alias("image_id"), (400 + k % 900).cast("int").alias("width"), (300 + k % 700).cast("int").alias("height"))
    return qr.region_boxes(images, R.regions(spark))


@query("k6_image_join", f"WITH {PARSED}, {R.CALLS_SQL} SELECT p.image_id, seq, assignment_id, n FROM par p JOIN (SELECT image_id, count(*) AS n FROM calls GROUP BY image_id) c ON p.image_id = c.image_id")
def image_join(spark, d):
    calls = R.engine_calls(spark, d).groupBy("image_id").agg(F.count("*").alias("n"))
    return qr.extract(R.qr_detections(spark, d), R.regions(spark)).join(calls, "image_id").select("image_id", "seq", "assignment_id", "n")


# --- Templates and metadata ------------------------------------------------------

_T = [(k, t["name"], t["subject"], t["total_points"], t["estimated_time_minutes"], t["difficulty_level"], len(t["problem_types"]), sum(p["count"] for p in t["problem_types"]), sum(p["count"] * p["points_each"] for p in t["problem_types"])) for k, t in BUILT_IN.items()]
TEMPLATES_SQL = f"tpl(template_id, name, subject, total_points, minutes, difficulty, kinds, problems, points) AS (VALUES {R._values(_T)})"


@query("p10_p11_o2_list_templates", f"""WITH {R.PART_TEMPLATES_SQL} SELECT template_id AS id, coalesce(name, template_id) AS name, coalesce(subject, 'unknown') AS subject, coalesce(total_points, 100) AS total_points,
  coalesce(difficulty, 'intermediate') AS difficulty, coalesce(minutes, 60) AS estimated_time FROM pt""")
def list_templates(spark, d):
    return metadata.list_templates(R.part_templates(spark, d))


@query("a17_subjects", f"WITH {R.PART_TEMPLATES_SQL} SELECT DISTINCT subject FROM pt WHERE subject <> ''")
def subjects(spark, d):
    return metadata.subjects(R.part_templates(spark, d))


INSTANCES_SQL = f"""{TEMPLATES_SQL}, {R.REQUESTS_SQL}, ins AS (
  SELECT r.*, t.name, t.subject, t.total_points, t.kinds, t.difficulty, t.template_id IS NOT NULL AND due_date <> 'soon' AS made,
    CASE WHEN t.template_id IS NULL THEN 'unknown template ' || r.template_id WHEN try_strptime(due_date, '%Y-%m-%d') IS NULL THEN 'due date is no date' END AS error
  FROM req r LEFT JOIN tpl t ON r.template_id = t.template_id)"""
YEAR = "CASE WHEN made THEN CAST(year(created_at) - CASE WHEN month(created_at) >= 8 THEN 0 ELSE 1 END AS VARCHAR) || '-' || CAST(year(created_at) - CASE WHEN month(created_at) >= 8 THEN 0 ELSE 1 END + 1 AS VARCHAR) END"
IDENT = "CASE WHEN made THEN upper(subject)[:3] || '-' || strftime(created_at, '%Y%m%d') || '-' || upper(md5(CAST(request_id AS VARCHAR))[:8]) END"
POINTS = "CASE WHEN made THEN coalesce(nullif(custom_points, 0), nullif(total_points, 0), 100) END"


@query("j4_j6_k2_instantiate", f"WITH {INSTANCES_SQL} SELECT request_id, {IDENT} AS assignment_id, CASE WHEN made THEN subject END AS subject, due_date, {POINTS} AS total_points, class_period, {YEAR} AS academic_year, CASE WHEN made THEN name END AS template_name, CASE WHEN made THEN CAST(kinds AS VARCHAR) END AS problems, error FROM ins")
def instantiate(spark, d):
    rows = metadata.instantiate(R.requests(spark, d), templates(spark))
    return rows.select("request_id", "assignment_id", "subject", "due_date", "total_points", "class_period", "academic_year", F.col("additional_data")["template_name"].alias("template_name"), F.col("additional_data")["problems_count"].alias("problems"), "error")


@query("j1_payload", f"""WITH {INSTANCES_SQL} SELECT request_id, '{{"assignment_id":"' || {IDENT} || '","subject":"' || subject || '","due_date":"' || due_date || '","total_points":' || CAST({POINTS} AS VARCHAR) || ',"class_period":' || coalesce('"' || class_period || '"', 'null') || ',"academic_year":"' || {YEAR} || '"}}' AS payload FROM ins WHERE made""")
def payload(spark, d):
    rows = metadata.instantiate(R.requests(spark, d), templates(spark)).where("error IS NULL")
    return rows.select("request_id", metadata.payload(rows, ("assignment_id", "subject", "due_date", "total_points", "class_period", "academic_year")).alias("payload"))


@query("j2_j8_round_trip", f"""WITH {INSTANCES_SQL} SELECT request_id, {IDENT} AS assignment_id, subject, assignment_name, due_date, {POINTS} AS total_points, class_period, teacher_name, {YEAR} AS academic_year,
  strftime(created_at, '%Y-%m-%dT%H:%M:%S') AS created_at, '1.0' AS qr_version, name AS template_name, CAST(kinds AS VARCHAR) AS problems, TRUE AS same, request_id % 3 = 0 AS short_is_read FROM ins WHERE made""")
def round_trip(spark, d):
    """Each field as it is read back from the payload; and of a third of the rows a payload that lacks optional keys, which lenient reading alone takes."""
    rows = metadata.round_trip(metadata.instantiate(R.requests(spark, d), templates(spark)).where("error IS NULL"))
    rows = rows.withColumn("short", F.when(F.col("request_id") % 3 == 0, metadata.payload(rows, metadata.REQUIRED)))
    read = metadata.from_payload(F.col("short"))["assignment_id"].isNotNull() & metadata.from_payload(F.col("short"), strict=True).isNull()
    extra = F.col("back.additional_data")
    return rows.select("request_id", *[f"back.{f}" for f in metadata.FIELDS if f != "additional_data"], extra["template_name"].alias("template_name"), extra["problems_count"].alias("problems"), "same", F.coalesce(read, F.lit(False)).alias("short_is_read"))


@query("j3_any_payload", f"""WITH {R.DETECTIONS_SQL} SELECT image_id, seq, CASE WHEN json_valid(data) THEN data ELSE '{{"data":"' || data || '"}}' END AS payload FROM det""")
def any_payload(spark, d):
    return R.qr_detections(spark, d).select("image_id", "seq", metadata.any_payload(F.col("data"), "data").alias("payload"))


@query("j9_problem_points", f"""WITH {R.PART_TEMPLATES_SQL} SELECT template_id, CAST(coalesce(list_sum(list_transform(range(1, k % 4 + 1), lambda j: size % 5 + j)), 0) AS INTEGER) AS problems,
  CAST(coalesce(list_sum(list_transform(range(1, k % 4 + 1), lambda j: (size % 5 + j) * (j + 1))), 0) AS INTEGER) AS points FROM pt""")
def problem_points(spark, d):
    return metadata.problem_points(R.part_templates(spark, d))


@query("j9_rubric", f"""WITH {R.PART_TEMPLATES_SQL}, r AS (SELECT template_id, 'accuracy' AS item, size AS weight FROM pt UNION ALL SELECT template_id, 'method', k % 10 + 1 FROM pt)
SELECT template_id, item, weight, round(CAST(weight AS DOUBLE) / sum(weight) OVER (PARTITION BY template_id), 6) AS share FROM r""")
def rubric(spark, d):
    return rounded(metadata.rubric_lines(R.part_templates(spark, d)))


@query("t21_t22_t23_identifiers", """SELECT o_orderkey, 'AG_' || md5(o_orderpriority || '_' || strftime(o_orderdate, '%Y%m%d_%H%M%S'))[:8] || '_' || strftime(o_orderdate, '%H%M%S') AS hashed,
  upper(o_orderpriority)[:3] || '-' || strftime(o_orderdate, '%Y%m%d') || '-' || upper(md5(CAST(o_orderkey AS VARCHAR))[:8]) AS dated FROM orders""")
def identifiers(spark, d):
    from tallysheet.functions.identifiers import dated_id, hashed_id, subject_prefix

    o = R.table(spark, d, "orders")
    return o.select("o_orderkey", hashed_id(F.col("o_orderpriority"), F.col("o_orderdate")).alias("hashed"), dated_id(subject_prefix(F.col("o_orderpriority")), F.col("o_orderdate"), F.md5(F.col("o_orderkey").cast("string"))).alias("dated"))


# --- Rasters ---------------------------------------------------------------------

LAPLACE_SQL = f"""{R.RASTERS_SQL}, lap AS (SELECT g.image_id, u.v + b.v + l.v + r.v - 4 * g.v AS x FROM grid g
  JOIN grid u ON g.image_id = u.image_id AND g.c = u.c AND u.r = CASE g.r WHEN 0 THEN 1 ELSE g.r - 1 END JOIN grid b ON g.image_id = b.image_id AND g.c = b.c AND b.r = CASE g.r WHEN 7 THEN 6 ELSE g.r + 1 END
  JOIN grid l ON g.image_id = l.image_id AND g.r = l.r AND l.c = CASE g.c WHEN 0 THEN 1 ELSE g.c - 1 END JOIN grid r ON g.image_id = r.image_id AND g.r = r.r AND r.c = CASE g.c WHEN 7 THEN 6 ELSE g.c + 1 END),
mes AS (SELECT a.image_id, brightness, contrast, sharpness FROM (SELECT image_id, avg(v) AS brightness, stddev_pop(v) AS contrast FROM grid GROUP BY image_id) a JOIN (SELECT image_id, var_pop(x) AS sharpness FROM lap GROUP BY image_id) s ON a.image_id = s.image_id)"""


@query("i1_i3_measures", f"WITH {LAPLACE_SQL} SELECT image_id, round(brightness, 6) AS brightness, round(contrast, 6) AS contrast, round(sharpness, 6) AS sharpness FROM mes")
def measures(spark, d):
    return rounded(raster.measures(R.rasters(spark, d)).select("image_id", "brightness", "contrast", "sharpness"))


@query("i4_basic_quality", f"WITH {LAPLACE_SQL}, f AS (SELECT image_id, sharpness >= 50 AS is_sharp, contrast >= 30 AS has_good_contrast, brightness BETWEEN 80 AND 200 AS is_well_lit FROM mes), s AS (SELECT *, 40 * CAST(is_sharp AS INTEGER) + 30 * CAST(has_good_contrast AS INTEGER) + 30 * CAST(is_well_lit AS INTEGER) AS overall_score FROM f) SELECT *, overall_score >= 70 AS is_suitable_for_ocr FROM s")
def basic_quality(spark, d):
    return raster.basic_quality(raster.measures(R.rasters(spark, d))).select("image_id", "is_sharp", "has_good_contrast", "is_well_lit", "overall_score", "is_suitable_for_ocr")


#: The sums that :func:`summed` takes of an image.
SUMS = "CAST(sum(v) AS BIGINT) AS total, CAST(sum(v * (r * 8 + c + 1)) AS BIGINT) AS placed"
AROUND_SQL = f"""{LAPLACE_SQL}, span AS (SELECT unnest(range(-5, 6)) AS o),
med AS (SELECT image_id, avg(abs(v - m)) AS noise FROM (SELECT g.image_id, g.r, g.c, any_value(g.v) AS v, median(n.v) AS m FROM grid g, span y, span x, grid n
  WHERE y.o BETWEEN -2 AND 2 AND x.o BETWEEN -2 AND 2 AND n.image_id = g.image_id AND n.r = least(greatest(g.r + y.o, 0), 7) AND n.c = least(greatest(g.c + x.o, 0), 7) GROUP BY g.image_id, g.r, g.c) GROUP BY image_id),
nine AS (SELECT g.image_id, g.r, g.c, any_value(g.v) AS v, sum(n.v) AS total FROM grid g, span y, span x, grid n
  WHERE y.o BETWEEN -1 AND 1 AND x.o BETWEEN -1 AND 1 AND n.image_id = g.image_id AND n.r = CASE g.r + y.o WHEN -1 THEN 1 WHEN 8 THEN 6 ELSE g.r + y.o END AND n.c = CASE g.c + x.o WHEN -1 THEN 1 WHEN 8 THEN 6 ELSE g.c + x.o END GROUP BY g.image_id, g.r, g.c),
sob AS (SELECT g.image_id, g.r, g.c, CAST(sum(x.o * (2 - abs(y.o)) * n.v) AS BIGINT) AS gx, CAST(sum(y.o * (2 - abs(x.o)) * n.v) AS BIGINT) AS gy FROM grid g, span y, span x, grid n
  WHERE y.o BETWEEN -1 AND 1 AND x.o BETWEEN -1 AND 1 AND n.image_id = g.image_id AND n.r = least(greatest(g.r + y.o, 0), 7) AND n.c = least(greatest(g.c + x.o, 0), 7) GROUP BY g.image_id, g.r, g.c),
mag AS (SELECT image_id, r, c, abs(gx) + abs(gy) AS m, CASE WHEN abs(gy) * 32768 < abs(gx) * 13573 THEN 0 WHEN abs(gy) * 32768 > abs(gx) * (13573 + 65536) THEN 1 ELSE 2 END AS way, CASE WHEN (gx < 0) <> (gy < 0) THEN -1 ELSE 1 END AS lean FROM sob),
ste AS (SELECT *, CASE way WHEN 0 THEN 0 ELSE 1 END AS dr, CASE way WHEN 0 THEN 1 WHEN 1 THEN 0 ELSE lean END AS dc FROM mag),
thin AS (SELECT s.image_id, s.r, s.c, s.m FROM ste s LEFT JOIN mag a ON a.image_id = s.image_id AND a.r = s.r - dr AND a.c = s.c - dc LEFT JOIN mag b ON b.image_id = s.image_id AND b.r = s.r + dr AND b.c = s.c + dc
  WHERE s.m > 50 AND s.m > coalesce(a.m, 0) AND (s.m > coalesce(b.m, 0) OR s.way < 2 AND s.m = coalesce(b.m, 0))),
grown AS (SELECT image_id, r, c FROM thin WHERE m > 150 UNION SELECT t.image_id, t.r, t.c FROM grown g JOIN thin t ON g.image_id = t.image_id AND abs(g.r - t.r) <= 1 AND abs(g.c - t.c) <= 1),
edg AS (SELECT i.image_id, count(g.r) / 64.0 AS density FROM (SELECT DISTINCT image_id FROM grid) i LEFT JOIN grown g ON i.image_id = g.image_id GROUP BY i.image_id)"""
PLAN_SQL = f"""{AROUND_SQL}, sco AS (SELECT mes.image_id, brightness AS b, contrast AS k, sharpness AS s, noise,
    CASE WHEN brightness < 80 THEN brightness / 80 * 100 WHEN brightness > 200 THEN greatest(0, 300 - brightness) ELSE 100 END AS brightness_score, least(100, contrast / 30 * 100) AS contrast_score, least(100, sharpness / 50 * 100) AS sharpness_score,
    greatest(0, 100 - noise / 15 * 100) AS noise_score, CAST(30 AS DOUBLE) AS resolution_score, CASE WHEN density BETWEEN 0.05 AND 0.4 THEN 100 ELSE greatest(0, 100 - abs(density - 0.2) * 200) END AS text_clarity_score
  FROM mes JOIN med ON mes.image_id = med.image_id JOIN edg ON mes.image_id = edg.image_id),
pla AS (SELECT *, (brightness_score + contrast_score + sharpness_score + noise_score + resolution_score + text_clarity_score) / 6 AS overall_score,
    concat_ws(',', CASE WHEN b < 80 THEN 'brighten' END, CASE WHEN b > 200 THEN 'darken' END, CASE WHEN k < 30 THEN 'contrast_enhancement' END, CASE WHEN s < 50 THEN 'sharpening' END, CASE WHEN noise > 15 THEN 'denoising' END, 'upscaling') AS enhancements_needed,
    concat_ws(',', CASE WHEN b < 80 OR b > 200 THEN 'brightness_correction' END, CASE WHEN k < 30 THEN 'contrast_enhancement' END, CASE WHEN s < 50 THEN 'sharpening' END, CASE WHEN noise > 15 THEN 'denoising' END, 'upscaling') AS steps FROM sco)"""
SCORES = ("brightness_score", "contrast_score", "sharpness_score", "noise_score", "resolution_score", "text_clarity_score", "overall_score")


@query("i5_i6_o4_quality_and_plan", f"WITH RECURSIVE {PLAN_SQL} SELECT image_id, {', '.join(f'round({c}, 6) AS {c}' for c in SCORES)}, overall_score < 70 AS needs_enhancement, enhancements_needed, steps FROM pla")
def quality_and_plan(spark, d):
    return rounded(raster.analysed(R.rasters(spark, d)).select("image_id", *SCORES, "needs_enhancement", "enhancements_needed", "steps"))


@query("i7_i18_enhanced")
def enhanced(spark, d):
    """The whole plan and the last steps, the scaling to the recogniser's width included.

    Scores and what begins with ``final`` are of the image after all steps;
    the other columns of an image are of it in black and white, before that scaling.
    A chain of filters over pixels is beyond SQL, so the tests hold it against a plain version.
    """
    # Some milliseconds an image, whose rows are a few hundred bytes: dealt out, for the table may be one small file.
    out = raster.processed_for_recognition(R.rasters(spark, d).repartition(spark.sparkContext.defaultParallelism, "image_id"), pixels=False)
    own = [f"unscaled.{c}" for c in ("height", "width", "applied", "brightness", "contrast")]
    final = [F.col(c).alias(f"final_{c}") for c in ("height", "width", "applied", *raster.MEASURES)]
    return rounded(out.select("image_id", *own, "enhancements_applied", "score_before", "score_after", "improvement", "recommended", *final))


@query("i9_sharpened", f"""WITH RECURSIVE {AROUND_SQL}, k AS (SELECT image_id, CASE WHEN density < 0.05 THEN -1.0 WHEN density < 0.15 THEN -0.5 ELSE -0.25 END AS side FROM edg)
SELECT image_id, {SUMS} FROM (SELECT nine.image_id, r, c, CAST(least(greatest(round_even(CAST(side * total + (1 - 9 * side) * v AS DOUBLE), 0), 0), 255) AS BIGINT) AS v FROM nine JOIN k ON nine.image_id = k.image_id) GROUP BY image_id""")
def sharpened(spark, d):
    """Against all eight neighbours; the plan's own sharpening has two kernels of four."""
    return stepped(spark, d, "sharpening_all_round")


@query("i16_adaptive_threshold", f"""WITH RECURSIVE {AROUND_SQL}, loc AS (SELECT g.image_id, g.r, g.c, any_value(g.v) AS v, avg(n.v) AS m FROM grid g, span y, span x, grid n
  WHERE n.image_id = g.image_id AND n.r = least(greatest(g.r + y.o, 0), 7) AND n.c = least(greatest(g.c + x.o, 0), 7) GROUP BY g.image_id, g.r, g.c)
SELECT image_id, {SUMS} FROM (SELECT image_id, r, c, CASE WHEN v > m - 2 THEN 255 ELSE 0 END AS v FROM loc) GROUP BY image_id""")
def adaptive_threshold(spark, d):
    return stepped(spark, d, "threshold")


@query("i17_closed", f"""WITH {R.RASTERS_SQL}, span AS (SELECT unnest([0, 1]) AS o),
gro AS (SELECT g.image_id, g.r, g.c, max(n.v) AS v FROM grid g, span y, span x, grid n WHERE n.image_id = g.image_id AND n.r = g.r - y.o AND n.c = g.c - x.o GROUP BY g.image_id, g.r, g.c),
clo AS (SELECT g.image_id, g.r, g.c, min(n.v) AS v FROM gro g, span y, span x, gro n WHERE n.image_id = g.image_id AND n.r = g.r + y.o AND n.c = g.c + x.o GROUP BY g.image_id, g.r, g.c)
SELECT image_id, {SUMS} FROM clo GROUP BY image_id""")
def closed(spark, d):
    return stepped(spark, d, "close")


@query("i17_opened", f"""WITH {R.RASTERS_SQL}, span AS (SELECT unnest([0, 1]) AS o),
les AS (SELECT g.image_id, g.r, g.c, min(n.v) AS v FROM grid g, span y, span x, grid n WHERE n.image_id = g.image_id AND n.r = g.r - y.o AND n.c = g.c - x.o GROUP BY g.image_id, g.r, g.c),
ope AS (SELECT g.image_id, g.r, g.c, max(n.v) AS v FROM les g, span y, span x, les n WHERE n.image_id = g.image_id AND n.r = g.r + y.o AND n.c = g.c + x.o GROUP BY g.image_id, g.r, g.c)
SELECT image_id, {SUMS} FROM ope GROUP BY image_id""")
def opened(spark, d):
    return stepped(spark, d, "open")


@query("i10_equalised", f"""WITH {R.RASTERS_SQL}, cnt AS (SELECT image_id, r // 4 AS tr, c // 4 AS tc, v AS g, count(*) AS n FROM grid GROUP BY ALL),
til AS (SELECT image_id, tr, tc, CAST(sum(greatest(n - 1, 0)) AS BIGINT) AS over FROM cnt GROUP BY image_id, tr, tc),
bin AS (SELECT t.image_id, t.tr, t.tc, b.g, least(coalesce(n, 0), 1) + over // 256 + CASE WHEN b.g % (256 // greatest(over % 256, 1)) = 0 AND b.g // (256 // greatest(over % 256, 1)) < over % 256 THEN 1 ELSE 0 END AS n
  FROM til t CROSS JOIN range(256) b(g) LEFT JOIN cnt ON cnt.image_id = t.image_id AND cnt.tr = t.tr AND cnt.tc = t.tc AND cnt.g = b.g),
lut AS (SELECT image_id, tr, tc, g, least(round_even(CAST(sum(n) OVER (PARTITION BY image_id, tr, tc ORDER BY g) AS DOUBLE) * 255 / 16, 0), 255) AS m FROM bin),
pos AS (SELECT *, r / 4.0 - 0.5 AS y, c / 4.0 - 0.5 AS x FROM grid),
bl AS (SELECT p.image_id, p.r, p.c, sum(m * CASE WHEN k.i = 0 THEN 1 - (y - floor(y)) ELSE y - floor(y) END * CASE WHEN k.j = 0 THEN 1 - (x - floor(x)) ELSE x - floor(x) END) AS v
  FROM pos p, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) k(i, j), lut WHERE lut.image_id = p.image_id AND lut.g = p.v AND lut.tr = least(greatest(floor(y) + k.i, 0), 1) AND lut.tc = least(greatest(floor(x) + k.j, 0), 1) GROUP BY p.image_id, p.r, p.c)
SELECT image_id, {SUMS} FROM (SELECT image_id, r, c, CAST(round_even(CAST(v AS DOUBLE), 0) AS BIGINT) AS v FROM bl) GROUP BY image_id""")
def equalised(spark, d):
    """Four tiles of 4 by 4 pixels."""
    return stepped(spark, d, "equalised_by_quarters")


@query("i11_non_local_means", f"""WITH {R.RASTERS_SQL}, far AS (SELECT unnest(range(-2, 3)) AS o), near AS (SELECT unnest(range(-1, 2)) AS o), way AS (SELECT unnest(range(-3, 11)) AS k),
big AS (SELECT g.image_id, y.k AS r, x.k AS c, g.v FROM way y, way x, grid g WHERE g.r = CASE WHEN y.k < 0 THEN -y.k WHEN y.k > 7 THEN 14 - y.k ELSE y.k END AND g.c = CASE WHEN x.k < 0 THEN -x.k WHEN x.k > 7 THEN 14 - x.k ELSE x.k END),
gap AS (SELECT a.image_id, a.r - ny.o AS r, a.c - nx.o AS c, fy.o AS dr, fx.o AS dc, CAST(sum((a.v - b.v) * (a.v - b.v)) AS DOUBLE) AS d
  FROM big a, near ny, near nx, far fy, far fx, big b WHERE a.r - ny.o BETWEEN 0 AND 7 AND a.c - nx.o BETWEEN 0 AND 7 AND b.image_id = a.image_id AND b.r = a.r + fy.o AND b.c = a.c + fx.o GROUP BY ALL),
mea AS (SELECT gap.image_id, gap.r, gap.c, sum(exp(-d / 900) * b.v) / sum(exp(-d / 900)) AS v FROM gap JOIN big b ON b.image_id = gap.image_id AND b.r = gap.r + dr AND b.c = gap.c + dc GROUP BY gap.image_id, gap.r, gap.c)
SELECT image_id, {SUMS} FROM (SELECT image_id, r, c, CAST(round_even(v, 0) AS BIGINT) AS v FROM mea) GROUP BY image_id""")
def non_local_means(spark, d):
    """Patches of 3 by 3 in windows of 5 by 5."""
    return stepped(spark, d, "lightly_denoised")


@query("i5_edges", f"WITH RECURSIVE {AROUND_SQL} SELECT image_id, round(density, 6) AS edge_density FROM edg")
def edge_density(spark, d):
    rows = R.rasters(spark, d)
    return rounded(rows.select("image_id", raster.neighbourhood("pixels", "height", "width").alias("n")).select("image_id", "n.edge_density"))


def summed(pixels):
    """Sum of greys, and of greys times their places, so that a shifted image is told apart."""
    whole = F.aggregate(pixels, F.lit(0).cast("long"), lambda a, x: a + x).alias("total")
    return [whole, F.aggregate(F.transform(pixels, lambda x, i: x * (i + 1)), F.lit(0).cast("long"), lambda a, x: a + x).alias("placed")]


def stepped(spark, d, step: str):
    """The sums of each image after one step."""
    return raster.apply_steps(R.rasters(spark, d).withColumn("steps", F.lit(step))).select("image_id", *summed("pixels"))


@query("i8_adjusted", f"""WITH {R.RASTERS_SQL}, m AS (SELECT image_id, avg(v) AS m, stddev_pop(v) AS s FROM grid GROUP BY image_id),
a AS (SELECT g.image_id, i, least(greatest((least(greatest(p.v + CASE WHEN abs(128 - m) > 10 THEN 128 - m ELSE 0 END, 0), 255) - 128) * CASE WHEN s < 50 AND s > 0 THEN least(2.0, 50 / s) ELSE 1 END + 128, 0), 255) AS v FROM m g JOIN pix p ON g.image_id = p.image_id)
SELECT image_id, {SUMS} FROM (SELECT image_id, i // 8 AS r, i % 8 AS c, CAST(trunc(v) AS BIGINT) AS v FROM a) GROUP BY image_id""")
def adjusted(spark, d):
    return R.rasters(spark, d).select("image_id", raster.adjusted(F.col("pixels")).alias("p")).select("image_id", *summed("p"))


@query("i14_i15_sizes", "SELECT p_partkey, CAST(least(w, 2000) AS INTEGER) AS fitted_width, CAST(CASE WHEN w > 2000 THEN floor(CAST(h AS DOUBLE) / w * 2000) ELSE h END AS INTEGER) AS fitted_height, CAST(floor(w * f) AS INTEGER) AS up_width, CAST(floor(h * f) AS INTEGER) AS up_height FROM (SELECT *, CASE WHEN w < 1200 OR h < 800 THEN least(CAST(3 AS DOUBLE), CAST(1600 AS DOUBLE) / w) ELSE 1 END AS f FROM (SELECT p_partkey, CAST(300 + p_partkey * 37 % 2500 AS INTEGER) AS w, CAST(200 + p_partkey * 53 % 1900 AS INTEGER) AS h FROM part))")
def sizes(spark, d):
    k = F.col("p_partkey")
    w, h = (300 + k * 37 % 2500).cast("int"), (200 + k * 53 % 1900).cast("int")
    rows = R.table(spark, d, "part").select("p_partkey", raster.fitted_size(w, h).alias("f"), raster.upscaled_size(w, h).alias("u"))
    return rows.select("p_partkey", F.col("f.width").alias("fitted_width"), F.col("f.height").alias("fitted_height"), F.col("u.width").alias("up_width"), F.col("u.height").alias("up_height"))


@query("i16_otsu", f"""WITH {R.RASTERS_SQL}, c AS (SELECT image_id, v AS g, count(*) AS n FROM pix GROUP BY ALL),
s AS (SELECT *, sum(n) OVER u AS w0, sum(n * g) OVER u AS s0, sum(n) OVER w AS w, sum(n * g) OVER w AS s FROM c WINDOW u AS (PARTITION BY image_id ORDER BY g), w AS (PARTITION BY image_id))
SELECT image_id, g AS threshold FROM s QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY coalesce(round(CAST(w0 AS DOUBLE) * (w - w0) * power(CAST(s0 AS DOUBLE) / w0 - CAST(s - s0 AS DOUBLE) / nullif(w - w0, 0), 2), 6), 0) DESC, g) = 1""")
def otsu(spark, d):
    return raster.otsu(R.rasters(spark, d))


@query("i13_p14_o3_a16_skew", """WITH c AS (SELECT l_orderkey AS image_id, l_quantity AS area, CAST(l_partkey % 181 - 90 AS DOUBLE) AS angle, CAST(20000 AS DOUBLE) AS image_area FROM lineitem),
t AS (SELECT *, CASE WHEN angle < -45 THEN angle + 90 WHEN angle > 45 THEN angle - 90 ELSE angle END AS a FROM c WHERE area > image_area * 0.001 QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY area DESC, angle) <= 10),
m AS (SELECT image_id, CAST(median(a) AS DOUBLE) AS angle, count(*) AS contours FROM t GROUP BY image_id) SELECT image_id, round(angle, 6) + 0.0 AS angle, contours, abs(angle) >= 0.5 AS rotate, CASE WHEN abs(angle) >= 0.5 THEN printf('deskew_%.2fdeg', angle) END AS step FROM m""")
def skew(spark, d):
    li = R.table(spark, d, "lineitem")
    contours = li.select(F.col("l_orderkey").alias("image_id"), F.col("l_quantity").alias("area"), (F.col("l_partkey") % 181 - 90).cast("double").alias("angle"), F.lit(20000.0).alias("image_area"))
    return rounded(raster.dominant_angle(contours))


@query("i20_structure", f"WITH {R.RASTERS_SQL}, s AS (SELECT image_id, CAST(1 AS DOUBLE) AS aspect_ratio, round(CAST(count(*) FILTER (v < 128) AS DOUBLE) / count(*), 6) AS text_density FROM pix GROUP BY image_id) SELECT *, TRUE AS has_fractions, FALSE AS has_complex_structure, text_density > 0.15 AS has_exponents FROM s")
def structure(spark, d):
    return rounded(raster.math_structure(R.rasters(spark, d)))


# --- Reports ---------------------------------------------------------------------


@query("a18_a20_suites", f"""WITH {R.TESTS_SQL}, s AS (SELECT suite, count(*) AS tests_run, count(*) FILTER (passed) AS tests_passed, round(avg(CAST(passed AS INTEGER)) * 100, 6) AS success_rate, max(score) - min(score) AS spread FROM tests GROUP BY suite)
SELECT *, CASE WHEN success_rate >= 90 THEN 'excellent' WHEN success_rate >= 75 THEN 'good' WHEN success_rate >= 50 THEN 'fair' ELSE 'poor' END AS grade, success_rate >= 60 AS robust, spread > 20 AS varies FROM s""")
def suites(spark, d):
    return rounded(reports.suites(R.test_results(spark, d)))


@query("o16_first_failures", f"WITH {R.TESTS_SQL} SELECT suite, row_number() OVER (PARTITION BY suite ORDER BY test) AS rank, test FROM tests WHERE NOT passed QUALIFY rank <= 3")
def first_failures(spark, d):
    return reports.first_failures(R.test_results(spark, d))


@query("a22_mean_formula_confidence", f"WITH f AS ({S.formula_query()}) SELECT type, CAST(sum(CAST(round(confidence * 100) AS BIGINT)) AS DOUBLE) / CAST(count(*) * 100 AS DOUBLE) AS mean_confidence, count(*) AS formulas FROM f GROUP BY type")
def mean_formula_confidence(spark, d):
    rows = R.math_texts(spark, d).select(T.formula_analysis(F.col("text")).alias("a")).select("a.type", F.round("a.confidence", 6).alias("confidence"))
    return reports.mean_formula_confidence(rows)
