"""The relations of the engine over a star schema that has none of them: one deterministic view each, in Spark and in SQL.

Every view covers its whole table. The SQL is for an oracle that has the same
tables; both say the same thing twice on purpose.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Recognisers stand for the event types. Priorities tie, so that order by configuration matters. Fixed values.
ENGINES = [("click", True, 1, 30, 0), ("view", True, 2, 45, 1), ("purchase", True, 2, 60, 2), ("error", False, 1, 45, 3), ("signup", True, None, 30, 4)]
#: Search regions in the order they are searched, as shares of the image. Fixed values.
REGIONS = [("top_right", 0, 0.6, 0.0, 0.4, 0.3), ("top_left", 1, 0.0, 0.0, 0.4, 0.3), ("bottom_right", 2, 0.6, 0.7, 0.4, 0.3), ("full_image", 3, 0.0, 0.0, 1.0, 1.0)]
#: Formulas and recognised strings that exercise every rule.
FORMULAS = [
    "k^3 - 8 = 0", "cos(45°) = 4/9", "w = ru + v", "√(p^2 + 9)", "7p - 4 = 10", "6 + l = 8", "O + 9 = 1", "m^S = 6", "m^Z - 8 = O", "8×5÷4", "w=ru-k", "9u+4=6", "k^3-5k+2=O", "(5+6×7",
    "p/q + r/s", "u/S+I/7", "4 o 6", "4o6", "p**4", "9 - 8", "-6", "u)v)w", "6-5-4", "", " ", "q + 7 = 3", "k^2 + 9*k - 8", "tan(p) + sin(q)", "no formula at all §§", "(3 / 8) x 6", "sqrt(49)/3", "log(50) ^ 4", "5 x 8",
    "((p+q", "2 + I + S + Z + O - 9", "8−5 ± 1", "cos(u)/sin(v)", "21/7 = 3", "p = = q", "(9)-2",
]


def _values(rows: list[tuple]) -> str:
    lit = lambda v: "NULL" if v is None else str(v).upper() if isinstance(v, bool) else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else f"CAST({v} AS DOUBLE)" if isinstance(v, float) else str(v)
    return ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def engines(spark: SparkSession) -> DataFrame:
    from tallysheet.schemas import ENGINES as SCHEMA

    return spark.createDataFrame(ENGINES, SCHEMA)


def configured_engines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An engine for each kind of event and group of users, set up from its first event; some are off, some have no priority."""
    first = F.min("event_id")
    name = F.concat("event_type", F.lit("_"), (F.col("user_id") % 40).cast("string"))
    rows = table(spark, sf_dir, "events").groupBy(name.alias("engine_name")).agg(first.alias("first"))
    k = F.col("first")
    return rows.select("engine_name", (k % 5 != 0).alias("enabled"), F.when(k % 4 < 3, k % 4).cast("int").alias("priority"), F.lit(60).alias("timeout"), k.cast("int").alias("config_pos"))


CONFIGURED_SQL = """conf AS (SELECT event_type || '_' || CAST(user_id % 40 AS VARCHAR) AS engine_name, min(event_id) AS k FROM events GROUP BY ALL),
configured AS (SELECT engine_name, k % 5 <> 0 AS enabled, CASE WHEN k % 4 < 3 THEN k % 4 END AS priority, k AS config_pos FROM conf)"""


def part_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A template for each part; some lack a name, a subject, points, minutes, a level or problems."""
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    kinds = F.transform(F.sequence(F.lit(1), (k % 4).cast("int")), lambda j: F.struct(F.concat(F.lit("kind "), j.cast("string")).alias("type"), (F.col("p_size") % 5 + j).alias("count"), (j + 1).alias("points_each"), F.lit(None).cast("string").alias("description")))
    none = F.array().cast("array<struct<type:string,count:int,points_each:int,description:string>>")
    return p.select(
        F.concat(F.lit("T"), k.cast("string")).alias("template_id"), F.when(k % 11 != 0, F.col("p_name")).alias("name"), F.when(k % 17 == 0, "").when(k % 13 != 0, F.col("p_brand")).alias("subject"),
        F.when(k % 7 != 0, F.col("p_size") * 2).alias("total_points"), F.when(k % 5 != 0, F.col("p_size") + 20).alias("estimated_time_minutes"), F.when(k % 3 == 0, "basic").when(k % 3 == 1, "advanced").alias("difficulty_level"),
        F.lit(None).cast("string").alias("instructions"), F.when(k % 4 > 0, kinds).otherwise(none).alias("problem_types"),
        F.create_map(F.lit("accuracy"), F.col("p_size"), F.lit("method"), (k % 10 + 1).cast("int")).alias("grading_rubric"),
    )


PART_TEMPLATES_SQL = """pt AS (SELECT p_partkey AS k, 'T' || p_partkey AS template_id, CASE WHEN p_partkey % 11 <> 0 THEN p_name END AS name, CASE WHEN p_partkey % 17 = 0 THEN '' WHEN p_partkey % 13 <> 0 THEN p_brand END AS subject,
  CASE WHEN p_partkey % 7 <> 0 THEN p_size * 2 END AS total_points, CASE WHEN p_partkey % 5 <> 0 THEN p_size + 20 END AS minutes, CASE p_partkey % 3 WHEN 0 THEN 'basic' WHEN 1 THEN 'advanced' END AS difficulty, p_size AS size FROM part)"""


def regions(spark: SparkSession) -> DataFrame:
    from tallysheet.schemas import REGIONS as SCHEMA

    return spark.createDataFrame(REGIONS, SCHEMA)


ENGINES_SQL = f"engines(engine_name, enabled, priority, timeout, config_pos) AS (VALUES {_values(ENGINES)})"
REGIONS_SQL = f"regions(region, region_rank, x, y, w, h) AS (VALUES {_values(REGIONS)})"


def engine_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All calls of all engines: every fifth fails, every seventh text is blank."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("bigint")
    return e.select(
        F.col("user_id").alias("image_id"), F.col("event_type").alias("engine_name"), "ts", "event_id",
        F.when(F.col("event_id") % 7 == 3, F.lit(" ")).otherwise(F.concat(F.lit(" t"), (k % 3).cast("string"), F.lit(" "))).alias("text"),
        ((F.col("event_id") * 37 % 101) / 100.0).alias("confidence"),
        (F.col("value") / 10.0).alias("processing_time"),
        F.when(F.col("event_id") % 5 == 4, F.lit("failed")).alias("error_message"),
    )


CALLS_SQL = """calls AS (
  SELECT user_id AS image_id, event_type AS engine_name, ts, event_id,
         CASE WHEN event_id % 7 = 3 THEN ' ' ELSE ' t' || CAST(CAST(json_extract_string(props, '$.k') AS BIGINT) % 3 AS VARCHAR) || ' ' END AS text,
         CAST(event_id * 37 % 101 AS DOUBLE) / 100.0 AS confidence, value / 10.0 AS processing_time,
         CASE WHEN event_id % 5 = 4 THEN 'failed' END AS error_message
  FROM events)"""


def ocr_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest call of each engine for each image, with the engine's place in the configured order."""
    w = Window.partitionBy("image_id", "engine_name").orderBy(F.desc("ts"), F.desc("event_id"))
    latest = engine_calls(spark, sf_dir).withColumn("rn", F.row_number().over(w)).where("rn = 1")
    return latest.join(F.broadcast(engines(spark)), "engine_name").select(
        "image_id", "engine_name", F.col("config_pos").alias("pos"), F.coalesce("priority", F.lit(999)).alias("priority"), "enabled", "text", "confidence", "processing_time", "error_message"
    )


RESULTS_SQL = f"""{ENGINES_SQL}, {CALLS_SQL}, ocr AS (
  SELECT image_id, c.engine_name, config_pos AS pos, coalesce(priority, 999) AS priority, enabled, text, confidence, processing_time, error_message
  FROM (SELECT * FROM calls QUALIFY row_number() OVER (PARTITION BY image_id, engine_name ORDER BY ts DESC, event_id DESC) = 1) c
  JOIN engines e ON c.engine_name = e.engine_name)"""


def math_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts of all documents and the formulas; formulas have negative ids.

    A caller whose table lies in one small file may set ``tallysheet.text.partitions``
    to deal its texts out to that many tasks; by default they stay as they are scanned.
    """
    made = spark.createDataFrame([(-1 - k, t) for k, t in enumerate(FORMULAS)], "id bigint, text string")
    docs, parts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), spark.conf.get("tallysheet.text.partitions", None)
    return (docs.repartition(int(parts)) if parts else docs).unionByName(made)


FORMULAS_SQL = f"made(id, text) AS (VALUES {_values([(-1 - k, t) for k, t in enumerate(FORMULAS)])})"
TEXTS_SQL = f"{FORMULAS_SQL}, texts AS (SELECT doc_id AS id, text FROM documents UNION ALL SELECT id, text FROM made)"


def word_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line item is a word on the page of its order."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("page_id"),
        (F.col("l_partkey") * 1000000 + F.col("l_suppkey") * 1000 + F.col("l_linenumber") * 10 + (F.col("l_quantity") % 10).cast("bigint")).alias("idx"),
        F.concat(F.lit("w"), (F.col("l_partkey") % 97).cast("string")).alias("text"),
        (F.col("l_quantity") - 3).alias("conf"),
        (F.col("l_suppkey") * 7 % 400).cast("double").alias("left"),
        (F.col("l_partkey") * 13 % 90).cast("double").alias("top"),
        (10 + F.col("l_partkey") % 50).cast("double").alias("width"),
        F.lit(12.0).alias("height"),
    )


BOXES_SQL = """boxes AS (
  SELECT l_orderkey AS page_id, l_partkey * 1000000 + l_suppkey * 1000 + l_linenumber * 10 + CAST(l_quantity % 10 AS BIGINT) AS idx,
         'w' || CAST(l_partkey % 97 AS VARCHAR) AS text, l_quantity - 3 AS conf, CAST(l_suppkey * 7 % 400 AS DOUBLE) AS "left",
         CAST(l_partkey * 13 % 90 AS DOUBLE) AS top, CAST(10 + l_partkey % 50 AS DOUBLE) AS width, CAST(12 AS DOUBLE) AS height
  FROM lineitem)"""


def qr_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One detection for each order on the image of its customer; some lack a key, hold a null, an array or no JSON, or repeat."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    k = F.col("o_orderkey")
    ident = F.concat(F.lit("AG_"), (k % 400).cast("string"))
    body = F.concat(F.lit('"assignment_name":"'), F.col("o_orderpriority"), F.lit('","subject":"'), F.col("c_mktsegment"), F.lit('","total_points":'), (k % 150).cast("string"), F.lit("}"))
    data = (
        F.when(k % 7 == 0, F.concat(F.lit("{"), body))
        .when(k % 11 == 0, F.lit("not json"))
        .when(k % 13 == 0, F.lit("[1,2]"))
        .when(k % 17 == 0, F.concat(F.lit('{"assignment_id":null,'), body))
        .otherwise(F.concat(F.lit('{"assignment_id":"'), ident, F.lit('",'), body))
    )
    return o.select(
        F.col("o_custkey").alias("image_id"), k.alias("seq"), data.alias("data"),
        F.element_at(F.array(*[F.lit(r[0]) for r in REGIONS]), (k % 4 + 1).cast("int")).alias("region"),
        F.when(k % 2 == 0, "pyzbar").otherwise("opencv").alias("method"), F.when(k % 2 == 0, 1.0).otherwise(0.9).alias("confidence"),
        (k * 3 % 300).cast("int").alias("x"), (k * 5 % 300).cast("int").alias("y"), (30 + k * 7 % 480).cast("int").alias("w"), (30 + k * 11 % 490).cast("int").alias("h"),
    )


DETECTIONS_SQL = f"""{REGIONS_SQL}, det AS (
  SELECT o_custkey AS image_id, o_orderkey AS seq,
         CASE WHEN o_orderkey % 7 = 0 THEN '{{' || body WHEN o_orderkey % 11 = 0 THEN 'not json' WHEN o_orderkey % 13 = 0 THEN '[1,2]'
              WHEN o_orderkey % 17 = 0 THEN '{{"assignment_id":null,' || body ELSE '{{"assignment_id":"AG_' || CAST(o_orderkey % 400 AS VARCHAR) || '",' || body END AS data,
         CASE o_orderkey % 4 WHEN 0 THEN 'top_right' WHEN 1 THEN 'top_left' WHEN 2 THEN 'bottom_right' ELSE 'full_image' END AS region,
         CASE WHEN o_orderkey % 2 = 0 THEN 'pyzbar' ELSE 'opencv' END AS method, CAST(CASE WHEN o_orderkey % 2 = 0 THEN 1.0 ELSE 0.9 END AS DOUBLE) AS confidence,
         CAST(o_orderkey * 3 % 300 AS INTEGER) AS x, CAST(o_orderkey * 5 % 300 AS INTEGER) AS y, CAST(30 + o_orderkey * 7 % 480 AS INTEGER) AS w, CAST(30 + o_orderkey * 11 % 490 AS INTEGER) AS h
  FROM (SELECT *, '"assignment_name":"' || o_orderpriority || '","subject":"' || c_mktsegment || '","total_points":' || CAST(o_orderkey % 150 AS VARCHAR) || '}}' AS body
        FROM orders JOIN customer ON o_custkey = c_custkey))"""


def rasters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding of 64 components as a grey image of 8 by 8."""
    e = table(spark, sf_dir, "embeddings")
    gray = F.transform("embedding", lambda v: F.least(F.greatest(F.floor((v.cast("double") + 1) * 127.5).cast("int"), F.lit(0)), F.lit(255)))
    return e.select(F.col("vec_id").alias("image_id"), F.lit(8).alias("height"), F.lit(8).alias("width"), gray.alias("pixels"))


RASTERS_SQL = """ras AS (
  SELECT vec_id AS image_id, list_transform(embedding, lambda v: least(greatest(CAST(floor((CAST(v AS DOUBLE) + 1) * 127.5) AS INTEGER), 0), 255)) AS px FROM embeddings),
pix AS (SELECT image_id, unnest(px) AS v, generate_subscripts(px, 1) - 1 AS i FROM ras),
grid AS (SELECT image_id, i // 8 AS r, i % 8 AS c, v FROM pix)"""


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order asks for an assignment from a template; some templates don't exist, some dates are none."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    return o.select(
        k.alias("request_id"),
        F.element_at(F.array(*[F.lit(t) for t in ("fractions_intro", "ratios_review", "angles_practice", "missing")]), (k % 4 + 1).cast("int")).alias("template_id"),
        F.concat(F.lit("Work "), k.cast("string")).alias("assignment_name"),
        F.when(k % 9 == 5, F.lit("soon")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("due_date"),
        F.when(k % 3 == 0, F.concat(F.lit("Period "), (k % 7).cast("string"))).alias("class_period"), F.lit(None).cast("string").alias("teacher_name"),
        F.when(k % 5 < 2, (k % 5 * 60).cast("int")).alias("custom_points"),
        F.col("o_orderdate").alias("created_at"),
    )


REQUESTS_SQL = """req AS (
  SELECT o_orderkey AS request_id, CASE o_orderkey % 4 WHEN 0 THEN 'fractions_intro' WHEN 1 THEN 'ratios_review' WHEN 2 THEN 'angles_practice' ELSE 'missing' END AS template_id,
         'Work ' || CAST(o_orderkey AS VARCHAR) AS assignment_name, CASE WHEN o_orderkey % 9 = 5 THEN 'soon' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS due_date,
         CASE WHEN o_orderkey % 3 = 0 THEN 'Period ' || CAST(o_orderkey % 7 AS VARCHAR) END AS class_period, CAST(NULL AS VARCHAR) AS teacher_name,
         CASE WHEN o_orderkey % 5 < 2 THEN CAST(o_orderkey % 5 * 60 AS INTEGER) END AS custom_points, o_orderdate AS created_at
  FROM orders)"""


def test_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part is a test of the suite of its brand; it passes by its key and scores by its price."""
    p = table(spark, sf_dir, "part")
    return p.select(F.concat(F.lit("s"), (F.col("p_partkey") % 25).cast("string")).alias("suite"), F.col("p_partkey").cast("string").alias("test"), (F.col("p_partkey") * 7 % 10 < 4 + F.col("p_partkey") % 25 / 5).alias("passed"), (F.col("p_partkey") * 31 % 101).cast("double").alias("score"))


TESTS_SQL = """tests AS (
  SELECT 's' || CAST(p_partkey % 25 AS VARCHAR) AS suite, CAST(p_partkey AS VARCHAR) AS test, p_partkey * 7 % 10 < 4 + CAST(p_partkey % 25 AS DOUBLE) / 5 AS passed, CAST(p_partkey * 31 % 101 AS DOUBLE) AS score FROM part)"""
