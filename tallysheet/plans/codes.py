"""Queries over QR symbols, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallysheet.operators import detectors, symbols
from tallysheet.plans.registry import query
from tallysheet.sources import relations as R

SYMBOLS_SQL = "sym(version, level, most, checks, codewords) AS (VALUES " + ", ".join(f"({v}, '{lv}', {most}, {checks}, {len(spots) // 8})" for v, lv, _, _, most, checks, _, _, _, spots, *_ in symbols.table_rows()) + ")"


def payloads(spark, d):
    """The identifying part of every order's payload, at one of the four levels.

    Dealt out before the work begins: a symbol costs far more than its payload of a hundred bytes.
    """
    k = F.col("o_orderkey")
    text = F.concat(F.lit('{"assignment_id":"AG_'), k.cast("string"), F.lit('","assignment_name":"Work '), F.col("o_custkey").cast("string"), F.lit('","subject":"'), F.col("o_orderpriority"), F.lit('"}'))
    level = F.element_at(F.array(*map(F.lit, symbols.LEVELS)), (k % 4 + 1).cast("int"))
    return R.table(spark, d, "orders").select(k.alias("request_id"), level.alias("level"), text.alias("payload")).repartition(4 * spark.sparkContext.defaultParallelism, "request_id")


@query("s14_i22_qr_round_trip", f"""WITH {SYMBOLS_SQL}, p AS (
  SELECT o_orderkey AS request_id, ['L', 'M', 'Q', 'H'][o_orderkey % 4 + 1] AS level, '{{"assignment_id":"AG_' || o_orderkey || '","assignment_name":"Work ' || o_custkey || '","subject":"' || o_orderpriority || '"}}' AS payload FROM orders),
v AS (SELECT p.*, version, checks, codewords FROM p LEFT JOIN sym ON sym.level = p.level AND most >= strlen(payload) QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY version) = 1),
e AS (SELECT request_id, count(DISTINCT (request_id * 31 + j * 17) % (codewords * 8) // 8) AS errors FROM v, range(0, 16) r(j) WHERE j < request_id % (checks // 2 + 1) GROUP BY request_id)
SELECT request_id, level, version, 17 + 4 * version AS size, CASE WHEN request_id % 10 > 0 THEN payload END AS decoded, CASE WHEN request_id % 10 > 0 THEN coalesce(errors, 0)::INTEGER END AS errors, CASE WHEN request_id % 10 = 0 THEN 'no format' END AS decode_error
FROM v LEFT JOIN e USING (request_id)""")
def qr_round_trip(spark, d):
    """Every order's payload as a symbol, damaged by as many modules as its level bears (every tenth one wiped), and read again."""
    k = F.col("request_id")
    made = symbols.encoded(payloads(spark, d)).drop("payload", "mask")
    known = symbols.symbol_table(spark).select("version", "level", "checks", "spots")
    rows = made.join(F.broadcast(known), ["version", "level"])
    hit = F.filter(F.sequence(F.lit(0), F.lit(15)), lambda j: j < k % (F.floor(F.col("checks") / 2) + 1))
    places = F.transform(hit, lambda j: F.get("spots", ((k * 31 + j * 17) % (F.floor(F.size("spots") / 8) * 8)).cast("int")))
    damaged = F.when(k % 10 == 0, F.transform("symbol", lambda _: F.lit(0).cast("long"))).otherwise(symbols.flipped(F.col("symbol"), places))
    return symbols.decoded(rows.withColumn("symbol", damaged)).select("request_id", "level", "version", "size", "decoded", "errors", "decode_error")


#: A page's width and height, and the part of it that holds each customer's symbol.
PAGE = 260, 340
PLACES = [(int(x * PAGE[0]), int(y * PAGE[1])) if region != "full_image" else (80, 120) for region, _, x, y, _, _ in R.REGIONS]


@query("i22_u4_detected_symbols", f"""WITH {SYMBOLS_SQL}, p AS (
  SELECT c_custkey AS k, ['L', 'M', 'Q', 'H'][c_custkey % 3 + 1] AS level, '{{"assignment_id":"AG_' || c_custkey || '","assignment_name":"Work ' || c_nationkey || '","subject":"' || c_mktsegment || '"}}' AS data FROM customer),
v AS (SELECT p.*, CAST(34 + 8 * version AS INTEGER) AS side FROM p JOIN sym ON sym.level = p.level AND most >= strlen(data) QUALIFY row_number() OVER (PARTITION BY k ORDER BY version) = 1)
SELECT k AS image_id, [{", ".join(f"'{r[0]}'" for r in R.REGIONS)}][k % 4 + 1] AS region, CAST(k % 3 + CASE WHEN k % 4 = 3 THEN {PLACES[3][0]} ELSE 0 END AS INTEGER) AS x, CAST(k % 2 + CASE WHEN k % 4 = 3 THEN {PLACES[3][1]} ELSE 0 END AS INTEGER) AS y, side AS w, side AS h, data, NULL AS error_message FROM v""")
def detected_symbols(spark, d):
    """Every customer's symbol on a page of its own, in one of four places and four turns, found region by region and read."""
    k = F.col("image_id")
    c = R.table(spark, d, "customer").repartition(4 * spark.sparkContext.defaultParallelism, "c_custkey")
    text = F.concat(F.lit('{"assignment_id":"AG_'), F.col("c_custkey").cast("string"), F.lit('","assignment_name":"Work '), F.col("c_nationkey").cast("string"), F.lit('","subject":"'), F.col("c_mktsegment"), F.lit('"}'))
    level = F.element_at(F.array(*map(F.lit, symbols.LEVELS)), (F.col("c_custkey") % 3 + 1).cast("int"))
    made = symbols.encoded(c.select(F.col("c_custkey").alias("image_id"), level.alias("level"), text.alias("payload")))
    at = lambda axis: F.element_at(F.array(*[F.lit(p[axis]) for p in PLACES]), (k % 4 + 1).cast("int"))
    rows = made.select("image_id", detectors.turned(F.col("symbol"), F.floor(k / 4) % 4).alias("symbol"), (at(0) + k % 3).alias("x"), (at(1) + k % 2).alias("y"), (k % 60).alias("ink"), (200 + k % 50).alias("paper"))
    pages = detectors.printed(rows, *PAGE)
    known = detectors.Detectors()
    known.register("upright", detectors.upright_symbols, priority=1)
    found = known.search(pages, [(region, *share) for region, _, *share in R.REGIONS])
    return detectors.read(found).select("image_id", "region", "x", "y", "w", "h", "data", "error_message")
