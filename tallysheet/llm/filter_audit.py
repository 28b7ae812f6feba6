"""How filters of documents act together: every order of five filters, step by step.

One pass over the texts gives each document's failures as a bit mask, its length
in code points and a hash of each successive block. Copies are found by
partition refinement on these narrow rows: classes of one length are split by
one block hash after the other, and classes of one row are dropped each time;
only the survivors' whole texts are compared. What a filter does in any order
depends on the masks' counts alone: 32 numbers for each part and kind of label.
"""

from __future__ import annotations

import re
from functools import reduce
from itertools import permutations
from math import factorial

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallysheet.llm.common import forget, row_key, small_batches, splittable, text_or_empty, written

#: Filters by letter; bit k of a mask is the k-th.
FILTERS = "ABCDE"
#: A: fewer words. B: fewer distinct words a hundred words. C: more capitals a hundred code points. D: any of these.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, MARKS = 200, 50, 2, b"#$%&*|"
#: Starts of the successive blocks, in code points; the last goes on to the end.
BLOCKS = (0, 64, 1024, 16384)
CAPITALS = bytes(range(65, 91))
#: Bytes whose words are counted at once.
CHUNK = 1 << 20
FACTS = T.StructType().add("mask", T.IntegerType()).add("chars", T.LongType()).add("blocks", T.ArrayType(T.LongType()))
BLANK = re.compile(rb"[\x20\x09-\x0D]")


def word_counts(data: bytes) -> tuple[int, int]:
    """Words and distinct words of a text; ``bytes.split`` parts it at space and the controls from tab to carriage return."""
    words, seen, start = 0, set(), 0
    while start < len(data):
        blank = BLANK.search(data, start + CHUNK)
        end = blank.start() if blank else len(data)
        found = data[start:end].split()
        words += len(found)
        seen.update(found)
        start = end
    return words, len(seen)


def own_failures(text: str) -> int:
    """Bits of the filters A to D that a text fails by itself."""
    data = text.encode("utf-8", "surrogatepass")
    words, distinct = word_counts(data)
    capitals = len(data) - len(data.translate(None, CAPITALS))
    fails = (words < LEAST_WORDS, 100 * distinct < LEAST_DISTINCT * words, 100 * capitals > MOST_CAPITALS * len(text), any(m in data for m in MARKS))
    return sum(1 << k for k, fail in enumerate(fails) if fail)


def block_hashes(text: str) -> list[int]:
    """Signed 64-bit hashes of the successive blocks of a whole text; empty blocks have the hash of nothing."""
    ends = (*BLOCKS[1:], None)
    found = (xxhash.xxh64_intdigest(text[a:b].encode("utf-8", "surrogatepass")) for a, b in zip(BLOCKS, ends, strict=True))
    return [h - (1 << 64) if h >> 63 else h for h in found]


@F.pandas_udf(FACTS)
def facts(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame({"mask": [own_failures(t) for t in texts], "chars": [len(t) for t in texts], "blocks": [block_hashes(t) for t in texts]})


def shared(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose keys another row has too."""
    many = rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").drop("n")
    return rows.join(splittable(many), keys, "left_semi")


def suspects(rows: DataFrame) -> DataFrame:
    """Rows (``none, id, hash, chars, blocks``) left by the refinement: of one length and the same hashes as another."""
    blocks = [f"block{k}" for k in range(len(BLOCKS))]
    rows = rows.select("none", "id", "hash", "chars", *[F.get("blocks", k).alias(b) for k, b in enumerate(blocks)])
    left = written(shared(rows, ["chars"]), "refined")
    for k in range(len(blocks)):
        finer = written(shared(left, ["chars", *blocks[: k + 1]]), "refined")
        forget(rows.sparkSession, left)
        left = finer
    return left


def copies(docs: DataFrame, rows: DataFrame, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """Keys ``none, id, hash`` of rows whose whole text a row of a smaller id has; null ids are greater than all others.

    ``rows`` has the keys, lengths and block hashes of ``docs``.
    """
    spark = docs.sparkSession
    left = suspects(rows)
    keyed = docs.select(*[c.alias(n) for c, n in zip(row_key(text, row_id), ("none", "id", "hash"), strict=True)], text_or_empty(f"`{text}`").alias("text"))
    # Rows alike in id and text are one row here: none is a copy of another.
    classes = left.select("none", "id", "hash", F.xxhash64("chars", *[c for c in left.columns if c.startswith("block")]).alias("class")).distinct()
    # Merged at every size: what is broadcast here would grow with the copies.
    met = written(keyed.join(splittable(classes).hint("merge"), ["none", "id", "hash"]), "suspects")
    forget(spark, left)
    least = met.groupBy("class", "text").agg(F.min(F.struct("none", "id")).alias("least"))
    return met.join(splittable(least), ["class", "text"]).where(F.struct("none", "id") > F.col("least")).select("none", "id", "hash").distinct()


def masks(docs: DataFrame, labels: DataFrame, part: str = "source", text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """One row per document: ``part, mask, good, toxic``; bit k of ``mask`` says that it fails the k-th filter.

    A document is good or toxic if any of its labels says 1.
    """
    small_batches(docs.sparkSession)
    keys = dict(zip(("none", "id", "hash"), row_key(text, row_id), strict=True))
    rows = docs.select(*[c.alias(n) for n, c in keys.items()], F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"), facts(text_or_empty(f"`{text}`")).alias("f"))
    rows = written(rows.select("none", "id", "hash", "part", "f.*"), "facts")
    again = copies(docs, rows, text, row_id).withColumn("again", F.lit(1 << FILTERS.index("E")))
    said = labels.where(F.col(row_id).isNotNull()).groupBy(F.col(row_id).cast("long").alias("id"))
    said = said.agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")).withColumn("none", F.lit(False))
    found = rows.select("none", "id", "hash", "part", "mask").join(splittable(again), ["none", "id", "hash"], "left").join(splittable(said), ["none", "id"], "left")
    whole = F.col("mask") + F.coalesce("again", F.lit(0))
    return found.select("part", whole.alias("mask"), F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))


def untouched(counts: Column, what: str) -> Column:
    """For each set of filters, as a mask, how many documents fail none of them."""
    return F.transform(F.sequence(F.lit(0), F.lit(2 ** len(FILTERS) - 1)), lambda s: F.aggregate(counts, F.lit(0).cast("long"), lambda n, c: n + F.when(c["mask"].bitwiseAND(s) == 0, c[what]).otherwise(F.lit(0))))


def shares(free: Column, bit: Column) -> Column:
    """What the filter of ``bit`` removes, summed over all orders: each set that can stand before it counts as often as it does."""
    n = len(FILTERS)
    orders = F.array(*[F.lit(factorial(k) * factorial(n - 1 - k)).cast("long") for k in range(n)])

    def share(s: Column) -> Column:
        with_it = s.bitwiseOR(bit)
        return F.when(s == with_it, F.lit(0)).otherwise(F.get(orders, F.bit_count(s)) * (F.get(free, s) - F.get(free, with_it)))

    return F.aggregate(F.sequence(F.lit(0), F.lit(2**n - 1)), F.lit(0).cast("long"), lambda total, s: total + share(s))


def interactions(marked: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step from rows ``part, mask, good, toxic``.

    Returns ``part, filter_order, step, kept, removed, redundant, unique_fails,
    good_lost, toxic_lost, shapley``, zeros included.
    """
    cells = marked.groupBy("part", "mask").agg(F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    # 32 entries a part at most.
    parts = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("counts"))
    parts = parts.select("part", *[untouched(F.col("counts"), c).alias(c) for c in ("n", "good", "toxic")], F.map_from_entries(F.transform("counts", lambda c: F.struct(c["mask"], c["n"]))).alias("alone"))
    orders = F.split(F.lit(",".join(map("".join, permutations(FILTERS)))), ",")
    steps = parts.select("*", F.explode(orders).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    bits = lambda at: reduce(lambda v, k: F.when(F.substring("filter_order", at, 1) == FILTERS[k], 1 << k).otherwise(v), range(len(FILTERS)), F.lit(0))
    before = reduce(lambda v, k: v + F.when(F.col("step") > k, bits(k)).otherwise(0), range(1, len(FILTERS)), F.lit(0))
    own = reduce(lambda v, k: F.when(F.col("step") == k, bits(k)).otherwise(v), range(1, len(FILTERS) + 1), F.lit(0))
    steps = steps.withColumns({"before": before, "bit": own}).withColumn("after", F.col("before") + F.col("bit"))
    lost = lambda c: F.get(c, F.col("before")) - F.get(c, F.col("after"))
    return steps.select(
        "part", "filter_order", "step",
        F.get("n", F.col("after")).alias("kept"), lost("n").alias("removed"), (F.get("n", F.lit(0)) - F.get("n", F.col("bit")) - lost("n")).alias("redundant"),
        F.coalesce(F.element_at("alone", F.col("bit")), F.lit(0)).cast("long").alias("unique_fails"), lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"),
        shares(F.col("n"), F.col("bit")).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, part: str = "source", text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """What each filter does in every order, by part; see :func:`interactions`.

    Null text counts as empty and fails A alone (and E, if another row is empty);
    a null part is the empty string. A row with a null id fails E if any row with
    an id has its text; rows that repeat an id and its text are no copies of each
    other. Without documents there are no rows; further columns are ignored.
    """
    return interactions(masks(docs, labels, part, text, row_id))


def audit_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13: the five filters over all documents, by source."""
    return audit(*(spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels")))


AUDIT_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS tx, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
m AS (
  SELECT doc_id, part,
    CASE WHEN len(words) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(tx, '[^A-Z]+', '', 'g')) > 2 * length(tx) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(tx, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY tx) THEN 16 ELSE 0 END AS mask
  FROM t),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM m LEFT JOIN l USING (doc_id) GROUP BY part, mask),
x(f) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
o AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM x a, x b, x c, x d, x e
  WHERE a.f NOT IN (b.f, c.f, d.f, e.f) AND b.f NOT IN (c.f, d.f, e.f) AND c.f NOT IN (d.f, e.f) AND d.f <> e.f),
s AS (
  SELECT filter_order, step, filter_order[step] AS f, 1 << (ascii(filter_order[step]) - 65) AS bit,
         list_sum(list_transform(string_split(filter_order[1:step], ''), lambda y: 1 << (ascii(y) - 65))) - (1 << (ascii(filter_order[step]) - 65)) AS before
  FROM o, range(1, 6) r(step)),
r AS (
  SELECT part, filter_order, step, f,
    sum(CASE WHEN mask & (before::INT | bit) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN mask & before::INT = 0 AND mask & bit > 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN mask & before::INT > 0 AND mask & bit > 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN mask & before::INT = 0 AND mask & bit > 0 THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN mask & before::INT = 0 AND mask & bit > 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM c, s GROUP BY part, filter_order, step, f)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
       good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM r
"""
