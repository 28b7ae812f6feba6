"""Mixing sources to target weights by capped water-filling.

Built-in DataFrame functions only. One pass over the documents gives the word
count of each source and of each of its hash buckets; everything after that
works on those small tables, and the documents are only labelled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallysheet.llm.common import WORD, fresh, text_or_empty, written

#: Buckets of documents per source; a source's share is met to about one bucket's words.
BUCKETS = 4096


def word_count(text: str = "text") -> Column:
    """Words are runs of anything but ASCII white space; null has none."""
    return F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("long")


def ranked(sources: DataFrame, parts: int | None = None) -> DataFrame:
    """Zero-based rank of each source by code point, null last.

    A range partitioning orders the sources across tasks; ranks are counted
    within a task and moved up by the sizes of the tasks before it.
    """
    parts = parts or int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(
        sources.repartitionByRange(parts, F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()), "ranked"
    )
    before = dealt.groupBy("part").agg(F.count("*").alias("n"))
    # One row per partition: as many as `parts`, whatever the number of sources.
    before = before.withColumn("start", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    own = Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())
    return dealt.join(F.broadcast(before.select("part", "start")), "part").withColumn("rank", F.col("start") + F.row_number().over(own) - 1).drop("part", "start")


def water_fill(sources: DataFrame, max_epochs: float = 3.0) -> DataFrame:
    """Targets of sources with columns ``source, source_size, weight``.

    The targets share the sum of all sizes by weight. A source whose share
    exceeds ``max_epochs`` times its size is clamped there and the excess goes
    to the others by weight, until no share is above its limit. Each pass sends
    two sums to the driver; every pass but the last clamps a source. All sources
    clamped cannot occur for ``max_epochs`` of at least 1.
    """
    rows = written(sources.withColumn("cap", F.col("source_size") * F.lit(float(max_epochs))), "sources")
    total = rows.agg(F.sum("source_size")).first()[0] or 0
    # At level x a source gets min(cap, x * weight); it is clamped once x >= cap / weight.
    level = 0.0
    while True:
        clamped = F.col("cap") <= F.lit(level) * F.col("weight")
        free, held = rows.agg(F.sum(F.when(~clamped, F.col("weight"))), F.sum(F.when(clamped, F.col("cap")))).first()
        if not free:
            break
        nxt = (total - (held or 0.0)) / free
        if nxt <= level * (1 + 1e-12):
            break
        level = nxt
    return rows.withColumn("target", F.least(F.col("cap"), F.lit(level) * F.col("weight"))).drop("cap")


def bucketed(docs: DataFrame, seed: int, text: str, row_id: str, source: str, bucket: str) -> DataFrame:
    """``docs`` with two more columns of the given names: the source as a string and the seeded hash bucket of id and text."""
    return docs.withColumns({source: F.col("source").cast("string"), bucket: F.pmod(F.xxhash64(F.lit(seed), F.col(f"`{row_id}`"), F.col(f"`{text}`")), F.lit(BUCKETS)).cast("int")})


def allotments(sized: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), max_epochs: float = 3.0) -> DataFrame:
    """One row per source and bucket: ``source, bucket, source_size, target, copies``.

    ``sized`` has a row per document: ``source, bucket, size``. A source's epochs
    are its target over its size: each bucket is taken the whole number of times,
    and some buckets once more: those that fit, in order, and one that fills the
    gap best. At most :data:`BUCKETS` rows a source.
    """
    cells = written(sized.groupBy("source", "bucket").agg(F.sum("size").alias("words")), "cells")
    sources = cells.groupBy("source").agg(F.sum("words").alias("source_size"))
    filled = water_fill(weighted(sources, weights), max_epochs)
    epochs = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    # An epoch count within rounding of a whole number is that number.
    whole = F.floor(epochs + 1e-9)
    filled = filled.withColumns({"whole": whole, "rest": F.col("target") - whole * F.col("source_size")})
    # Once more: buckets in order while they fit into the rest, passing over those that don't, then the
    # one bucket that best fills what is left. At most BUCKETS rows a source, so each window is bounded.
    own, upto = Window.partitionBy("c.source"), Window.partitionBy("c.source").orderBy("c.bucket").rowsBetween(Window.unboundedPreceding, 0)
    run = cells.alias("c").join(filled.alias("t"), F.col("c.source").eqNullSafe(F.col("t.source"))).withColumns({"gap": F.col("rest"), "extra": F.lit(False)})
    for _ in range(3):
        small = ~F.col("extra") & (F.col("words") > 0) & (F.col("words") <= F.col("gap") + 1e-6)
        run = run.withColumn("upto", F.sum(F.when(small, F.col("words")).otherwise(0)).over(upto))
        fits = small & (F.col("upto") <= F.col("gap") + 1e-6)
        run = run.withColumns({"extra": F.col("extra") | fits, "gap": F.col("gap") - F.coalesce(F.max(F.when(fits, F.col("upto"))).over(own), F.lit(0))})
    off = F.abs(F.col("words") - F.col("gap"))
    run = run.withColumn("filler", F.min(F.when(~F.col("extra") & (off < F.col("gap")), F.struct(off.alias("off"), "c.bucket"))).over(own))
    picked = run.withColumn("extra", (F.col("extra") | F.coalesce(F.col("c.bucket") == F.col("filler.bucket"), F.lit(False))).cast("int"))
    return picked.select(F.col("c.source").alias("source"), F.col("c.bucket").alias("bucket"), "source_size", "target", (F.col("whole") + F.col("extra")).cast("int").alias("copies"))


def weighted(sources: DataFrame, weights: tuple[float, ...]) -> DataFrame:
    """Sources ``source, source_size`` with their weight: the weights go to them by rank, repeating."""
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    return ranked(sources).select("source", "source_size", turn.alias("weight"))


def targets(docs: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), max_epochs: float = 3.0, text: str = "text") -> DataFrame:
    """One row per source: ``source, source_size, weight, target``, as :func:`plan` mixes them."""
    sized = docs.select(F.col("source").cast("string").alias("source"), word_count(text).alias("size"))
    return water_fill(weighted(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights), max_epochs)


def plan(docs: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), max_epochs: float = 3.0, seed: int = 7, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """One row per document: ``doc_id, source, size, source_size, target, copies, taken``.

    ``weights`` go to the sources by rank, repeating; documents are taken as
    :func:`allotments` says of their bucket, a seeded hash of id and text, so
    reruns agree and rows alike are treated alike. Null text has size 0 and
    takes 0 words; a null source is a source of its own; an empty table gives no
    rows; a source without words has target 0; further columns are ignored.
    """
    source, bucket = fresh(docs.columns, "of_source", "in_bucket")
    sized = bucketed(docs, seed, text, row_id, source, bucket)
    sized = written(sized.select(F.col(f"`{row_id}`").cast("long").alias("doc_id"), F.col(source).alias("source"), word_count(text).alias("size"), F.col(bucket).alias("bucket")), "sized")
    return (
        sized.alias("d")
        .join(allotments(sized, weights, max_epochs).alias("p"), F.col("d.source").eqNullSafe(F.col("p.source")) & (F.col("d.bucket") == F.col("p.bucket")))
        .select("d.doc_id", F.col("d.source").alias("source"), "d.size", "p.source_size", "p.target", "p.copies", (F.col("p.copies") * F.col("d.size")).alias("taken"))
    )


def mixed(docs: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), max_epochs: float = 3.0, seed: int = 7, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """The mixed documents: each row of ``docs`` as often as :func:`plan` takes it, columns unchanged."""
    source, bucket, of, place, copies, copy = fresh(docs.columns, "of_source", "in_bucket", "taken_source", "taken_bucket", "copies", "copy")
    rows = bucketed(docs, seed, text, row_id, source, bucket)
    taken = allotments(rows.select(F.col(source).alias("source"), F.col(bucket).alias("bucket"), word_count(text).alias("size")), weights, max_epochs)
    taken = taken.where("copies > 0").select(F.col("source").alias(of), F.col("bucket").alias(place), F.col("copies").alias(copies))
    out = rows.join(taken, F.col(source).eqNullSafe(F.col(of)) & (F.col(bucket) == F.col(place)))
    return out.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*[F.col(f"`{c}`") for c in docs.columns])


def mix_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: every document with the words that the mix takes of it."""
    return plan(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")


def targets_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8 by source: what each weighs and the words it is to give, the part of the mix that SQL can say."""
    found = targets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("source", "source_size", "weight", F.round("target", 3).alias("target"))


TARGETS_SQL = r"""
WITH s AS (SELECT source, sum(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))) AS size FROM documents GROUP BY source),
w AS (SELECT *, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS weight FROM s),
-- Sources in the order in which a rising level clamps them; the level that lies before the next one is the answer.
k AS (SELECT *, row_number() OVER (ORDER BY 3 * size / weight, source) AS n, sum(size) OVER () AS total, sum(weight) OVER () AS whole FROM w),
c AS (
  SELECT n, sum(3 * size) OVER o AS held, whole - sum(weight) OVER o AS free, total, coalesce(lead(3 * size / weight) OVER o, 'infinity') AS next FROM k WINDOW o AS (ORDER BY n)
  UNION ALL SELECT 0, 0, any_value(whole), any_value(total), min(3 * size / weight) FROM k),
l AS (SELECT (total - held) / free AS level FROM c WHERE free > 1e-9 AND (total - held) / free <= next ORDER BY n LIMIT 1)
SELECT source, CAST(size AS BIGINT) AS source_size, weight, round(least(3.0 * size, level * weight), 3) AS target FROM w, l
"""
