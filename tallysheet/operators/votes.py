"""Agreement of several recognisers on one image.

Input: ``image_id, engine_name, pos, priority, text, confidence,
processing_time, error_message``, one row for each engine and image. Ties go to
the smaller (priority, engine_name). All results are grouped by image, with
partial aggregation; nothing is collected but the short list of an image's
engines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallysheet.functions.text import character_count, corrected
from tallysheet.functions.text import strip as _strip
from tallysheet.functions.validate import validated

def strip(name: str) -> Column:
    return _strip(F.col(name))


METHODS = ("highest_confidence", "weighted_vote", "consensus", "first_success")


def enabled(engines: DataFrame, available: DataFrame | None = None) -> DataFrame:
    """Enabled engines (and available ones, if given) with their rank by priority, then by configured place."""
    rows = engines.where("enabled").join(available.select("engine_name"), "engine_name", "left_semi") if available is not None else engines.where("enabled")
    # One row for each configured engine.
    return rows.withColumn("engine_rank", F.row_number().over(Window.orderBy(F.coalesce("priority", F.lit(999)), "config_pos")))


def successful(results: DataFrame) -> DataFrame:
    """No error and a text that isn't blank."""
    return results.where(F.col("error_message").isNull() & (strip("text") != ""))


def until_confident(results: DataFrame, enough: float = 0.9) -> DataFrame:
    """Engines in order of priority up to the first whose confidence suffices, that one included.

    Failed and blank results don't end the search. An image has as many results
    as engines are configured; for raw calls without such a bound see
    ``streaming.search``, which searches by windows of time.
    """
    before = Window.partitionBy("image_id").orderBy("priority", "pos", "engine_name").rowsBetween(Window.unboundedPreceding, -1)
    good = F.col("error_message").isNull() & (strip("text") != "") & (F.col("confidence") >= enough)
    return results.withColumn("__done", F.coalesce(F.max(good).over(before), F.lit(False))).where("not __done").drop("__done")


def _least(*order: Column) -> Column:
    return F.min_by(F.struct("text", "confidence", "engine_name"), F.struct(*order))


def _best() -> Column:
    return _least((-F.col("confidence")).alias("c"), F.col("priority"), F.col("engine_name"))


def highest_confidence(results: DataFrame) -> DataFrame:
    """A1: ``image_id, text, confidence, method``."""
    out = successful(results).groupBy("image_id").agg(_best().alias("b"))
    return out.select("image_id", F.col("b.text").alias("text"), F.col("b.confidence").alias("confidence"), F.lit("highest_confidence").alias("method"))


def weighted_vote(results: DataFrame) -> DataFrame:
    """A2: the text of the most confident engine; confidences weigh themselves. One result is passed through.

    Confidences are added up from the least on, at most one for each configured
    engine, so that reruns agree on means that meet a grade's bound to the last bit.
    """
    total = lambda of: F.aggregate("own", F.lit(0.0), lambda a, c: a + of(c))
    out = successful(results).groupBy("image_id").agg(_best().alias("b"), F.count("*").alias("n"), F.array_sort(F.collect_list(F.col("confidence").cast("double"))).alias("own"))
    out = out.withColumn("mean", total(lambda c: c * c) / F.nullif(total(lambda c: c), F.lit(0.0)))
    return out.select(
        "image_id", F.col("b.text").alias("text"), F.when(F.col("n") == 1, F.col("b.confidence")).otherwise(F.coalesce("mean", F.col("b.confidence"))).alias("confidence"),
        F.when(F.col("n") == 1, "single_result").otherwise("weighted_vote").alias("method"),
    )


def consensus(results: DataFrame) -> DataFrame:
    """A3: the text most engines agree on (the earliest of equals), raised by 0.1 for each of them, 0.3 at most."""
    groups = successful(results).withColumn("said", strip("text")).groupBy("image_id", "said").agg(F.count("*").alias("n"), F.avg("confidence").alias("mean"), F.min(F.struct("priority", "engine_name")).alias("first"))
    out = groups.groupBy("image_id").agg(F.min_by(F.struct("said", "n", "mean"), F.struct((-F.col("n")).alias("n"), "first")).alias("b"))
    return out.select("image_id", F.col("b.said").alias("text"), F.least(F.col("b.mean") + F.least(F.col("b.n") * 0.1, F.lit(0.3)), F.lit(1.0)).alias("confidence"), F.lit("consensus").alias("method"))


def first_success(results: DataFrame) -> DataFrame:
    """A4: the first usable result in the configured order."""
    out = successful(results).groupBy("image_id").agg(_least(F.col("pos"), F.col("engine_name")).alias("b"))
    return out.select("image_id", F.col("b.text").alias("text"), F.col("b.confidence").alias("confidence"), F.lit("first_success").alias("method"))


def aggregate(results: DataFrame, images: DataFrame, method: str = "weighted_vote") -> DataFrame:
    """A5: one row for each of ``images``; those without usable results are ``no_results``. Unknown methods take the first success."""
    by = {"highest_confidence": highest_confidence, "weighted_vote": weighted_vote, "consensus": consensus}.get(method, first_success)
    out = images.select("image_id").distinct().join(by(results), "image_id", "left")
    return out.select("image_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.coalesce("method", F.lit("no_results")).alias("method"))


def quality(results: DataFrame, aggregated: DataFrame) -> DataFrame:
    """P3, A6 to A9 over the results without an error, blank ones included: agreement, efficiency, consistency; a grade by the aggregated confidence.

    Images all of whose engines failed are ``poor`` with zeros and no counts.
    """
    good = F.col("error_message").isNull()
    said = F.when(good & (strip("text") != ""), strip("text"))
    rows = results.groupBy("image_id").agg(
        F.count_distinct(said).alias("texts"), F.avg(F.when(good, F.col("processing_time"))).alias("time"), F.stddev_pop(F.when(good, F.col("confidence"))).alias("spread"),
        F.count_if(good).alias("ok"), F.count("*").alias("total"),
    ).join(aggregated.select("image_id", F.col("confidence").alias("mean")), "image_id", "left")
    none = F.col("ok") == 0
    zero = lambda c: F.when(none, 0.0).otherwise(c)
    grade = F.when(none, "poor").when(F.col("mean") >= 0.8, "excellent").when(F.col("mean") >= 0.6, "good").when(F.col("mean") >= 0.4, "fair").otherwise("poor")
    return rows.select(
        "image_id", grade.alias("overall_quality"), zero(F.coalesce(F.try_divide(F.lit(1.0), F.col("texts").cast("double")), F.lit(0.0))).alias("engine_agreement"),
        zero(F.greatest(F.lit(0.0), 1 - F.col("time") / 60)).alias("processing_efficiency"), zero(F.when(F.col("ok") == 1, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - F.col("spread")))).alias("confidence_consistency"),
        F.when(~none, F.col("ok")).alias("successful_engines"), F.when(~none, F.col("total")).alias("total_engines"),
    )


def engine_statistics(calls: DataFrame, engines: DataFrame) -> DataFrame:
    """Totals of each configured engine; the mean confidence is over its usable results."""
    good = F.col("error_message").isNull() & (strip("text") != "")
    stats = calls.groupBy("engine_name").agg(F.count("*").alias("total_calls"), F.count_if(good).alias("successful_calls"), F.sum("processing_time").alias("total_time"), F.avg(F.when(good, F.col("confidence"))).alias("average_confidence"))
    zero = lambda c, v: F.coalesce(c, F.lit(v)).alias(c)
    rows = engines.select("engine_name", "enabled").join(stats, "engine_name", "left")
    return rows.select("engine_name", "enabled", zero("total_calls", 0), zero("successful_calls", 0), zero("total_time", 0.0), zero("average_confidence", 0.0), F.coalesce(F.try_divide(F.col("successful_calls").cast("double"), F.col("total_calls").cast("double")), F.lit(0.0)).alias("success_rate"))


def engines_used(results: DataFrame) -> DataFrame:
    """For each image the engines that gave a usable result and all that ran, in order of priority; an image has as many as are configured."""
    item = F.struct("priority", "engine_name")
    good = F.col("error_message").isNull() & (strip("text") != "")
    names = lambda c: F.array_join(F.transform(F.array_sort(c), lambda s: s["engine_name"]), ",")
    return results.groupBy("image_id").agg(names(F.collect_list(F.when(good, item))).alias("engines_used"), names(F.collect_list(item)).alias("engines_run"))


def corrected_aggregate(aggregated: DataFrame) -> DataFrame:
    """The final text corrected and whether that changed it; empty texts are left alone."""
    fixed = F.when(F.col("text") != "", corrected(F.col("text"))).otherwise(F.col("text"))
    rows = aggregated.withColumn("fixed", fixed)
    final = validated(F.col("text"), F.col("fixed"))
    rows = rows.withColumn("final_text", final)
    return rows.select("image_id", "final_text", "confidence", "method", (F.col("final_text") != F.col("text")).alias("symbol_corrections_applied"), character_count(F.col("final_text")).cast("long").alias("character_count"))


def responses(results: DataFrame, images: DataFrame, method: str = "weighted_vote") -> DataFrame:
    """One response for each image: aggregate, correct, grade (P13, and the record of each image)."""
    found = aggregate(results, images, method)
    out = corrected_aggregate(found).join(quality(results, found), "image_id", "left").join(engines_used(results), "image_id", "left")
    return out.withColumn("success", F.col("method") != "no_results")


def compare_engines(calls: DataFrame) -> DataFrame:
    """For each image and engine its best, mean and number of calls."""
    return calls.groupBy("image_id", "engine_name").agg(F.count("*").alias("calls"), F.max("confidence").alias("best"), F.avg("confidence").alias("mean"), F.count_if(F.col("error_message").isNotNull()).alias("failures"))


def passes(response: DataFrame, time: str = "total_time", least_confidence: float = 0.5, most_seconds: float = 15.0, least_characters: int = 10) -> DataFrame:
    """Whether a run passes, and its speed: excellent to 5 s, good to 10 s."""
    ok = F.col("success") & (F.col("confidence") >= least_confidence) & (F.col(time) <= most_seconds) & (F.col("character_count") >= least_characters)
    return response.withColumns({"passed": ok, "speed": F.when(F.col(time) <= 5, "excellent").when(F.col(time) <= 10, "good").otherwise("slow")})


def before_and_after(before: DataFrame, after: DataFrame) -> DataFrame:
    """For each image the change in confidence, characters and time."""
    b, a = before.alias("b"), after.alias("a")
    d = lambda c: (F.col(f"a.{c}") - F.col(f"b.{c}")).alias(f"{c}_change")
    return b.join(a, F.col("b.image_id") == F.col("a.image_id")).select(F.col("b.image_id").alias("image_id"), d("confidence"), d("character_count"), d("total_time"))
