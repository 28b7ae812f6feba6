"""Reports over corrections and test runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallysheet.functions.text import corrected, improvement, with_substitution_types
from tallysheet.functions.validate import is_expression


def corrections(texts: DataFrame) -> DataFrame:
    """T5, T10, T28, A14's input: ``id, text, corrected, types, original_parses, corrected_parses, estimated_improvement``.

    The rules and their types come from one fold over the stages of a text, so that each stage is computed once.
    """
    rows = with_substitution_types(texts.select("id", "text")).withColumn("corrected", corrected(F.col("text")))
    rows = rows.withColumns({"original_parses": is_expression(F.col("text")), "corrected_parses": is_expression(F.col("corrected"))})
    return rows.withColumn("estimated_improvement", improvement(F.col("original_parses"), F.col("corrected_parses"), F.col("text"), F.col("corrected")))


def correction_counts(corrected_texts: DataFrame) -> DataFrame:
    """Texts changed by each type of rule, one count for each rule that changed a text."""
    return corrected_texts.select(F.explode("types").alias("type")).groupBy("type").agg(F.count("*").alias("corrections"))


def validation_rate(corrected_texts: DataFrame, parses: str = "corrected_parses") -> DataFrame:
    """Attempts, successes and their share, 0 without attempts."""
    rows = corrected_texts.agg(F.count("*").alias("attempts"), F.coalesce(F.count_if(parses), F.lit(0)).alias("successes"))
    return rows.withColumn("success_rate", F.coalesce(F.try_divide(F.col("successes").cast("double"), F.col("attempts").cast("double")), F.lit(0.0)))


def suites(results: DataFrame) -> DataFrame:
    """Runs, passes, success in percent and its grade (90, 75, 50), the 60 percent gate, and whether scores spread by more than 20."""
    rows = results.groupBy("suite").agg(F.count("*").alias("tests_run"), F.count_if("passed").alias("tests_passed"), (F.avg(F.col("passed").cast("int")) * 100).alias("success_rate"), (F.max("score") - F.min("score")).alias("spread"))
    r = F.col("success_rate")
    return rows.withColumns({"grade": F.when(r >= 90, "excellent").when(r >= 75, "good").when(r >= 50, "fair").otherwise("poor"), "robust": r >= 60, "varies": F.col("spread") > 20})


def first_failures(results: DataFrame, n: int = 3) -> DataFrame:
    """The first failed tests of each suite, by name; ranked in a window, which Spark limits to ``n`` rows of a suite in each task before it shuffles."""
    from pyspark.sql import Window

    w = Window.partitionBy("suite").orderBy("test")
    return results.where("not passed").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).select("suite", "rank", "test")


def mean_formula_confidence(formulas: DataFrame) -> DataFrame:
    """Mean confidence by type of formula, in hundredths summed as whole numbers, so that their order can't matter."""
    hundredths = F.sum(F.round(F.col("confidence") * 100).cast("bigint"))
    return formulas.groupBy("type").agg((hundredths.cast("double") / (F.count("*") * 100)).alias("mean_confidence"), F.count("*").alias("formulas"))
