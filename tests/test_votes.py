import itertools

import pytest
from pyspark.sql import functions as F

from tallysheet.operators import votes

DDL = "image_id long, engine_name string, pos int, priority int, text string, confidence double, processing_time double, error_message string"
ROWS = [
    (1, "a", 0, 1, "x = 1", 0.8, 2.0, None),
    (2, "a", 0, 1, "x", 0.6, 1.0, None), (2, "b", 1, 2, " y ", 0.7, 1.0, None), (2, "c", 2, 3, "x", 0.5, 4.0, None),
    (3, "b", 1, 2, "p", 0.5, 1.0, None), (3, "a", 0, 1, "q", 0.5, 1.0, None),
    (4, "a", 0, 1, " ", 0.9, 1.0, None), (4, "b", 1, 2, "", 0.1, 3.0, None),
    (5, "a", 0, 1, None, 0.0, 1.0, "boom"),
    (6, "a", 0, 1, "u", 0.0, 1.0, None), (6, "b", 1, 2, "v", 0.0, 1.0, None),
    (7, "a", 0, 1, "s", 0.3, 1.0, None), (7, "b", 1, 2, "t", 0.95, 1.0, None), (7, "c", 2, 3, "w", 0.99, 1.0, None),
]


@pytest.fixture(scope="module")
def results(spark):
    return spark.createDataFrame(ROWS, DDL)


@pytest.fixture(scope="module")
def images(results):
    return results.select("image_id").distinct()


def got(df, *columns):
    return {r["image_id"]: tuple(round(r[c], 6) if isinstance(r[c], float) else r[c] for c in columns) for r in df.collect()}


def test_highest_confidence_and_ties(results, images):
    out = got(votes.aggregate(results, images, "highest_confidence"), "text", "confidence", "method")
    assert out[3] == ("q", 0.5, "highest_confidence") and out[7][0] == "w" and out[4] == ("", 0.0, "no_results") and out[5][2] == "no_results"


def test_weighted_vote(results, images):
    out = got(votes.aggregate(results, images), "text", "confidence", "method")
    assert out[1] == ("x = 1", 0.8, "single_result")
    assert out[2] == (" y ", round((0.36 + 0.49 + 0.25) / 1.8, 6), "weighted_vote")
    assert out[6] == ("u", 0.0, "weighted_vote")


def test_consensus_and_first_success(results, images):
    out = got(votes.aggregate(results, images, "consensus"), "text", "confidence")
    assert out[2] == ("x", 0.75) and out[3][0] == "q"
    assert got(votes.aggregate(results, images, "nonsense"), "text")[2] == ("x",)


def test_early_exit(results):
    kept = {(r.image_id, r.engine_name) for r in votes.until_confident(results).collect()}
    assert (7, "b") in kept and (7, "c") not in kept and (4, "b") in kept


def test_quality(results, images):
    out = got(votes.quality(results, votes.aggregate(results, images)), "overall_quality", "engine_agreement", "processing_efficiency", "confidence_consistency", "successful_engines", "total_engines")
    assert out[5] == ("poor", 0.0, 0.0, 0.0, None, None)
    assert out[4] == ("poor", 0.0, round(1 - 2 / 60, 6), 0.6, 2, 2)
    assert out[1][0] == "excellent" and out[1][3] == 1.0 and out[2][1] == 0.5


def test_statistics_used_and_response(spark, results, images):
    engines = spark.createDataFrame([("a", True, 1, 30, 0), ("b", False, 2, 30, 1), ("z", True, None, 30, 2)], "engine_name string, enabled boolean, priority int, timeout int, config_pos int")
    stats = {r.engine_name: r for r in votes.engine_statistics(results, engines).collect()}
    assert stats["z"].total_calls == 0 and stats["z"].success_rate == 0 and stats["a"].total_calls == 7 and stats["a"].successful_calls == 5
    assert [r.engine_name for r in votes.enabled(engines).orderBy("engine_rank").collect()] == ["a", "z"]
    assert got(votes.engines_used(results), "engines_used", "engines_run")[4] == ("", "a,b")
    full = got(votes.responses(results, images), "final_text", "symbol_corrections_applied", "success")
    assert full[1] == ("x = 1", False, True) and full[5][2] is False


def test_empty_input(results, images):
    none = results.where("false")
    assert votes.aggregate(none, images).where(F.col("method") != "no_results").count() == 0
    assert votes.weighted_vote(none).count() == 0


def test_grade_is_the_same_in_any_order(spark):
    """Confidences whose weighted mean is 0.6, where sums in other orders end just below it or above."""
    orders = list(itertools.permutations((0.3, 0.38, 0.86, 0.1)))
    rows = [(k, "abcd"[i], i, i, "x", c, 1.0, None) for k, cs in enumerate(orders) for i, c in enumerate(cs)]
    results = spark.createDataFrame(rows, DDL).coalesce(1)
    mean = {r.confidence for r in votes.weighted_vote(results).collect()}
    assert len(mean) == 1 and abs(mean.pop() - 0.6) < 1e-12
    assert len({r.overall_quality for r in votes.quality(results, votes.weighted_vote(results)).collect()}) == 1
