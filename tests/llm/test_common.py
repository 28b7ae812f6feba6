import random

from pyspark.sql import functions as F

from tallysheet.llm.common import connected_components


def brute(edges):
    comp = {n: n for e in edges for n in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            m = min(comp[a], comp[b])
            changed |= comp[a] != m or comp[b] != m
            comp[a] = comp[b] = m
    return comp


def test_components(spark):
    rnd = random.Random(2)
    edges = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(120)] + [(k, k + 1) for k in range(300, 360)] + [(500, k) for k in range(501, 560)] + [(7, 7)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {n: c for n, c in brute([e for e in edges if e[0] != e[1]]).items()}
    assert got == want


def test_no_edges(spark):
    assert connected_components(spark.range(0).select(F.col("id").alias("a"), F.col("id").alias("b"))).count() == 0
