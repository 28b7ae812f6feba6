import re

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallysheet.llm import mixing
from tests.llm.conftest import ODD


def fill(sizes, weights, most=3.0):
    """Targets by plain clamping."""
    total, target, free = sum(sizes.values()), {}, set(sizes)
    while free:
        left, w = total - sum(target.values()), sum(weights[s] for s in free)
        over = {s for s in free if left * weights[s] / w > most * sizes[s]}
        if not over:
            return target | {s: left * weights[s] / w for s in free}
        target |= {s: most * sizes[s] for s in over}
        free -= over
    return target


def documents(spark):
    n = lambda k: (k * 7919 % 200) + 1
    rows = [(k, "w " * n(k), None, ["big", "b", "tiny", None, "ä", "Z", "0"][0 if k % 3 else k % 7]) for k in range(3000)]
    return rows


def test_targets_and_shares(spark, make_docs):
    rows = documents(spark)
    got = mixing.plan(make_docs(rows)).collect()
    assert len(got) == len(rows)
    sizes, taken, target = {}, {}, {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
        assert r.taken <= 3 * r.size and r.taken == r.copies * r.size
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    want = fill(sizes, {s: k % 3 + 1 for k, s in enumerate(order)})
    assert target == pytest.approx(want) and sum(target.values()) == pytest.approx(sum(sizes.values()))
    assert all(abs(taken[s] - target[s]) <= 0.01 * target[s] + 200 for s in sizes)
    assert {r.doc_id: r.size for r in got} == {r[0]: len(re.findall(r"[^\x20\x09-\x0D]+", r[1])) for r in rows}


def test_reruns_agree_and_rows_repeat(spark, make_docs):
    docs = make_docs(documents(spark)[:500])
    a, b = ({r.doc_id: r.copies for r in mixing.plan(docs).collect()} for _ in range(2))
    assert a == b
    rows = mixing.mixed(docs)
    assert {r.doc_id: r["count"] for r in rows.groupBy("doc_id").count().collect()} == {i: c for i, c in a.items() if c}
    assert rows.columns == docs.columns


def test_water_fill_reclamps(spark):
    rows = [("a", 10, 100.0), ("b", 30, 50.0), ("c", 1000, 1.0), ("d", 100, 10.0)]
    got = {r.source: r.target for r in mixing.water_fill(spark.createDataFrame(rows, "source string, source_size long, weight double")).collect()}
    assert got == pytest.approx(fill({s: n for s, n, _ in rows}, {s: w for s, _, w in rows}))


def test_odd_rows(spark, make_docs):
    got = mixing.plan(make_docs(ODD)).collect()
    assert len(got) == len(ODD) and {r.doc_id: r.size for r in got}[1] == 0
    assert mixing.plan(make_docs([])).count() == 0 and mixing.mixed(make_docs([])).count() == 0
    assert mixing.plan(make_docs([(1, None), (2, " ")])).agg(F.sum("taken"), F.sum("target")).first() == (0, 0.0)


def test_ranks_are_global(spark):
    rows = spark.range(500).select(F.concat(F.lit("s"), F.col("id")).alias("source")).unionByName(spark.createDataFrame([(None,)], "source string"))
    got = {r.source: r["rank"] for r in mixing.ranked(rows, 7).collect()}
    names = sorted(s for s in got if s is not None)
    assert [got[s] for s in names] == list(range(500)) and got[None] == 500


def test_targets_against_sql(spark, make_docs):
    rows = documents(spark)
    documents_ = pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source"])  # noqa: F841  read by name
    want = duckdb.sql(mixing.TARGETS_SQL.replace("FROM documents", "FROM documents_")).fetchall()
    got = [(r.source, r.source_size, r.weight, round(r.target, 3)) for r in mixing.targets(make_docs(rows)).collect()]
    assert len(got) == 7 and sorted(map(str, got)) == sorted(map(str, want))
