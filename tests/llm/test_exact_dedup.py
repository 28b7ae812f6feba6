import hashlib
import os
import re

import duckdb
import pandas as pd
from pyspark.sql import functions as F

from tallysheet.llm.exact_dedup import DEDUP_SQL, DigestIndex
from tests.llm.conftest import ODD


def brute(rows):
    groups = {}
    for k, (i, t) in enumerate(rows):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i is None, i, k))
    out = []
    for text, members in groups.items():
        best = min(members, key=lambda m: (m[0], m[1], m[2] or 0))
        out += [(m[2], best[2], len(members), hashlib.sha256(text.encode()).hexdigest()) for m in members]
    return sorted(map(str, out))


def test_groups(spark, make_docs):
    got = DigestIndex(spark).classify(make_docs(ODD)).collect()
    assert sorted(str((r.doc_id, r.keep_id, r.group_size, r.text_sha256)) for r in got) == brute(ODD)
    assert sum(r.kept for r in got) == len({r.text_sha256 for r in got})


def test_ties_and_longest(spark, make_docs):
    got = {r.doc_id: r for r in DigestIndex(spark).classify(make_docs([(5, "a b"), (3, "ab "), (9, "a  b"), (2, " ab")])).collect()}
    assert {r.keep_id for r in got.values()} == {9} and got[9].kept and not got[2].kept and got[2].group_size == 4


def test_batches_and_reopening(spark, make_docs, tmp_path):
    path = str(tmp_path / "index")
    first = DigestIndex(spark, "idx_a", path, buckets=3)
    assert first.deduplicate(make_docs([(1, "a"), (2, "a "), (3, "b")])).count() == 2
    spark.sql("DROP TABLE idx_a")  # an external table: its files stay
    again = DigestIndex(spark, "idx_b", path, buckets=3)
    kept = again.deduplicate(make_docs([(4, "a"), (5, "c"), (6, "c")]))
    assert [r.doc_id for r in kept.collect()] == [5] and kept.columns == make_docs([]).columns
    assert again.rows().count() == 3


def test_repeated_rows_keep_one(spark, make_docs):
    rows = DigestIndex(spark).deduplicate(make_docs(ODD))
    # Blank 3 is longer than null and empty; 10 is longer than 5, of the same text; 6 stands twice.
    assert sorted(r.doc_id or -1 for r in rows.collect()) == [-1, 3, 4, 6, 7, 8, 9, 10]


def test_a_batch_run_again_keeps_its_rows(spark, make_docs, tmp_path):
    index = DigestIndex(spark, "idx_again", str(tmp_path / "index"), buckets=2)
    assert index.deduplicate(make_docs([(1, "a"), (2, "b")]), batch="monday").count() == 2
    rows = make_docs([(3, "b"), (4, "c"), (5, "c "), (5, "c ")])
    for _ in range(2):  # as after a job that died when the batch was already in the index
        assert [(r.doc_id, r.text) for r in index.deduplicate(rows, batch="tuesday").collect()] == [(5, "c ")]
    assert index.deduplicate(rows, batch="wednesday").count() == 0
    files = lambda: len(list((tmp_path / "index").glob("*.parquet")))
    index.deduplicate(make_docs([(k, f"more {k}") for k in range(20)]))
    before = files()
    index.compact()
    assert files() <= 2 < before and index.rows().count() == 23
    assert index.deduplicate(make_docs([(9, "a"), (8, "d")])).count() == 1


def test_clashing_names_come_back_as_they_were(spark):
    docs = spark.createDataFrame([(1, "a", 8, "x"), (2, "a", 9, "y")], "doc_id long, text string, id long, hash string")
    assert [tuple(r) for r in DigestIndex(spark).deduplicate(docs).collect()] == [(1, "a", 8, "x")]


def test_the_index_lies_among_the_shared_files(spark, make_docs):
    """Not in the warehouse, which may be a folder of the driver's machine."""
    index = DigestIndex(spark)
    index.classify(make_docs([(1, "a"), (2, "b")]))
    files = index.rows().inputFiles()
    assert files and all(f.startswith(spark.conf.get("spark.checkpoint.dir").replace("file://", "file:///").replace("////", "///")) for f in files)
    folder = index.path.removeprefix("file://")
    assert os.path.isdir(folder)
    index.drop()
    assert not os.path.exists(folder) and not os.listdir(spark.conf.get("spark.sql.warehouse.dir").removeprefix("file:") or ".")


def test_empty_table(spark, make_docs):
    assert DigestIndex(spark).classify(make_docs([])).count() == 0
    assert DigestIndex(spark).deduplicate(make_docs([])).count() == 0


def test_against_sql(spark, make_docs):
    rows = [(i, f"t {i % 7}" + " " * (i % 3)) for i in range(60)]
    documents = pd.DataFrame(rows, columns=["doc_id", "text"])  # noqa: F841  read by name
    want = duckdb.sql(DEDUP_SQL).df().sort_values("doc_id")
    got = DigestIndex(spark).classify(make_docs(rows)).toPandas().sort_values("doc_id")
    assert (got.values == want[got.columns].values).all()


def test_hot_group(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, "same").otherwise(F.col("id").cast("string")).alias("text"))
    assert DigestIndex(spark).classify(docs).where("kept").count() == 1001
