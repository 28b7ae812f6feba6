import random
import re
from itertools import permutations

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallysheet.llm import filter_audit
from tests.llm.conftest import ODD

COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def fails(rows):
    """The set of failing filters of each (doc_id, text, lang, source), in plain words."""
    out = []
    for i, text, *_ in rows:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        found = set()
        if len(words) < 200:
            found.add("A")
        if 100 * len(set(words)) < 50 * len(words):
            found.add("B")
        if 100 * len(re.findall("[A-Z]", t)) > 2 * len(t):
            found.add("C")
        if re.search("[#$%&*|]", t):
            found.add("D")
        if any((j is None, j or 0) < (i is None, i or 0) and (u or "") == t for j, u, *_ in rows):
            found.add("E")
        out.append(found)
    return out


def brute(rows, labels):
    found, out = fails(rows), []
    for part in {r[3] or "" for r in rows}:
        own = [(f, labels.get(r[0], (0, 0))) for r, f in zip(rows, found, strict=True) if (r[3] or "") == part]
        table = []
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, letter in enumerate(order, 1):
                hit = [x for x in left if letter in x[0]]
                left = [x for x in left if letter not in x[0]]
                failing = sum(letter in f for f, _ in own)
                table.append([part, order, step, len(left), len(hit), failing - len(hit), sum(f == {letter} for f, _ in own), sum(x[1][0] == 1 for x in hit), sum(x[1][1] == 1 for x in hit)])
        out += [(*t, sum(u[4] for u in table if u[1][u[2] - 1] == t[1][t[2] - 1])) for t in table]
    return sorted(out)


def made(n=240):
    rnd = random.Random(5)
    rows = []
    for k in range(n):
        text = " ".join(rnd.choice("abcdefgh") + str(rnd.randrange(rnd.choice([5, 500]))) for _ in range(rnd.choice([150, 199, 200, 260])))
        text = text.upper() if k % 7 == 0 else text + rnd.choice(["", "", " #", " 100%"])
        rows.append((k, text if k % 5 or not rows else rnd.choice(rows)[1], None, ["s", "t", None, ""][k % 4]))
    return rows


def sets(spark, labels):
    return spark.createDataFrame([(i, q, t) for i, (q, t) in labels.items()] or [(None, 1, 1)], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("odd", [False, True])
def test_against_plain_loops(spark, make_docs, odd):
    rows = made() + ([(*r, None, "s") if len(r) == 2 else r for r in ODD + [(1, "again"), (99, None), (98, "x" * 300_000)]] if odd else [])
    labels = {k: (k % 2, int(k % 3 == 0)) for k in range(0, 240, 2)} | {98: (None, 1), 7: (1, None)}
    got = filter_audit.audit(make_docs(rows), sets(spark, labels))
    assert got.columns == COLUMNS
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, labels)


def test_against_sql(spark, make_docs):
    rows, said = made(120), {k: (k % 2, int(k % 3 == 0)) for k in range(0, 120, 2)}
    documents = pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source"])  # noqa: F841  read by name
    labels = pd.DataFrame([(i, *x) for i, x in said.items()], columns=["doc_id", "quality", "toxic"])  # noqa: F841
    assert sorted(duckdb.sql(filter_audit.AUDIT_SQL).fetchall()) == sorted(tuple(r) for r in filter_audit.audit(make_docs(rows), sets(spark, said)).collect())


def test_equal_hashes_do_not_make_copies(spark, make_docs, monkeypatch):
    """Whole texts decide: with block hashes that are all alike, texts of one length still differ."""
    docs = make_docs([(1, "abc"), (2, "abd"), (3, "abc"), (4, "xyz"), (5, "abcd")])
    none, number, digest = filter_audit.row_key()
    rows = docs.select(none.alias("none"), number.alias("id"), digest.alias("hash"), F.char_length("text").cast("long").alias("chars"), F.array(*[F.lit(0).cast("long")] * 4).alias("blocks"))
    assert [r.id for r in filter_audit.copies(docs, rows).collect()] == [3]


def test_blocks_cover_whole_texts():
    text = "é" * 20_000
    for at in (0, 63, 64, 1023, 1024, 16383, 16384, 19_999):
        other = text[:at] + "x" + text[at + 1 :]
        assert sum(a != b for a, b in zip(filter_audit.block_hashes(text), filter_audit.block_hashes(other), strict=True)) == 1


def test_words_over_chunks(monkeypatch):
    data = (b"ab c\x0bdef\n" * 50 + b"x" * 500) * 3
    want = filter_audit.word_counts(data)
    monkeypatch.setattr(filter_audit, "CHUNK", 7)
    assert filter_audit.word_counts(data) == want == (len(data.split()), len(set(data.split())))


def test_hot_copies(spark):
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, "same").otherwise(F.col("id").cast("string")).alias("text"), F.lit("s").alias("source"))
    got = filter_audit.audit(docs, sets(spark, {})).where("filter_order = 'EABCD' AND step = 1").collect()
    assert [(r.removed, r.kept, r.redundant) for r in got] == [(1332, 668, 0)]


def test_no_documents(spark, make_docs):
    assert filter_audit.audit(make_docs([]), sets(spark, {})).count() == 0
