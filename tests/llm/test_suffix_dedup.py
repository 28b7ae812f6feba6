import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallysheet.llm import suffix_dedup
from tests.llm.conftest import ODD


def plain(rows, match=50):
    """The bytes that stay and the number of removed runs, from all strings of ``match`` bytes."""
    key = lambda i: (i is None, i or 0)
    first, out = {}, []
    data = [(i, (t or "").encode()) for i, t, *_ in rows]
    for i, d in data:
        for k in range(len(d) - match + 1):
            first[d[k : k + match]] = min(first.get(d[k : k + match], key(i)), key(i))
    for i, d in data:
        gone = np.zeros(len(d) + 1, bool)
        for k in range(len(d) - match + 1):
            if first[d[k : k + match]] < key(i):
                gone[k : k + match] = True
        left = bytes(np.frombuffer(d, np.uint8)[~gone[:-1]])
        out.append((i, len(d), len(d) - len(left), int((gone[1:] < gone[:-1]).sum()), hashlib.sha256(left).hexdigest()))
    return sorted(out, key=str)


def found(spark, docs):
    return sorted((tuple(r) for r in suffix_dedup.removals(docs).collect()), key=str)


def prose(rnd, n, words=400):
    return " ".join(rnd.choice("ab") * rnd.randrange(1, 4) + str(rnd.randrange(words)) for _ in range(n))


def mixed(seed=1):
    """Own text, shared passages at odd places, near copies, copies, short periods, over and under 50 bytes."""
    rnd = random.Random(seed)
    shared = [prose(rnd, 30) for _ in range(4)] + ["x" * 80, "abcabcabc" * 12, "é漢" * 20, "q" * 49, "p" * 50]
    rows = []
    for k in rnd.sample(range(1000), 60):
        parts = [prose(rnd, rnd.randrange(1, 40), 10**6)]
        for _ in range(rnd.randrange(3)):
            s = rnd.choice(shared)
            cut = rnd.randrange(len(s) // 2)
            parts += [rnd.choice([s, s[cut:], s[: len(s) - cut]]), prose(rnd, rnd.randrange(6), 10**6)]
        rows.append((k, rnd.choice(["", " "]).join(parts)))
    return rows + [(1000 + k, rows[k % 5][1] + rnd.choice(["", "!"])) for k in range(12)] + [(3000, rows[0][1] * 3)]


def test_mixed_texts(spark, make_docs):
    rows = mixed()
    got = found(spark, make_docs(rows))
    assert got == plain(rows) and sum(r[2] for r in got) > 1000


def test_odd_texts(spark, make_docs):
    rows = ODD + [(6, "another text of the id six, which is long enough to count, sixty bytes"), (20, "y" * 300_050), (21, "x" * 60 + "|"), (None, ODD[7][1][:70]), (22, "and another text of the id six, which is long enough to count, sixty")]
    assert found(spark, make_docs(rows)) == plain(rows)


@pytest.mark.parametrize("small", [False, True])
def test_blocks_chunks_and_buckets(spark, make_docs, monkeypatch, small):
    """Texts cut into many parts and sorts into many blocks give the same; checked in this process, where the sizes can be set."""
    if small:
        for name, size in (("BLOCK", 700), ("CHUNK", 97), ("SORTED", 3000), ("SUFFIXES", 40)):
            monkeypatch.setattr(suffix_dedup, name, size)
    rows = mixed(2)
    import pyarrow as pa

    batches = [pa.record_batch([pa.array([i for i, _ in rows[a : a + 20]], pa.int64()), pa.array([7] * len(rows[a : a + 20]), pa.int32()), pa.array([t.encode() for _, t in rows[a : a + 20]], pa.binary())], ["id", "tag", "data"]) for a in range(0, len(rows), 20)]
    blobs = {}
    for batch in suffix_dedup.pieces(5)(iter(batches)):
        for bucket, blob in zip(batch["bucket"].to_pylist(), batch["blob"].to_pylist(), strict=True):
            blobs.setdefault(bucket, []).append(blob)
    assert set(blobs) <= set(range(5))
    at = {}
    for own in blobs.values():
        for ids, tags, spans in suffix_dedup.repeats(own):
            assert set(tags) == {7}
            for i, s in zip(ids, spans, strict=True):
                at.setdefault(i, []).append(s)
    got = []
    for i, t in rows:
        left, removed, runs = suffix_dedup.cut(t.encode(), np.array(at.get(i, []), np.int64))
        got.append((i, len(t.encode()), removed, runs, hashlib.sha256(left).hexdigest()))
    assert sorted(got, key=str) == plain(rows)


@pytest.mark.parametrize("text", [b"banana" * 30, b"a" * 200, bytes(range(256)), b"ab" * 90 + b"c"])
def test_suffixes_are_in_order(text, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SUFFIXES", 16)
    starts = np.arange(len(text) - 49)
    word = suffix_dedup.words(text + suffix_dedup.TAIL)
    order = np.concatenate(list(suffix_dedup.suffix_blocks(word, starts, len(text))))
    assert sorted(order) == list(starts)
    heads = [text[k : k + 50] for k in order]
    assert heads == sorted(heads)


def test_cover_has_every_difference():
    ahead = suffix_dedup.shifts()
    for i in range(13):
        for j in range(13):
            assert {(i + ahead[i, j]) % 13, (j + ahead[i, j]) % 13} <= set(suffix_dedup.RESIDUES)


def test_hashes_that_meet_do_no_harm(make_docs, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "content_hash", lambda word, start, length: np.zeros(len(start), np.uint64))
    rows = mixed(3)[:20]
    ids = np.array([i for i, _ in rows])
    seen = [(b, x) for b, x in suffix_dedup.filed([t.encode() for _, t in rows], ids, ids * 0, ids * 0, 3)]
    assert [b for b, _ in seen] == sorted({b for b, _ in seen})
    gone = sum(len(i) for _, x in seen for i, _, _ in suffix_dedup.repeats([x]))
    assert gone > 0


def test_hot_text(spark):
    text = " ".join(f"w{k * k % 997}" for k in range(60))
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.when(F.col("id") % 3 == 0, F.lit(text)).otherwise(F.lit("")), F.lit(" own "), F.col("id").cast("string")).alias("text"))
    got = suffix_dedup.removals(docs).where("n_removed > 0").collect()
    assert len(got) == 999 and {r.n_spans for r in got} == {1} and min(r.n_removed for r in got) >= len(text)


def test_kept_bytes_and_no_documents(spark, make_docs):
    assert suffix_dedup.removals(make_docs([])).count() == 0
    rows = {r.doc_id: bytes(r.kept) for r in suffix_dedup.without_repeats(make_docs([(1, "a" * 60), (2, "b" + "a" * 55 + "c")])).collect()}
    assert rows == {1: b"a" * 60, 2: b"bc"}
