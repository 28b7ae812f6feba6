import random
import re

import numpy as np
import xxhash

from tallysheet.llm import simhash
from tests.llm.conftest import ODD


def plain(text):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    if not w:
        return 0
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(prints, ids):
    n = len(prints)
    comp = list(range(n))
    for _ in range(n):
        for i in range(n):
            for j in range(n):
                if (prints[i] ^ prints[j]).bit_count() <= 3 and comp[j] > comp[i]:
                    comp[j] = comp[i]
    least = {}
    for c, i in zip(comp, ids, strict=True):
        least[c] = min(least.get(c, i), i)
    return [least[c] for c in comp]


def test_fingerprints():
    for _, t in ODD[:7] + ODD[9:]:
        assert simhash.fingerprint(t) == plain(t)
    assert simhash.fingerprint("É a B c") == simhash.fingerprint("É A b C")


def test_documents_against_brute_force(spark, make_docs):
    rnd = random.Random(3)
    words = [f"w{k}" for k in range(300)]
    texts = [[rnd.choice(words) for _ in range(rnd.randint(1, 80))] for _ in range(25)]
    for t in list(texts):
        for _ in range(3):
            copy = list(t)
            copy[rnd.randrange(len(copy))] = rnd.choice(words)
            texts.append(copy)
    rows = [(7 * k % 101, " ".join(t)) for k, t in enumerate(texts)] + [(200, None), (201, " "), (202, "")]
    got = {r.doc_id: r for r in simhash.near_duplicates(make_docs(rows), tile=8).collect()}
    prints = [plain(t) for _, t in rows]
    for (i, _), p, c in zip(rows, prints, groups(prints, [i for i, _ in rows]), strict=True):
        assert got[i].fingerprint == f"{p:016x}" and got[i].component_id == c
    assert got[202].component_id == 200


def test_tiles_find_every_close_pair():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 63, 700, dtype=np.uint64)
    b = a[:300] ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64))
    a, b = (x[np.lexsort(simhash.quarters(x).T)] for x in (a, b))
    label = simhash.tile_links(a, b)
    n = len(a)
    for i, j in zip(*np.nonzero(np.bitwise_count(a[:, None] ^ b[None, :]) <= 3), strict=True):
        assert label[i] == label[n + j]
    assert len(np.unique(label)) == 700


def test_odd_rows(spark, make_docs):
    got = simhash.near_duplicates(make_docs(ODD))
    assert got.count() == len(ODD) and got.where("doc_id IS NULL").first().component_id is None
    assert simhash.near_duplicates(make_docs([])).count() == 0
    kept = simhash.one_of_each(make_docs(ODD))
    assert {r.doc_id for r in kept.collect()} == {1, 4, 5, 7, 8, 9, None} and kept.columns == make_docs([]).columns


def test_repeated_ids_lose_no_text(spark, make_docs):
    """An id with several texts, copies under one id and under none: one row of each group stays, and no group goes."""
    a, b, c = ("one two three four five six", "red green blue black white grey", "sun moon star sky cloud rain")
    docs = make_docs([(5, a), (5, b), (3, a), (5, b), (None, c), (None, c), (None, a)])
    assert sorted((r.doc_id or -1, r.text) for r in simhash.one_of_each(docs).collect()) == [(-1, c), (3, a), (5, b)]
    got = simhash.near_duplicates(docs).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in got) == [(-1, -1), (-1, -1), (-1, 3), (3, 3), (5, 3), (5, 5), (5, 5)]
