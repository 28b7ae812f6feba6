import random
from hashlib import sha256
from zlib import crc32

import duckdb
import pandas as pd
import pytest

from tallysheet.llm import merkle
from tests.llm.conftest import ODD


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def plain_leaf(*values):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(nodes):
    """Levels of a tree, the root's last."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][k : k + 8]) for k in range(0, len(levels[-1]), 8)])
    return levels


def steps(levels, place):
    out = []
    for level in levels[:-1]:
        run = level[place // 8 * 8 : place // 8 * 8 + 8]
        out.append((place % 8, [*run[: place % 8], *run[place % 8 + 1 :]]))
        place //= 8
    return out


def lower(text):
    return text.translate({k: k + 32 for k in range(65, 91)})


def brute(rows):
    """Sorted rows of the contract for (doc_id, text, lang, source)."""
    groups = {}
    for i, text, lang, source in rows:
        own = plain_leaf(i, source, lang, 0, text)
        hit = i is not None and crc32(str(i).encode()) % 3 == 0 and text is not None
        groups.setdefault(lang, []).append((i is None, i or 0, own, plain_leaf(i, source, lang, 0, lower(text)) if hit else own))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: (sorted(rows), tree([r[2] for r in sorted(rows)])) for g, rows in groups.items()}
    over, out = tree([trees[g][1][-1][0] for g in order]), []
    for k, g in enumerate(order):
        own, levels = trees[g]
        for place, (none, i, leaf, tampered) in enumerate(own):
            path = steps(levels, place) + steps(over, k)
            folded = merkle.fold(tampered, path)
            out.append((None if none else i, leaf, levels[-1][0], over[-1][0], h(*(d for _, o in path for d in o)), folded, folded == over[-1][0]))
    return sorted(out, key=str)


def four(rows):
    return [(r[0], r[1], r[2] if len(r) > 2 else None, r[3] if len(r) > 3 else None) for r in rows]


@pytest.mark.parametrize("n", [1, 8, 9, 65])
def test_small_trees(spark, make_docs, n):
    rows = [(k, f"Text {k % 5}", None if k % 9 == 8 else "de") for k in range(n)]
    assert sorted((tuple(r) for r in merkle.audited(make_docs(rows)).collect()), key=str) == brute(four(rows))


def test_odd_rows_and_a_hot_group(spark, make_docs):
    rnd = random.Random(3)
    rows = [(rnd.randrange(10**6), rnd.choice(["A b", "x", None, "ÀÉ Z"]), rnd.choice(["en"] * 6 + ["", "é", "zz", None]), "s") for _ in range(5000)] + ODD
    got = merkle.audited(make_docs(rows))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(four(rows))


def test_many_groups(spark, make_docs):
    rows = [(k, "t", f"g{k % 83}") for k in range(300)]
    assert sorted((tuple(r) for r in merkle.audited(make_docs(rows)).collect()), key=str) == brute(four(rows))


@pytest.mark.parametrize("last", [1, 8, 70, 513])
def test_short_last_chunk(spark, make_docs, last):
    rows = [(k, f"Text {k}", "de") for k in range(merkle.CHUNK + last)] + [(-1, "A", "en")]
    assert sorted((tuple(r) for r in merkle.audited(make_docs(rows)).collect()), key=str) == brute(four(rows))


def test_whole_proofs(spark, make_docs):
    for r in merkle.proofs(make_docs([(k, f"Text {k}", "de" if k % 3 else "en") for k in range(100)])).collect():
        assert merkle.fold(r.leaf, [(p.place, p.others) for p in r.proof]) == r.root


def test_against_sql(spark, make_docs):
    rows = [(k, None if k % 11 == 0 else f"Text É {k % 5}", [None, "de", "en", "en"][k % 4], None if k % 7 == 0 else "s") for k in range(700)]
    documents = pd.DataFrame([(*r, 0) for r in rows], columns=["doc_id", "text", "lang", "source", "n_chars"])  # noqa: F841  read by name
    want = duckdb.sql(merkle.MERKLE_SQL).fetchall()
    assert sorted(want, key=str) == sorted((tuple(r) for r in merkle.audited(make_docs(rows)).collect()), key=str)


def test_empty_table(spark, make_docs):
    assert merkle.audited(make_docs([])).count() == 0
