import math

import numpy as np
import pytest

from tallysheet.llm import embedding_dedup

SHAPE = "vec_id long, embedding array<float>, label int, n string, lead string, size string, block string, node string"


def brute(rows, cosine):
    """Links and groups by comparing all pairs of a label."""
    fit = {i: (label, np.asarray(v, np.float32).astype(float)) for i, v, label in rows if label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    group = {i: i for i, _, _ in rows}
    links = dict.fromkeys(group, 0)
    find = lambda i: i if group[i] == i else find(group[i])
    for i, (label, a) in fit.items():
        for j, (other, b) in fit.items():
            if i < j and label == other and len(a) == len(b) and a @ b / math.sqrt((a @ a) * (b @ b)) >= cosine:
                links[i] += 1
                links[j] += 1
                low, high = sorted((find(i), find(j)))
                group[high] = low
    return {i: (links[i], find(i)) for i in group}


def vectors(n, size=12, seed=0):
    """Clusters, chains, copies and single vectors under three labels and none."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        base = np.random.default_rng(i % 23).normal(size=size)
        v = base if i % 5 == 0 else base + rng.normal(size=size) * rng.choice([0.02, 0.1, 0.2, 1.0])
        rows.append((i, [float(x) for x in np.float32(v * rng.choice([1.0, 3.0]))], [0, 1, 1, None][i % 4]))
    return rows


@pytest.mark.parametrize("block", [16, 4096])
def test_same_links_as_all_pairs(spark, block):
    rows = vectors(500)
    frame = spark.createDataFrame([(*r, *[None] * 5) for r in rows], SHAPE)
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(frame, 0.98, block).collect()}
    assert got == brute(rows, 0.98)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, None, 0), (2, [], 0), (3, [0.0, 0.0], 0), (4, [1.0, None], 0), (5, [1.0, nan], 0), (6, [inf, 1.0], 0), (7, [1.0, 1.0], None), (8, [1.0, 1.0], None),
        (9, [1.0, 1.0], 0), (10, [1.0, 1.0], 0), (11, [2.0, 2.0], 0), (12, [1.0, 1.0, 0.0], 0), (13, [1.0, 1.0], 1), (14, [1e-30, 1e-30], 1), (15, [0.0, 1.0], 0), (16, [-0.0, 1.0], 0),
    ]
    frame = spark.createDataFrame([(*r, *[None] * 5) for r in rows] + [(None, [1.0, 1.0], 0, *[None] * 5)], SHAPE)
    got = embedding_dedup.near_duplicates(frame).collect()
    assert len(got) == len(rows) + 1
    assert {r.vec_id: (r.n_links, r.component_id) for r in got if r.vec_id is not None} == brute(rows, 0.98)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got if r.vec_id is not None)
    assert [(r.n_links, r.component_id) for r in got if r.vec_id is None] == [(0, None)]
    assert embedding_dedup.near_duplicates(frame.limit(0)).count() == 0


def test_distant_parts_are_skipped_and_none_is_lost():
    rng = np.random.default_rng(2)
    at = np.sort(rng.uniform(0, 50, (2000, 1)), axis=0) * np.array([[1.0, 0, 0, 0, 0, 0]])
    met = np.zeros((2000, 2000), bool)
    for i, j in embedding_dedup.near_parts(at, at, 0.2, True):
        assert not met[i, j].any()
        met[i, j] = True
    close = np.abs(at[:, :1] - at[:, 0]) <= 0.2
    assert met[np.triu(close)].all() and met.sum() < 0.5 * met.size


def test_double_vectors_are_compared_in_double_precision(spark):
    """A cosine that is at the threshold in double precision, and below it once the components are cut to floats."""
    angle = math.acos(0.98)
    rows = [(1, [1.0, 0.0], 0), (2, [math.cos(angle - 1e-10), math.sin(angle - 1e-10)], 0), (3, [math.cos(angle + 1e-10), -math.sin(angle + 1e-10)], 0)]
    got = {r.vec_id: r.n_links for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {1: 1, 2: 1, 3: 0}
