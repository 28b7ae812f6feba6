import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallysheet.operators import contours, raster
from tallysheet.sources import files

RNG = np.random.default_rng(5)


def spiral(n):
    """A dark path one pixel wide that winds inwards on a bright page."""
    p, r, c, d, steps = np.full((n, n), 255), 0, 0, 0, n - 1
    p[0, 0] = 0
    for k in range(2 * n - 1):
        for _ in range(max(0, steps)):
            r, c = r + (0, 1, 0, -1)[d], c + (1, 0, -1, 0)[d]
            p[r, c] = 0
        d = (d + 1) % 4
        steps -= 2 if k and k % 2 == 0 else 0
    return p


def bar(slope):
    """A dark bar across a bright page."""
    p = np.full((40, 60), 250)
    for x in range(5, 55):
        y = int(round(20 + slope * (x - 30)))
        p[y - 2 : y + 3, x] = 10
    return p


PICTURES = {0: np.full((3, 4), 9), 1: RNG.integers(0, 256, (8, 8)), 2: RNG.integers(0, 256, (12, 7)), 3: spiral(17), 4: bar(0.2), 5: np.array([[0]]), 6: RNG.integers(0, 2, (9, 30)) * 255, 7: np.array([[0, 255, 0, 255, 255]])}


@pytest.fixture(scope="module")
def images(spark):
    return files.in_memory(spark, [(k, p.tolist()) for k, p in PICTURES.items()]).repartition(4)


def objects(p, light):
    best, level = -1.0, None
    for g in sorted(set(p.ravel())):
        low, high = p[p <= g], p[p > g]
        between = round(len(low) * len(high) * (low.mean() - high.mean()) ** 2, 6) if len(high) else 0.0
        if between > best:
            best, level = between, g
    on = p > level
    on = ~on if on.mean() * 255 < 127 else on
    return on if light else ~on


def flood(on):
    """Regions of eight neighbours, found by flooding: least place to its places."""
    left, out = {(r, c) for r, c in zip(*np.nonzero(on), strict=True)}, {}
    while left:
        todo, seen = [left.pop()], []
        while todo:
            r, c = todo.pop()
            seen.append((r, c))
            for q in [(r + a, c + b) for a in (-1, 0, 1) for b in (-1, 0, 1)]:
                if q in left:
                    left.remove(q)
                    todo.append(q)
        out[min(r * on.shape[1] + c for r, c in seen)] = seen
    return out


def brute_rectangle(places):
    """The least area over all lines through two pixels that leave every pixel on one side."""
    points, best = [(c, r) for r, c in places], None
    for ax, ay in points:
        for bx, by in points:
            dx, dy = bx - ax, by - ay
            if (dx or dy) and all(dx * (y - ay) - dy * (x - ax) >= 0 for x, y in points):
                on, off = [x * dx + y * dy for x, y in points], [y * dx - x * dy for x, y in points]
                angle = math.degrees(math.atan2(dy, dx)) % 90
                found = (round((max(on) - min(on)) * (max(off) - min(off)) / (dx * dx + dy * dy), 6), round(angle - 90 if angle > 45.000001 else angle, 6))
                best = found if best is None else min(best, found)
    return best or (0.0, 0.0)


@pytest.mark.parametrize("kind", ["light", "dark"])
def test_regions_and_rectangles(images, kind):
    got = {(r.image_id, r.region): r for r in contours.rectangles(images, kind).collect()}
    want = {(k, root): seen for k, p in PICTURES.items() for root, seen in flood(objects(p, kind == "light")).items()}
    assert got.keys() == want.keys()
    for key, seen in want.items():
        r = got[key]
        assert r.area == len(seen) and r.image_area == PICTURES[key[0]].size
        if len(seen) < 150:
            area, angle = brute_rectangle(seen)
            assert abs(r.rectangle_area - area) < 1e-5 and abs(r.angle - angle) < 1e-5


def test_a_winding_region_is_one(images):
    rows = contours.regions(images.where("image_id = 3"), "light").collect()  # more dark than bright, so it is turned round
    assert [r.area for r in rows] == [(PICTURES[3] == 0).sum()]


def test_skew_of_a_bar(images):
    found = contours.rectangles(images.where("image_id = 4"), "dark")
    assert abs(raster.dominant_angle(found).first().angle - math.degrees(math.atan(0.2))) < 1.5


def test_hull_leaves_out_points_on_sides(spark):
    points = [(0, 0), (0, 2), (0, 4), (1, 1), (2, 0), (2, 4), (3, 2), (4, 0), (4, 4), (2, 2)]
    df = spark.createDataFrame([(sorted(points),), ([(1, 1)],), ([(0, 0), (2, 2)],), ([(0, 0), (1, 1), (2, 2)],)], "p array<struct<x:bigint,y:bigint>>")
    got = [[tuple(x) for x in r.h] for r in df.select(contours.hull(F.col("p")).alias("h")).collect()]
    assert [sorted(h) for h in got] == [[(0, 0), (0, 4), (4, 0), (4, 4)], [(1, 1)], [(0, 0), (2, 2)], [(0, 0), (2, 2)]]


def test_no_pixels(spark):
    empty = spark.createDataFrame([(1, 0, 0, [])], "image_id long, height int, width int, pixels array<int>")
    assert contours.rectangles(empty).count() == 0 and raster.otsu(empty).first().threshold is None
