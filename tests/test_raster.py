import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallysheet.operators import plugins, raster
from tallysheet.plans import catalog
from tallysheet.sources import files, synthetic
from tallysheet.sources import relations as R

RNG = np.random.default_rng(1)
PICTURES = {k: RNG.integers(0, 256, shape) for k, shape in enumerate([(8, 8), (1, 5), (6, 1), (3, 4), (20, 30)])} | {9: np.full((4, 4), 7)}


@pytest.fixture(scope="module")
def images(spark):
    return files.in_memory(spark, [(k, p.tolist()) for k, p in PICTURES.items()])


def laplace_variance(p):
    wide = np.pad(p, [(1, 1) if n > 1 else (1, 1) for n in p.shape], mode="reflect") if min(p.shape) > 1 else np.pad(np.pad(p, ((1, 1) if p.shape[0] > 1 else (0, 0), (1, 1) if p.shape[1] > 1 else (0, 0)), mode="reflect"), ((0, 0) if p.shape[0] > 1 else (1, 1), (0, 0) if p.shape[1] > 1 else (1, 1)), mode="edge")
    return (wide[:-2, 1:-1] + wide[2:, 1:-1] + wide[1:-1, :-2] + wide[1:-1, 2:] - 4 * p).var()


def test_measures(images):
    for r in raster.measures(images).collect():
        p = PICTURES[r.image_id].astype(float)
        assert np.allclose((r.brightness, r.contrast, r.sharpness), (p.mean(), p.std(), laplace_variance(p)))


def test_adjusted(images):
    for r in images.select("image_id", raster.adjusted(F.col("pixels")).alias("p")).collect():
        p = PICTURES[r.image_id].astype(float)
        m, s = p.mean(), p.std()
        x = np.clip(p + (128 - m if abs(128 - m) > 10 else 0), 0, 255)
        if 0 < s < 50:
            x = np.clip((x - 128) * min(2, 50 / s) + 128, 0, 255)
        assert np.abs(np.trunc(x).ravel() - r.p).max() <= 1


def test_quality_plan_and_steps(images):
    plan = {r.image_id: r for r in raster.analysed(images).collect()}
    assert plan[9].steps.split(",")[:2] == ["brightness_correction", "contrast_enhancement"] and plan[9].enhancements_needed.startswith("brighten,")
    assert {r.image_id: r.overall_score for r in raster.basic_quality(raster.measures(images)).collect()}[9] == 0
    out = {r.image_id: r for r in raster.apply_steps(images.withColumn("steps", F.lit("sharpening,nonsense,denoising"))).collect()}
    assert out[4].applied == "sharpening,denoising" and (out[4].height, out[4].width) == (20, 30) and len(out[4].pixels) == 600


def test_otsu_and_skew(spark, images):
    two = files.in_memory(spark, [(1, [[10, 10, 200, 200]])])
    assert raster.otsu(two).first().threshold == 10
    rows = [(1, 50.0, 80.0, 10000.0), (1, 40.0, -80.0, 10000.0), (1, 30.0, 2.0, 10000.0), (1, 1.0, 44.0, 10000.0), (2, 50.0, 0.1, 10000.0)]
    got = {r.image_id: (r.angle, r.rotate, r.step) for r in raster.dominant_angle(spark.createDataFrame(rows, "image_id long, area double, angle double, image_area double")).collect()}
    assert got[1] == (2.0, True, "deskew_2.00deg") and got[2] == (0.1, False, None)


def test_sizes_and_structure(spark, images):
    r = spark.range(1).select(raster.fitted_size(F.lit(3000), F.lit(900)), raster.fitted_size(F.lit(900), F.lit(900)), raster.upscaled_size(F.lit(400), F.lit(300)), raster.upscaled_size(F.lit(1300), F.lit(900))).first()
    assert [tuple(x) for x in r] == [(2000, 600), (900, 900), (1200, 900), (1300, 900)]
    assert {r.image_id: r.has_complex_structure for r in raster.math_structure(images).collect()}[1]


def test_engines(spark, images):
    reg = plugins.Registry()
    reg.register("mean", lambda x: (f"m{int(x.mean())}", 0.95 if x.mean() > 100 else 0.5), 1, handwriting=True)
    reg.register("broken", lambda x: 1 / 0, 2)
    reg.register("absent", lambda x: ("", 0.0), 3, needs=("no_such_package_here",))
    assert reg.available() == ["mean", "broken"] and reg.describe("mean")["handwriting"] and reg.describe("?") == {}
    assert reg.self_test()["mean"] == "ok" and "zero" in reg.self_test()["broken"]
    rows = reg.recognise(images).collect()
    assert len(rows) == 2 * len(PICTURES) and all(r.error_message for r in rows if r.engine_name == "broken")
    seen = plugins.cascade(reg, images, ["mean", "broken"]).collect()
    sure = {r.image_id for r in seen if r.engine_name == "mean" and r.confidence >= 0.9}
    assert {r.image_id for r in seen if r.engine_name == "broken"} == set(PICTURES) - sure
    assert {r.engine_name: r.enabled for r in reg.frame(spark).collect()} == {"mean": True, "broken": True, "absent": False}


def test_files(spark, tmp_path):
    (tmp_path / "a.PNG").write_bytes(b"x")
    (tmp_path / "b.txt").write_bytes(b"y")
    good, bad = files.checked(files.scan(spark, str(tmp_path)))
    assert [r.path.rsplit("/", 1)[1] for r in good.collect()] == ["a.PNG"] and bad.first().error == "unsupported suffix .txt"
    codes = good.select("path").withColumn("data", F.lit("d"))
    r = files.with_source(codes, files.scan(spark, str(tmp_path))).first()
    assert r.source_file.endswith("a.PNG") and r.extraction_timestamp > 1e9
    files.write(synthetic.pages(spark, 3, noise=5), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def plain_upscaled(p, h, w):
    """Cubic convolution, pixel by pixel."""

    def weight(d):
        d = abs(d)
        return 1.25 * d**3 - 2.25 * d**2 + 1 if d <= 1 else -0.75 * (d**3 - 5 * d**2 + 8 * d - 4) if d < 2 else 0.0

    out = np.zeros((h, w))
    for i in range(h):
        for j in range(w):
            y, x = (i + 0.5) * p.shape[0] / h - 0.5, (j + 0.5) * p.shape[1] / w - 0.5
            for a in range(int(np.floor(y)) - 1, int(np.floor(y)) + 3):
                for b in range(int(np.floor(x)) - 1, int(np.floor(x)) + 3):
                    out[i, j] += p[min(max(a, 0), p.shape[0] - 1), min(max(b, 0), p.shape[1] - 1)] * weight(y - a) * weight(x - b)
    return np.clip(np.rint(out), 0, 255)


def plain_bilateral(p, far=4, spread=75.0):
    h, w = p.shape
    out = np.zeros((h, w))
    turn = lambda k, n: 0 if n == 1 else [*range(n), *range(n - 2, 0, -1)][k % (2 * n - 2)]
    for i in range(h):
        for j in range(w):
            near = [(p[turn(i + a, h), turn(j + b, w)] if min(h, w) > 1 else p[min(max(i + a, 0), h - 1), min(max(j + b, 0), w - 1)], a * a + b * b) for a in range(-far, far + 1) for b in range(-far, far + 1) if a * a + b * b <= far * far]
            weights = [np.exp(-(gap + (v - p[i, j]) ** 2) / (2 * spread**2)) for v, gap in near]
            out[i, j] = np.dot(weights, [v for v, _ in near]) / sum(weights)
    return out


def test_bilateral_and_last_scaling():
    for p in PICTURES.values():
        assert np.abs(raster.bilateral(p) - plain_bilateral(p)).max() < 1e-5
    assert raster.widened(PICTURES[4], 45).shape == (30, 45) and raster.widened(PICTURES[4], 30) is PICTURES[4]
    assert raster.fitted(PICTURES[4], 7).shape == (4, 7) and raster.fitted(PICTURES[4]) is PICTURES[4]
    assert (raster.gaussian_threshold(PICTURES[9]) == 255).all()


def test_the_last_scaling_reaches_the_width(spark):
    two = files.in_memory(spark, [(1, RNG.integers(0, 256, (20, 700)).tolist()), (2, RNG.integers(0, 256, (3, 1300)).tolist())])
    got = {r.image_id: r for r in raster.processed_for_recognition(two).collect()}
    assert all(r.applied.endswith("binarise,widening") and r.width >= 1200 and len(r.pixels) == r.height * r.width for r in got.values())
    assert all(abs(r.improvement - (r.score_after - r.score_before)) < 1e-9 for r in got.values())


def test_images_without_pixels(spark):
    none = spark.createDataFrame([(1, 0, 0, []), (2, 2, 2, [0, 9, 90, 200])], "image_id long, height int, width int, pixels array<int>")
    assert {r.image_id: (r.noise_level is None, r.edge_density is None) for r in raster.analysed(none).collect()} == {1: (True, True), 2: (False, False)}
    every = raster.apply_steps(none.withColumn("steps", F.lit(",".join(k for k in raster.STEPS if k != "widening")))).collect()
    assert {r.image_id: len(r.pixels) == r.height * r.width for r in every} == {1: True, 2: True}


def test_chains_apply_every_step(images):
    got = raster.prepared(images).collect()
    assert len(got) == len(PICTURES) * len(raster.CHAINS)
    for r in got:
        x = PICTURES[r.image_id]
        assert r.applied == raster.CHAINS[r.chain]
        for step in r.applied.split(","):
            x = np.clip(np.rint(raster.STEPS[step](x)), 0, 255).astype(int)
        assert (r.height, r.width) == x.shape and (np.array(r.pixels).reshape(x.shape) == x).all()


def test_upscaling(images):
    for r in raster.apply_steps(images.where("image_id IN (0, 3, 9)").withColumn("steps", F.lit("upscaling"))).collect():
        p = PICTURES[r.image_id]
        h, w = (3 * n for n in p.shape)
        assert (r.applied, r.height, r.width) == ("upscaling", h, w)
        assert np.abs(np.array(r.pixels).reshape(h, w) - plain_upscaled(p, h, w)).max() <= 1


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no driver tables here")
def test_the_query_applies_the_whole_plan(spark):
    d = "/root/testdata/sf0.001"
    plan = {r.image_id: r.steps for r in catalog.QUERIES["i5_i6_o4_quality_and_plan"](spark, d).collect()}
    pictures = {r.image_id: np.array(r.pixels).reshape(r.height, r.width) for r in R.rasters(spark, d).collect()}
    got = catalog.QUERIES["i7_i18_enhanced"](spark, d).collect()
    assert len(got) == len(plan) == len(pictures)
    for r in got:
        assert r.applied == plan[r.image_id] + ",close,open,gaussian_threshold,binarise" and "upscaling" in r.applied and (r.height, r.width) == (24, 24)
        x = pictures[r.image_id]
        for step in r.applied.split(","):
            x = plain_upscaled(x, 24, 24) if step == "upscaling" else np.clip(np.rint(raster.STEPS[step](x.astype(int))), 0, 255)
        assert abs(r.brightness - x.mean()) < 0.5 and abs(r.contrast - x.std()) < 0.5


def test_patch_sums_are_exact_for_whole_greys():
    rnd = np.random.default_rng(8)
    for n in (1, 2, 3, 5, 7):
        x = rnd.integers(0, 65026, (4, 20, 9)).astype(np.int32)
        assert (raster._run_sums(x, n) == np.lib.stride_tricks.sliding_window_view(x, n, axis=1).sum(axis=-1)).all()


def test_batches_of_steps_are_small(spark):
    bound = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(bound)
    images = spark.createDataFrame([(1, 1, 1, [5])], "image_id long, height int, width int, pixels array<int>").withColumn("steps", F.lit("double"))
    try:
        for given, kept in (("10000", str(raster.BATCH)), ("0", str(raster.BATCH)), ("100", "100")):
            spark.conf.set(bound, given)
            assert raster.apply_steps(images).count() == 1 and spark.conf.get(bound) == kept
    finally:
        spark.conf.set(bound, before)


def plain_measures(p):
    """Of a whole image, by the plain steps."""
    x = np.pad(p, 1, mode="reflect")
    bend = x[:-2, 1:-1] + x[2:, 1:-1] + x[1:-1, :-2] + x[1:-1, 2:] - 4 * p
    return p.mean(), p.std(), bend.var(), np.abs(p - raster.median_filter(p)).mean(), raster.edges(p).mean()


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no driver tables here")
def test_the_query_scales_to_the_recognisers_width(spark):
    d = "/root/testdata/sf0.001"
    pictures = {r.image_id: np.array(r.pixels).reshape(r.height, r.width) for r in R.rasters(spark, d).collect()}
    got = catalog.QUERIES["i7_i18_enhanced"](spark, d).collect()
    assert {r.image_id for r in got} == set(pictures)
    assert all((r.final_height, r.final_width, r.final_applied) == (1200, 1200, r.applied + ",widening") for r in got)
    for r in got[::250]:
        x = pictures[r.image_id]
        for step in r.final_applied.split(","):
            x = np.clip(np.rint(raster.STEPS[step](x)), 0, 255).astype(int)
        want = plain_measures(x)
        assert x.shape == (1200, 1200) and np.allclose([r[f"final_{m}"] for m in raster.MEASURES], want, atol=2e-6)
        brightness, contrast, sharpness, noise, edge = want
        assert 80 <= brightness <= 200 and contrast >= 30 and edge == 0
        score = (100 + 100 + sharpness / 50 * 100 + 100 - noise / 15 * 100 + 100 + 60) / 6
        assert abs(r.score_after - score) < 2e-6 and abs(r.improvement - (score - r.score_before)) < 4e-6 and r.recommended


def test_places_that_are_alike_give_the_measures_of_the_whole_image():
    for shape in ((24, 24), (3, 24), (1, 24), (7, 100), (5, 200), (24, 25), (2, 7), (1, 1)):
        images = [255 * RNG.integers(0, 2, shape) for _ in range(3)] + [RNG.integers(0, 256, shape)]
        for x, got in zip(images, raster.measured_widened(images), strict=True):
            y = raster.greyed(raster.widened(x))
            assert got[:2] == y.shape and np.allclose(got[2:], raster.measured(y), rtol=1e-12, atol=0)
    assert raster.measured_widened([np.zeros((0, 0), int)]) == [(0, 0, *[None] * 5)]


def test_measures_of_whole_images():
    for p in [*PICTURES.values(), np.cumsum(RNG.integers(0, 3, (40, 50)), axis=1), 400 * RNG.integers(-1, 2, (9, 9))]:
        assert np.allclose(raster.measured(p), plain_measures(p))
    none = raster.measured(np.zeros((0, 3), int))
    assert none == (None,) * 5


def test_small_and_whole_images_agree_through_the_operator(spark):
    two = files.in_memory(spark, [(1, RNG.integers(0, 256, (8, 8)).tolist()), (2, RNG.integers(0, 256, (3, 5)).tolist())])
    columns = ["image_id", "height", "width", "applied", "unscaled", *raster.MEASURES, "score_before", "score_after"]
    whole = raster.processed_for_recognition(two)
    assert "pixels" in whole.columns and "pixels" not in raster.processed_for_recognition(two, pixels=False).columns
    a, b = ({r.image_id: r for r in x.select(columns).collect()} for x in (whole, raster.processed_for_recognition(two, pixels=False)))
    for k in (1, 2):
        assert a[k][1:5] == b[k][1:5] and np.allclose(a[k][5:], b[k][5:], rtol=1e-9) and a[k].width == 1200
    none = spark.createDataFrame([(1, 0, 0, [])], "image_id long, height int, width int, pixels array<int>")
    assert [(r.height, r.width, "widening" in r.applied, r.brightness) for r in raster.processed_for_recognition(none, pixels=False).collect()] == [(0, 0, False, None)]


def test_the_plans_steps_are_those_of_the_method():
    flat, dot = np.full((20, 20), 100), np.full((20, 20), 100)
    dot[10, 10] = 103
    assert (raster.sharpen(flat) == 100).all()
    assert raster.edges(dot).mean() < 0.05 and raster.sharpen(dot)[9:12, 9:12].tolist() == [[97, 97, 97], [97, 127, 97], [97, 97, 97]]
    few, many = np.full((20, 20), 100), np.where(np.arange(20) // 5 % 2, 200, 0)[None].repeat(20, axis=0)
    few[:, 10:] = 200
    assert 0.05 <= raster.edges(few).mean() < 0.15 <= raster.edges(many).mean()
    for p, side in ((few, -1.0), (many, -0.5)):
        x = np.pad(p, 1, mode="reflect")
        assert np.allclose(raster.sharpen(p), (1 - 4 * side) * p + side * (x[:-2, 1:-1] + x[2:, 1:-1] + x[1:-1, :-2] + x[1:-1, 2:]))
    p = RNG.integers(10, 41, (8, 8))
    moved = np.trunc(np.clip(p + (128 - p.mean()), 0, 255))
    assert p.std() < 50 and (raster.STEPS["brightness_correction"](p) == np.trunc(np.clip((moved - 128) * min(2, 50 / p.std()) + 128, 0, 255))).all()
    assert (raster.STEPS["brightness_correction"](np.full((4, 4), 7)) == 128).all()
