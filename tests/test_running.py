"""Running means call by call, and engines in waves."""

import glob
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallysheet.operators import plugins, running
from tallysheet.sources import files

DDL = "engine_name string, ts timestamp_ntz, event_id long, text string, confidence double, error_message string"


def made(n, engines, seed=1):
    rnd = random.Random(seed)
    stamp = lambda k: np.datetime64("2024-01-01T00:00:00") + np.timedelta64(int(k // 3), "s")  # noqa: E731  ties in time
    return [(rnd.choice(engines), stamp(k).item(), k, rnd.choice(["a", "a", " ", "", None]), rnd.choice([rnd.random(), rnd.random(), None]), rnd.choice([None, None, None, "failed"])) for k in rnd.sample(range(n), n)]


def plain(rows):
    """The fold, one call after the other."""
    state, out = {}, {}
    for engine, ts, k, text, confidence, error in sorted(rows, key=lambda r: (r[1], r[2])):
        n, mean = state.get(engine, (0, 0.0))
        if error is None:
            n += bool((text or "").strip())
            if n:
                mean = (mean * (n - 1) + (confidence or 0.0)) / n
        state[engine] = n, mean
        out[engine, k] = n, mean
    return out


@pytest.mark.parametrize("engines", [["one"], ["a", "b", "b", "b", "b", "c", None]])
def test_means_are_those_of_the_fold(spark, engines):
    rows = made(1500, engines)
    got = {(r.engine_name, r.event_id): (r.successful_calls, r.average_confidence) for r in running.running_means(spark.createDataFrame(rows, DDL)).collect()}
    want = plain(rows)
    assert got.keys() == want.keys()
    assert all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-9 for k in want)


def test_one_engine_is_spread_over_partitions(spark, monkeypatch):
    seen = []
    original = running.written
    monkeypatch.setattr(running, "written", lambda df, *a: seen.append(original(df, *a)) or seen[-1])
    running.running_means(spark.createDataFrame(made(2000, ["one"]), DDL))
    assert seen[0].select("part").distinct().count() == 4


def test_no_calls(spark):
    assert running.running_means(spark.createDataFrame([], DDL)).count() == 0


@pytest.fixture
def asked(spark, tmp_path):
    """A registry whose engines leave a file for each image that they see."""

    def engine(name, answer):
        def read(image):
            open(f"{tmp_path}/{name}-{int(image[0, 0])}-{random.random()}", "w").close()
            return answer(int(image[0, 0]))

        return read

    def second(k):
        if k == 5:
            raise ValueError("unreadable")
        return ("two", 0.95 if k % 2 else 0.1)

    reg = plugins.Registry()
    reg.register("first", engine("first", lambda k: ("one", 0.95) if k % 3 == 0 else (" ", 0.99)), 1)
    reg.register("second", engine("second", second), 2)
    reg.register("third", engine("third", lambda k: ("three", 0.2)), 3)
    images = files.in_memory(spark, [(k, [[k, 0]]) for k in range(12)]).repartition(3)
    return reg, images, lambda: sorted(p.rsplit("/", 1)[1].rsplit("-", 1)[0] for p in glob.glob(f"{tmp_path}/*-*-*"))


def test_each_image_meets_an_engine_once(asked, tmp_path):
    reg, images, seen = asked
    got = plugins.cascade(reg, images, ["first", "second", "third"], folder=f"file://{tmp_path}/waves")
    rows = [(r.engine_name, r.image_id) for r in got.collect()]
    got.count()
    second = [k for k in range(12) if k % 3]
    third = [k for k in second if k % 2 == 0 or k == 5]
    want = [f"first-{k}" for k in range(12)] + [f"second-{k}" for k in second] + [f"third-{k}" for k in third]
    assert sorted(f"{e}-{k}" for e, k in rows) == sorted(want) == seen()


def test_a_run_goes_on_after_its_last_whole_wave(asked, tmp_path):
    reg, images, seen = asked
    folder = f"file://{tmp_path}/waves"
    plugins.cascade(reg, images, ["first"], folder=folder)
    (tmp_path / "waves" / "wave-1").mkdir()
    (tmp_path / "waves" / "wave-1" / "part-0.parquet").write_bytes(b"half a file")  # a wave that died
    assert plugins.cascade(reg, images, ["first", "second"], folder=folder).where(F.col("engine_name") == "second").count() == 8
    assert [s for s in seen() if s.startswith("first")] == sorted(f"first-{k}" for k in range(12))


def test_no_engines_and_no_images(asked):
    reg, images, _ = asked
    assert plugins.cascade(reg, images, []).count() == 0
    assert plugins.cascade(reg, images.limit(0), ["first", "second"]).count() == 0
