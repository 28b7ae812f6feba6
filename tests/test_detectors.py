import numpy as np
import pytest
from pyspark.sql import functions as F

from tallysheet.operators import detectors as D
from tallysheet.operators import symbols as S

WHOLE = [("full_image", 0.0, 0.0, 1.0, 1.0)]


@pytest.fixture(scope="module")
def matrices(spark):
    df = spark.createDataFrame([(1, "short", "L"), (2, "a longer text, é 漢", "H"), (3, "x" * 90, "M"), (4, "y" * 200, "L")], "image_id long, payload string, level string")
    made = S.encoded(df)
    return {r.image_id: (r.payload, np.array(r.m)) for r in made.select("image_id", "payload", S.modules(F.col("symbol"), F.col("size")).alias("m")).collect()}


def page(m, box, x, y, shape, ink=10, paper=240):
    out = np.full(shape, paper)
    big = np.kron(m, np.ones((box, box), bool))
    out[y : y + len(big), x : x + len(big)] = np.where(big, ink, paper)
    return out


@pytest.mark.parametrize("box", [1, 2, 3, 5])
@pytest.mark.parametrize("turns", range(4))
def test_every_turn_and_size(matrices, box, turns):
    for _, m in matrices.values():
        side = len(m) * box
        (f,) = D.upright_symbols(page(np.rot90(m, turns), box, 7, 11, (side + 30, side + 40)))
        assert (f.x, f.y, f.w, f.h) == (7, 11, side, side) and (f.modules == m).all()


def test_several_symbols_noise_and_nothing(matrices):
    a, b = matrices[1][1], matrices[3][1]
    both = np.full((200, 300), 230)
    both[20 : 20 + 2 * len(a), 10 : 10 + 2 * len(a)] = np.where(np.kron(a, np.ones((2, 2), bool)), 0, 230)
    both[60 : 60 + 3 * len(b), 120 : 120 + 3 * len(b)] = np.where(np.kron(b, np.ones((3, 3), bool)), 0, 230)
    noisy = np.clip(both + np.random.default_rng(5).integers(-40, 40, both.shape), 0, 255)
    found = D.upright_symbols(noisy)
    assert sorted((f.x, f.y, f.w) for f in found) == [(10, 20, 2 * len(a)), (120, 60, 3 * len(b))]
    for nothing in (np.zeros((0, 0), int), np.full((9, 9), 7), np.array([[0, 255]]), np.random.default_rng(1).integers(0, 256, (60, 60))):
        assert D.upright_symbols(nothing) == []


def test_search_stops_at_the_first_region_and_bears_errors(spark, matrices):
    (text, m), (other, n) = matrices[1], matrices[2]
    image = page(m, 3, 100, 0, (200, 200))
    image[110 : 110 + 3 * len(n), 0 : 3 * len(n)] = np.where(np.kron(n, np.ones((3, 3), bool)), 10, 240)
    rows = [(1, 200, 200, image.ravel().tolist()), (2, 200, 200, np.full(40000, 9).tolist()), (3, 200, 200, page(n, 3, 0, 110, (200, 200)).ravel().tolist()), (4, 0, 0, [])]
    images = spark.createDataFrame(rows, "image_id long, height int, width int, pixels array<int>")
    known = D.Detectors()
    known.register("upright", D.upright_symbols, 2)
    known.register("broken", lambda x: 1 / 0, 1)
    known.register("absent", D.upright_symbols, needs=("no_such_package_here",))
    assert known.available() == ["upright", "broken"] and known.self_test()["upright"] == "ok" and "zero" in known.self_test()["broken"]
    regions = [("top_right", 0.5, 0.0, 0.5, 0.5), *WHOLE]
    got = D.read(known.search(images, regions)).collect()
    read = {(r.image_id, r.region, r.x, r.y, r.data) for r in got if r.method == "upright"}
    assert read == {(1, "top_right", 0, 0, text), (3, "full_image", 0, 110, other)}
    assert sorted((r.image_id, r.region) for r in got if r.method == "broken") == [(1, "top_right"), (2, "full_image"), (2, "top_right"), (3, "full_image"), (3, "top_right"), (4, "full_image"), (4, "top_right")]
    small = known.search(images, regions, least=90, names=["upright"])
    assert {(r.image_id, r.region) for r in small.collect()} <= {(1, "full_image"), (3, "full_image")}


def test_texts_of_a_detector_and_unreadable_modules(spark):
    known = D.Detectors()
    known.register("reader", lambda x: [D.Found(1, 2, 60, 60, text="read", confidence=0.9)])
    known.register("blind", lambda x: [D.Found(1, 2, 60, 60, modules=np.zeros((21, 21), bool))])
    images = spark.createDataFrame([(1, 1, 1, [0])], "image_id long, height int, width int, pixels array<int>")
    got = {r.method: (r.data, r.error_message) for r in D.read(known.search(images, WHOLE)).collect()}
    assert got == {"reader": ("read", None), "blind": (None, "no format")}


def test_pages_are_bytes_with_turned_symbols(spark, matrices):
    """All turns on one page each, drawn as one byte a grey; a page without a symbol is blank."""
    rows = [(k, "a longer text, é 漢", "H", k) for k in range(4)] + [(9, None, "H", 1)]
    made = S.encoded(spark.createDataFrame(rows, "image_id long, payload string, level string, turns int"))
    turned = made.select("image_id", D.turned(F.col("symbol"), F.col("turns")).alias("symbol"), F.lit(7).alias("x"), F.lit(11).alias("y"), F.lit(10).alias("ink"), F.lit(240).alias("paper"))
    got = {r.image_id: np.frombuffer(bytes(r.pixels), np.uint8).reshape(150, 140) for r in D.printed(turned, 140, 150).collect()}
    for k in range(4):
        assert (got[k] == page(np.rot90(matrices[2][1], -k), 2, 7, 11, (150, 140))).all()
    assert (got[9] == 240).all()
