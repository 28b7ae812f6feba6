from pyspark.sql import functions as F

from tallysheet.operators import layout

DDL = "page_id long, idx long, text string, conf double, left double, top double, width double, height double"


def boxes(spark, rows):
    return spark.createDataFrame([(1, i, t, 50.0, float(x), float(y), float(w), float(h)) for i, (t, x, y, w, h) in enumerate(rows)], DDL)


def test_lines_grow_from_their_first_box(spark):
    b = boxes(spark, [(str(t), 10 * k, t, 5, 5) for k, t in enumerate((0, 15, 25, 40, 45))])
    got = [r.line_no for r in layout.anchor_lines(b).orderBy("idx").collect()]
    assert got == [1, 1, 2, 2, 2]


def test_weighted_lines(spark):
    b = boxes(spark, [("a", 0, 0, 10, 0), ("b", 0, 40, 30, 0), ("c", 0, 70, 10, 0), ("d", 0, 100, 1, 0)])
    assert [r.line_no for r in layout.weighted_lines(b).orderBy("idx").collect()] == [1, 1, 1, 2]
    zero = boxes(spark, [("a", 0, 0, 0, 0), ("b", 0, 40, 0, 0), ("c", 0, 80, 0, 0)])
    assert [r.line_no for r in layout.weighted_lines(zero).orderBy("idx").collect()] == [1, 1, 1]


def test_line_and_page_texts(spark):
    b = boxes(spark, [("b", 30, 2, 10, 5), ("a", 5, 0, 10, 5), ("c", 42, 1, 5, 5), ("d", 5, 60, 5, 5)])
    lines = layout.line_texts(layout.anchor_lines(b))
    assert layout.page_texts(lines).first().text == "a bc\nd"
    assert layout.simple_text(b).first().text == "b a c d"


def test_filters_and_corners(spark):
    rows = spark.createDataFrame([(1, 0, " a ", 0.9, 0.0, 0.0, 1.0, 1.0), (1, 1, " ", 50.0, 0.0, 0.0, 1.0, 1.0), (1, 2, "ok", 1.0, 0.0, 0.0, 1.0, 1.0)], DDL)
    assert [r.text for r in layout.confident(rows).collect()] == ["ok"]
    assert [r.text for r in layout.confident(rows, 0.3, 2, strictly=False).collect()] == ["ok"]
    c = spark.range(1).select(F.expr('array(named_struct("x", 1d, "y", 2d), named_struct("x", 5d, "y", 2d), named_struct("x", 5d, "y", 8d), named_struct("x", 1d, "y", 8d))').alias("corners"))
    r = layout.corners_to_box(c).first()
    assert (r.left, r.top, r.width, r.height, r.center_x, r.center_y) == (1, 2, 4, 6, 3, 5)


def plain_lines(tops, threshold=20.0):
    """Line numbers of tops in ascending order, box after box."""
    out, anchor = [], None
    for top in sorted(tops):
        if anchor is None or top - anchor > threshold:
            anchor, out = top, [*out, (out[-1] if out else 0) + 1]
        else:
            out.append(out[-1])
    return out


def plain_weighted(rows, threshold=50.0):
    """Line numbers of (centre, width) in ascending order of centre, box after box."""
    out, cy, yw, w = [], None, 0.0, 0.0
    for y, width in sorted(rows, key=lambda r: r[0]):
        new = cy is None or abs(y - cy) > threshold
        yw, w = (0.0 if new else yw) + y * width, (0.0 if new else w) + width
        cy = y if new or w == 0 else yw / w
        out.append((out[-1] if out else 0) + new)
    return out


def test_lines_of_many_boxes(spark):
    places = [k * 37 % 400 for k in range(600)]
    b = boxes(spark, [("w", k % 90, y, k % 7, 0) for k, y in enumerate(places)])
    got = layout.anchor_lines(b).orderBy("top", "idx").collect()
    assert [r.line_no for r in got] == plain_lines(places)
    got = layout.weighted_lines(b, 11.0).orderBy("center_y", "idx").collect()
    assert [r.line_no for r in got] == plain_weighted([(y, k % 7) for k, y in enumerate(places)], 11.0)


def test_boxes_without_a_place_or_page(spark):
    b = spark.createDataFrame([(1, 0, "a", 50.0, 0.0, None, 1.0, 1.0), (1, 1, "b", 50.0, 0.0, 5.0, 1.0, 1.0), (None, 2, "c", 50.0, 0.0, 9.0, None, 1.0), (2, 3, "d", 50.0, None, None, 1.0, None)], DDL)
    assert {r.text: r.line_no for r in layout.anchor_lines(b).collect()} == {"a": 0, "b": 1, "c": 1, "d": 0}
    assert {r.text: r.line_no for r in layout.weighted_lines(b).collect()} == {"a": 0, "b": 1, "c": 1, "d": 0}


def test_empty_pages(spark):
    b = boxes(spark, [("a", 0, 0, 1, 1)]).where("false")
    assert layout.page_texts(layout.line_texts(layout.anchor_lines(b))).count() == 0
