import random
import time

import numpy as np
import pytest

from tallysheet.llm.dom import parse
from tallysheet.llm.html_text import Extractor, extract_pages
from tallysheet.llm.pages_gen import MARK, make_page

SHAPE = "page_id long, url string, html string, text string, n_chars string"


@pytest.fixture(scope="module")
def model():
    return Extractor.train(400)


def test_pages_the_model_has_not_seen(model):
    """Words of the main text found, and words found that belong to it, on pages of other seeds."""
    found = kept = right = 0
    for seed in range(50_000, 50_150):
        page = make_page(seed)
        want = [t.replace(MARK, "").strip() for t in parse(page).texts if MARK in t]
        got = model.extract([page.replace(MARK, "")])[0].split("\n\n")
        right += sum(len(t) for t in want)
        kept += sum(len(t) for t in got)
        found += sum(len(t) for t in got if t in set(want))
    assert found > 0.97 * right and found > 0.97 * kept


def test_nothing_is_kept_below_a_dropped_node(model):
    from tallysheet.llm.html_text import Forest

    forest = Forest([parse(make_page(seed)) for seed in range(60_000, 60_020)])
    keep = model.keep(forest)
    inner = np.flatnonzero(keep & ~forest.root)
    assert len(inner) and keep[forest.parent[inner]].all()


def test_the_choice_is_the_likeliest_of_all(model):
    """On small pages: node scores walked tree by tree, and every choice tried in which nothing is kept below a dropped node."""
    from tallysheet.llm.html_text import DEPTH, Forest

    rng, tried = random.Random(6), 0
    for _ in range(40):
        parts = [rng.choice(["<p>{0}</p>", "<div class=ad>{0}</div>", "<nav><a href=x>{0}</a></nav>", "<article><h1>{0}</h1><p>{0}</p></article>", "<footer><p>{0}</p></footer>"]) for _ in range(rng.randint(1, 4))]
        forest = Forest([parse("".join(p.format(" ".join(["word"] * rng.randint(1, 60))) for p in parts))])
        n = len(forest.page)
        if n > 16:
            continue
        x = model.matrix(model.packed(forest), forest.measures())
        scores = []
        for row in x:
            total = 0.0
            for feature, value in zip(model.feature, model.value, strict=True):
                place = 0
                for _ in range(DEPTH):
                    place = 2 * place + 1 + int(row[feature[place]])
                total += value[place - (2**DEPTH - 1)]
            scores.append(total)
        worth = {}
        for bits in range(1 << (n - 1)):
            chosen = {0} | {k for k in range(1, n) if bits >> (k - 1) & 1}
            if all(forest.parent[k] in chosen for k in chosen if k):
                worth[frozenset(chosen)] = sum(scores[k] for k in chosen if k)
        assert worth[frozenset(np.flatnonzero(model.keep(forest)).tolist())] == pytest.approx(max(worth.values()))
        tried += 1
    assert tried > 10


PAGE = """<!DOCTYPE html><html><head><title>Not this</title><style>p{}</style></head><body>
<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav>
<article><h1>A &amp; B   headline</h1><p>First&nbsp;paragraph, with <b>bold</b>
text and a <a href="x">link</a>, long enough to be the article.<p>Second paragraph &lt;kept&gt;, &#233;t&#xe9;. It is not closed, and goes on for a while.
<script>var t = "</p>";</script><!-- a <p>comment</p> --></article>
<footer>&copy; site, all rights reserved</footer></body></html>"""


def test_a_page_by_hand(model):
    assert model.extract([PAGE]) == ["A & B headline\n\nFirst paragraph, with bold text and a link, long enough to be the article.\n\nSecond paragraph <kept>, été. It is not closed, and goes on for a while."]


def test_odd_pages(spark, model):
    rows = [(1, "u", None), (2, "u", ""), (3, None, "   "), (4, "u", "<p"), (5, "u", "</div></p>"), (6, "u", PAGE), (6, "u", PAGE), (7, "u", "<div>" * 3000 + "deep"), (8, "u", "<p>" + "long word " * 50_000 + "</p>"), (None, "u", "<!--"), (9, "u", "<script>never closed")]
    got = extract_pages(spark.createDataFrame([(*r, None, None) for r in rows], SHAPE), model).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    by = {r.page_id: r.text for r in got}
    assert by[1] == by[2] == by[3] == by[9] == by[None] == "" and by[6].startswith("A & B headline")
    assert extract_pages(spark.createDataFrame([], SHAPE), model).count() == 0


def texts(source):
    return [t for t in parse(source).texts if t]


def test_missing_end_tags_lose_no_text():
    # Head and body are optional.
    assert texts("<html><head><title>no</title><meta charset=x><h1>One</h1><p>Two") == ["One", "Two"]
    assert texts("<head><link rel=x>bare text<p>Two") == ["bare text", "Two"]
    for tag in ("button", "select", "object", "video", "svg", "audio", "canvas", "datalist"):
        for page in (f"<article><p>One</p><{tag}><p>Two</p><p>Three</p></article><p>Four", f"<article><p>One</p><div><{tag}></div><p>Two</p><p>Three</p></article><p>Four", f"<p>One</p><{tag}><p>Two<p>Three<{tag}>hid</{tag}><p>Four"):
            got = texts(page)
            assert [t for t in got if t in ("One", "Two", "Three", "Four") or t.startswith("Three")][:2] == ["One", "Two"] and got[-1] == "Four" and any(t.startswith("Three") for t in got), page
    # Words of the same block go on after an element that nothing ends.
    assert texts("<p>One <svg> two</p><p>Three") == ["One two", "Three"]
    assert texts("<p>One <select><option>a<option>b</p><p>Two") == ["One", "Two"]


def test_unshown_text_stays_hidden_and_fallback_text_is_read():
    assert texts("<p>One <button><div>hid</div></button> two</p><p>Three") == ["One", "two", "Three"]
    assert texts("<p>One <select><option>a</option></select><svg><svg>x</svg><text>y</text></svg><video>z</video> two</p>") == ["One two"]
    assert texts("<p>If <math><mi>x</mi><mo>=</mo><mn>2</mn></math> then <object>a chart</object>.</p>") == ["If x=2 then a chart."]


def test_article_after_an_open_button_is_extracted(model):
    page = PAGE.replace("</h1>", "</h1><button>Share")
    assert "Second paragraph <kept>" in model.extract([page])[0]
    assert "Second paragraph <kept>" in model.extract([PAGE.replace("</head><body>", "")])[0]


def test_depth_costs_no_more_than_length(model):
    """Time per element of very deep pages, with end tags, without, and with tags that look for open ones."""
    start = time.perf_counter()
    for page in ("<div>" * 200_000 + "deep", "<div>" * 60_000 + "deep" + "</div>" * 60_000, "<div>" * 40_000 + "<td></td><li>" * 40_000, "<ul><li>" * 50_000 + "deep"):
        parse(page)
    assert time.perf_counter() - start < 60
    assert model.extract(["<div>" * 20_000 + "<p>a word</p>" * 3])[0] in ("", "a word\n\na word\n\na word")
