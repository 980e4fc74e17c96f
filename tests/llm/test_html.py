"""HTML extraction: pages written by hand (not those the model is trained on), broken markup, odd tables."""

from __future__ import annotations

import time

import pytest

from tidemark.llm import op06_html

#: Pages with the text that a reader would call the article.
HELD_OUT = [
    (
        """<!doctype html><html lang=en><head><title>Tides</title><meta charset=utf-8></head><body class="home-page">
        <div id="top-nav"><a href="/">Start</a> <a href="/sea">Sea</a> <a href="/land">Land</a></div>
        <main><article class="post"><h1>Why tides turn twice</h1><p class="lead">The moon pulls on the sea, and the sea follows.</p>
        <p>Twice a day the water comes back. In narrow bays it rises by <b>ten metres</b> and more.</p>
        <h2>Spring and neap</h2><ul><li>At full moon the range is largest.</li><li>At half moon it is least.</li></ul></article></main>
        <aside class="sidebar"><h3>Most read</h3><ul><li><a href="/a">Ten lighthouses</a></li></ul></aside>
        <footer><p>&copy; 2020 The Coast Paper</p></footer></body></html>""",
        "Why tides turn twice\nThe moon pulls on the sea, and the sea follows.\nTwice a day the water comes back. In narrow bays it rises by ten metres and more.\n"
        "Spring and neap\nAt full moon the range is largest.\nAt half moon it is least.",
    ),
    (
        """<html><body><header><h1>Daily Miller</h1></header><nav><ul><li><a href=#>Home</a></li></ul></nav><div class="cookie-consent">This site uses cookies.<button>OK</button></div>
        <div class="content"><h1>Flour &amp; water</h1><p>Mix both &#8212; slowly.<p>Rest the dough for an hour, then fold it.<table><tr><td>Flour</td><td>500 g</td></tr></table></div>
        <section id="comments"><h2>3 comments</h2><p>Worked well for me, thanks for sharing it!</p></section></body></html>""",
        "Flour & water\nMix both — slowly.\nRest the dough for an hour, then fold it.\nFlour\n500 g",
    ),
    (
        """<body><div class="wrapper"><div class="menu"><a href=1>One</a><a href=2>Two</a></div><div id="story"><h2>Die Brücke</h2>
        <p>Niemand im Dorf wusste, wann die alte Brücke gebaut worden war.</p><blockquote>Sie stand schon immer.</blockquote>
        <div class="newsletter-signup"><p>Get our letter every week.</p><form><input name=mail><label>Mail</label></form></div>
        <p>Im Winter trug sie Schnee, im Sommer Heu.</p></div></div><div class="footer">Impressum</div></body>""",
        "Die Brücke\nNiemand im Dorf wusste, wann die alte Brücke gebaut worden war.\nSie stand schon immer.\nIm Winter trug sie Schnee, im Sommer Heu.",
    ),
    (
        """<html><body><article><h1>Roots</h1><p>For every x, <math><msup><mi>x</mi><mn>2</mn></msup><mo>≥</mo><mn>0</mn></math> holds.</p>
        <p>Nothing else is needed here.</p><button>Share<p>The rest follows from the first line of the proof.</p></article></body></html>""",
        None,  # broken on purpose: see the test below
    ),
]


@pytest.mark.parametrize("page", range(3))
def test_held_out_pages(page):
    source, want = HELD_OUT[page]
    assert op06_html.main_text(source, op06_html.trained()) == want


def test_unclosed_choices_and_formulas():
    model = op06_html.trained()
    article = "<article><h1>Title here</h1><p>The first sentence stands here. A second one, too.</p><p>And a last one.</p></article>"
    want = "Title here\nThe first sentence stands here. A second one, too.\nAnd a last one."
    for head in ("<header><datalist><option value=a><option value=b></datalist></header>", "<header><button>Share</header>", "<nav><select><option>One<option>Two</nav>",
                 "<header><svg><path d=m></header>", "<header><object data=x></header>", "<script>var a = '<p>';</script>", "<!-- <p> -->"):
        assert op06_html.main_text(f"<body>{head}{article}</body>", model) == want, head
    assert op06_html.main_text(HELD_OUT[3][0], model).startswith("Roots\nFor every x, x2≥0 holds.\nNothing else is needed here.")


@pytest.mark.parametrize("part", ["<a ", '<a "', "<b></u>", "<u><div><i></u>", "<p>", "<!", "<!--", "<button>", "<a href='", "<span><p>", "&", "</p>", "<option>"])
def test_broken_markup_takes_linear_time(part):
    source, began = part * (500_000 // len(part)), time.time()
    assert isinstance(op06_html.main_text(source, op06_html.trained()), str)
    assert time.time() - began < 20


def test_pages_as_a_table(spark):
    model = op06_html.trained()
    long = "<article>" + "<p>A sentence of some length stands in this place.</p>" * 20_000 + "</article>"
    rows = [(1, "u1", HELD_OUT[0][0], "x", 7), (2, None, None, None, None), (None, "u", "", "x", 1), (3, "u3", long, "y", 2), (1, "u1", HELD_OUT[0][0], "x", 7), (4, "v", "<b", "", 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars long").repartition(3)
    want = sorted(((i, u, t := op06_html.main_text(h, model), len(t)) for i, u, h, _, _ in rows), key=str)
    assert sorted(map(tuple, op06_html.extract(pages).collect()), key=str) == want
    assert op06_html.extract(pages.limit(0)).collect() == []
