import random
from itertools import product

import numpy as np

from rasterloom.llm import html

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><article>no</article>";</script></head><body>
<header><a href=/>Site</a> <b>name</b></header><nav><ul><li><a href=a>One</a><li><a href=b>Two</a></ul></nav><!-- <p>no</p> --><div class="cookie-notice"><p>We use cookies. A long and wordy text about them, with full sentences. Really.</p></div>
<article><header><h1>A&nbsp;title &amp; more</h1></header><p><b>First   paragraph<br>goes on. <p>Second &lt;one&gt;,
with <a href=x>a link</a>.<ul><li>item</ul><aside>An aside.</aside><form><label>Name</label><input><button>Send</button></form>
<div id="comments"><p>I liked this article very much. Thank you for it.</p></div><p>Last.</p></article>
<aside class=sidebar><p>Other things. Many of them.</p></aside><footer>&copy; 2020</footer></body>"""


def test_page():
    assert html.extract(PAGE) == "A title & more\nFirst paragraph goes on.\nSecond <one>, with a link.\nitem\nLast."


def test_edges(spark):
    assert [html.extract(x) for x in (None, "", "   ", "<p></p>", "<script>x", "<!-- open", "<nav>only</nav>")] == [""] * 7
    long = "<article>" + "".join(f"<p>word {i} and some more words here.</p>" for i in range(20_000)) + "</article>"
    assert html.extract(long).count("\n") == 19_999
    pages = spark.createDataFrame([(None, "u", None, "x"), (2, None, PAGE, "y"), (2, None, PAGE, "y")], "page_id long, url string, html string, text string")
    got = html.main_text(pages).collect()
    assert len(got) == 3 and sum(r.text == "" for r in got) == 1
    assert html.main_text(pages.limit(0)).collect() == []


def test_minimum_cut_against_all_labellings():
    rnd = random.Random(1)
    for _ in range(300):
        n = rnd.randint(1, 9)
        unary = [rnd.choice([-2.5, -1, -0.3, 0, 0.4, 1.1, 3]) + rnd.random() / 7 for _ in range(n)]
        links = [(rnd.randrange(n), rnd.randrange(n), rnd.random() * 2) for _ in range(2 * n)]

        def cost(side):
            return sum(max(u, 0) * (not s) + max(-u, 0) * s for u, s in zip(unary, side, strict=True)) + sum(w * (side[a] != side[b]) for a, b, w in links)  # noqa: B023

        assert abs(cost(html.minimum_cut(unary, links)) - min(map(cost, product([False, True], repeat=n)))) < 1e-9


def test_smoothing_decides_doubtful_blocks():
    assert html.minimum_cut([3, -0.2, 3], [(0, 1, 0.5), (1, 2, 0.5)]) == [True] * 3
    assert html.minimum_cut([3, -0.2, 3], []) == [True, False, True]


def test_classifier_on_other_layouts():
    x, y = html.made_up(77, 100)
    assert ((x @ np.array(html.weights()) > 0) == (y > 0)).mean() > 0.93


def test_sentences_late_in_a_block():
    block = html.blocks("<p>" + "verse without an end " * 300 + "One is here. Two is here. Three is here.</p>")[0]
    assert html.shape(block)[html.FEATURES.index("sentences")] == 1


def test_only_scripts_and_the_like_are_dropped():
    words = lambda page: " ".join(b.text for b in html.blocks(page))
    assert words("<p>so <math><mi>x</mi>=<mn>2</mn></math> holds</p>") == "so x=2 holds"
    assert words("<noscript><p>a</p></noscript><object>b</object><svg><text>c</text></svg>") == "a bc"
    for tag in ("object", "svg", "math", "noscript", "template", "iframe", "textarea", "title"):
        assert words(f"<p>one</p><{tag} id=x><p>two</p>") == "one two"
    for tag in ("script", "style", "template", "iframe", "textarea", "title"):
        assert words(f"<p>one</p><{tag} id=x>no</{tag}><p>two</p>") == "one two"
    assert words("<p>one</p><script>let a = 1") == "one"


def test_deep_trees_take_little():
    deep = "<div>word " * 60_000
    assert len(html.blocks(deep)) == 60_000
    assert len(html.edges(html.blocks(deep))) >= 59_999
    assert len(html.blocks("<div>a" * 30_000 + "</section>" * 30_000)) == 30_000


def test_distance_in_the_tree():
    a, b, c = html.blocks("<div><div><p>one</p></div><p>two</p></div><p>three</p>")
    assert [html.distance(a.place, b.place), html.distance(a.place, c.place), html.distance(b.place, a.place), html.distance(a.place, a.place)] == [3, 4, 3, 0]


def test_hand_written_pages_without_telling_names():
    page = """<body><div><a href=/>Start</a> <a href=/b>Blog</a> <a href=/k>Kontakt</a></div>
    <div><h1>Die alte Mühle</h1><p>Am Rand des Dorfes steht seit über zweihundert Jahren eine Mühle. Sie mahlt nicht mehr, aber ihr Rad dreht sich noch.</p>
    <p>Im Sommer kommen Kinder her, um im Bach zu baden. Im Winter friert das Rad ein, und dann ist es still.</p></div>
    <div><a href=/impressum>Impressum</a> <a href=/daten>Datenschutz</a></div></body>"""
    got = html.extract(page)
    assert "zweihundert" in got and "Bach zu baden" in got and "Impressum" not in got and "Kontakt" not in got


def test_broken_pages_take_linear_time():
    import time

    for part in ("<iframe>", '<div title="', "<p a='", "<textarea>", "<!", "<", "<b c=\"'", "<p a='\"<q b=\"'", "</iframe ", '<div a=">'):
        page = "<p>Before.</p>" + part * (10**6 // len(part))
        began = time.process_time()
        html.extract(page)
        assert time.process_time() - began < 4, part
    assert " ".join(b.text for b in html.blocks('<p>one</p><div title="two>three<p>four')) == "one three four"
    assert [b.text for b in html.blocks("<p title='a > b'>one</p><p x=\"</p>\">two</p>")] == ["one", "two"]


def test_wrappers_and_notices():
    page = '<div class="page-wrapper"><p>An article about mills. It has sentences, and they end.</p><p>It goes on for a while. Then it stops.</p><div class="bottom">Copyright 2020 X.</div></div>'
    assert html.extract(page) == "An article about mills. It has sentences, and they end.\nIt goes on for a while. Then it stops."
