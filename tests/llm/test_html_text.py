"""Main text of pages: reading, the network against plain loops and differences, held-out layouts, given and odd pages."""

import re
from html import unescape

import numpy as np
import pytest

from waybill.llm import html_text as H

WORDS = "the quick brown fox jumps over a lazy dog while it rains and nobody seems to care about any of this today".split()


@pytest.fixture(scope="module")
def given(duck):
    return [r[0] for r in duck.execute("select html from pages order by page_id").fetchall()]


@pytest.fixture(scope="module")
def network(spark, sf_dir):
    return H.train(spark.read.parquet(f"{sf_dir}/pages.parquet"))


@pytest.mark.parametrize("html, expected", [
    (None, []), ("", []), ("<p>", []), ("plain &amp; simple", ["plain & simple"]),
    ("<p>a<p>b <b>c</b>d<br>e<div>f</div>g", ["a", "b cd e", "f", "g"]),
    ("<p>a\n\t b&nbsp; c</p>&lt;p&gt;", ["a b c", "<p>"]), ("x<!-- <p>no</p> -->y<!-- open", ["xy"]),
    ("<script>var t='</p><p>no';</script><style>p{}</style><title>t</title>yes", ["yes"]), ("a<script>no", ["a"]),
    ("<p title='a>b' class=x>q</p>", ["q"]), ("<p title='open>q</p>r", ["q", "r"]), ("1 < 2 and 3<4", ["1 < 2 and 3<4"]), ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", ["a", "b", "c", "d"]),
    ("<table><tr><td>a<td>b<tr><td>c</table>", ["a", "b", "c"]), ("</div>a</p></b>b", ["a", "b"]), ("<DIV>a</DiV><template><p>no</p></template>b", ["a", "b"]), ("a<hr>b<p", ["a", "b"]),
])
def test_reading(html, expected):
    assert H.Page(html).texts == expected


def test_paths():
    page = H.Page('<body><div class="side-bar Box2" id=x><ul><li>a</ul></div><p>b')
    path = lambda i: [] if not i else path(page.parents[i]) + page.names[i]
    assert [path(i) for i in page.nodes] == [["body", "div", "side", "bar", "box", "2", "x", "ul", "li"], ["body", "p"]]
    assert H.Page("<p>ab <a href=x>cd</a> e</p>").linked == [2 / 7]


def test_deep_and_broken_pages_take_linear_time():
    page = H.Page("<div class=a>x" * 20_000 + "</p></i>" * 20_000 + "y" * 10)
    assert len(page.texts) == 20_001 and H.Network().inputs(page, H.Features()).shape[0] == 20_001


def small_pages(n, seed=1):
    layouts = H.Layouts([" ".join(WORDS)] * 3, seed)
    return [layouts.page() for _ in range(n)]


def test_network_equals_a_plain_loop():
    """Pages of unlike length side by side, against one page, one step and one unit at a time."""
    net, features = H.Network(3), H.Features()
    pages = [net.inputs(p, features) for p, _ in small_pages(5) if p.texts]
    sigmoid = lambda v: 1 / (1 + np.exp(-v))
    for x, got in zip(pages, net.judge(pages)):
        sides = []
        for side, order in (("f", range(len(x))), ("b", reversed(range(len(x))))):
            h, c, states = np.zeros(H.UNITS), np.zeros(H.UNITS), {}
            for t in order:
                z = x[t] @ net.p[f"w{side}"] + h @ net.p[f"u{side}"] + net.p[f"c{side}"]
                for j in range(H.UNITS):
                    c[j] = sigmoid(z[H.UNITS + j]) * c[j] + sigmoid(z[j]) * np.tanh(z[3 * H.UNITS + j])
                h = np.array([sigmoid(z[2 * H.UNITS + j]) * np.tanh(c[j]) for j in range(H.UNITS)])
                states[t] = h
            sides.append(np.array([states[t] for t in range(len(x))]))
        expected = sigmoid(np.hstack([*sides, x]) @ net.p["out"] + net.p["bias"])
        np.testing.assert_allclose(got, expected, rtol=1e-9)


def test_gradients_equal_differences():
    net, features = H.Network(4), H.Features()
    pages, labels = zip(*[k for k in small_pages(4, 2) if k[0].texts])
    _, g = net.gradients(pages, labels, features)
    r = np.random.default_rng(0)
    for name, value in net.p.items():
        for at in zip(*(i[r.integers(len(i), size=4)] for i in np.nonzero(g[name]))):
            kept, losses = value[at], []
            for step in (1e-5, -1e-5):
                value[at] = kept + step
                losses.append(net.gradients(pages, labels, features)[0])
            value[at] = kept
            assert (losses[0] - losses[1]) / 2e-5 == pytest.approx(g[name][at], rel=1e-3, abs=1e-7)


def test_held_out_layouts(network, given):
    """Layouts drawn by another seed, filled with texts of pages beyond the sample's use."""
    layouts = H.Layouts(H.paragraphs_of(given[-40:]), seed=99)
    pages, labels = zip(*[k for k in (layouts.page() for _ in range(200)) if k[0].texts])
    scores = np.concatenate(network.judge([network.inputs(p, H.Features()) for p in pages]))
    main = np.concatenate(labels)
    assert ((scores >= 0.5) == main).mean() > 0.98
    assert main[scores >= 0.5].mean() > 0.97 and (scores[main] >= 0.5).mean() > 0.97


def plain(html):
    article = re.search("<article>(.*)</article>", html, re.S)[1]
    parts = (" ".join(unescape(re.sub("<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split("</?(?:p|h1)>", article))
    return "\n\n".join(p for p in parts if p)


def test_given_pages(network, given):
    got = H.Extractor(network).texts(given)
    expected = [plain(h) for h in given]
    assert np.mean([a == b for a, b in zip(got, expected)]) > 0.97


MADE = """<!doctype html><html><head><title>Site - T</title></head><body>
<div id="cookie-banner">We use cookies to improve your visit. <button>Accept</button></div>
<header class="site-header"><div class="logo">My Site</div><ul class="menu"><li><a href="/">Home</a></li><li><a href="/a">About</a></li><li><a href="/n">News</a></li></ul></header>
<div class="wrapper"><div class="post-content"><h1>{0}</h1><p>{1}</p><div class="advertisement">Buy our shoes now, only today!</div><p>{2}</p><h2>{3}</h2><p>{4}</p></div>
<aside class="sidebar"><h3>Recent posts</h3><ul><li><a href="1">First post here</a></li><li><a href="2">Second one</a></li></ul></aside>
<section id="comments"><h3>2 comments</h3><div class="comment"><b>Ann</b><p>{5}</p></div><div class="comment"><b>Bob</b><p>I do not agree with any of this at all, sorry.</p></div></section>
<form class="newsletter"><label>Your mail</label><input><button>Subscribe</button></form></div>
<footer><p>&copy; 2020 My Site. All rights reserved.</p></footer></body></html>"""


def test_a_page_with_all_parts(network, given):
    texts = sorted({t for t in H.paragraphs_of(given[:30]) if 100 < len(t) < 600})[:60]
    r = np.random.default_rng(2)
    whole = 0
    for _ in range(20):
        a = [texts[i] for i in r.integers(0, len(texts), 6)]
        a[0], a[3] = " ".join(a[0].split()[:6]), " ".join(a[3].split()[:4])
        main = "\n\n".join(a[:5])
        got = H.Extractor(network).texts([MADE.format(*(x.replace("&", "&amp;").replace("<", "&lt;") for x in a))])[0]
        whole += got == main
        kept = got.split("\n\n")
        assert sum(len(t) for t in kept if t in a[:5]) > 0.9 * len(got) and sum(len(t) for t in a[:5] if t in kept) > 0.9 * sum(map(len, a[:5]))
    assert whole >= 14


def test_odd_rows(spark, network, given):
    long = "<div class=menu>" + "<a href=x>m</a>" * 2000 + "</div><article>" + given[0] * 20 + "</article>"
    rows = [(1, None, None), (2, "u", ""), (3, "u", " \n "), (4, "u", "<script>x"), (5, "u", long), (6, "u", given[1]), (6, "u", given[1]), (None, None, given[1]), (7, "v", "\x00퟿🙂")]
    df = spark.createDataFrame([(*r, "t", 1) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    got = H.main_texts(df, network).collect()
    assert [(g.page_id, g.url) for g in got] == [r[:2] for r in rows]
    assert all(g.n_chars == len(g.text) for g in got) and [g.text for g in got[:4]] == [""] * 4
    assert got[4].n_chars > 10_000 and got[5].text == got[6].text == got[7].text != ""
    assert H.main_texts(df.limit(0), network).collect() == []


def test_training_without_pages(spark):
    network = H.train(spark.createDataFrame([], "page_id long, url string, html string"), laid_out=20)
    assert H.Extractor(network).texts([""]) == [""]
