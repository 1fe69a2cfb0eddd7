"""Operator 11: blocks, the field against enumeration, labelled pages held out, and the given pages."""

from html.parser import HTMLParser
from itertools import product

import numpy as np
import pytest

from quillon.llm import extraction, labelled_pages

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model():
    return extraction.fit(labelled_pages.compose(500))


def texts(page):
    return [x[0] for x in extraction.Reader().blocks(page)]


def test_blocks():
    assert texts("<p>a &amp; b&nbsp;&nbsp;c\n d<p><b>e<br>f</b>g<ul><li>h<li>i</ul>") == ["a & b c d", "e fg", "h", "i"]
    assert texts("x<!-- <p>no</p> -->y<!-->z<!--->u<script>var t='</p>';</script>v<style>p{}</style>") == ["xyzuv"]
    assert texts('<p title="a>b" class=\'c>d\'>in</p>&lt;p&gt; 1 < 2 &copy; &#233; &#x1F600; &am') == ["in", "<p> 1 < 2 © é 😀 &am"]
    assert texts("<table><tr><td>a<td>b<tr><td>c</table><textarea><p>no</textarea><title>no</title><template><p>no</p></template>") == ["a", "b", "c"]
    assert texts("open <script>never closed <p>x") == ["open"] and texts("a<!-- never closed") == ["a"] and texts("a<p class='b") == ["a"]
    assert texts("") == [] and texts(" \n ") == [] and texts("</p></div>x") == ["x"] and texts("<P>a</P>b") == ["a", "b"]
    assert len(texts("<p>" + "word " * 300_000)[0]) == 5 * 300_000 - 1


def test_elements_around():
    found = {t: e.around for t, e, _ in extraction.Reader().blocks('<div class="siteNav main-menu"><ul><li>a</ul></div><article><p>b<h2>c</h2><div hidden>d</div></article>e')}
    assert {"t:ul", "k:site", "k:nav", "k:main-menu", "t:div"} <= found["a"] and "t:article" not in found["a"]
    assert "t:p" not in found["c"] and "hidden" in found["d"] and found["e"] == frozenset({"t:"}) or "t:article" not in found["e"]


def brute(node, steps, moves):
    """Weight of every labelling of one page."""
    n = len(node)
    return {y: sum(node[k] * y[k] for k in range(n)) + sum(moves[steps[k]][y[k - 1]][y[k]] for k in range(1, n)) for y in product((0, 1), repeat=n)}


def test_field_against_enumeration():
    rng = np.random.default_rng(3)
    for n in (1, 2, 5):
        node, steps, moves = rng.normal(size=n), rng.integers(0, 6, n), rng.normal(size=(6, 2, 2))
        every = brute(node, steps, moves)
        z = sum(np.exp(x) for x in every.values())
        padded = np.zeros((1, 7, 2))
        padded[0, :n, 1] = node
        kinds, mask = np.zeros((1, 7), np.int64), np.zeros((1, 7), bool)
        kinds[0, :n], mask[0, :n] = steps, True
        single, pairs = extraction.likelihood(padded, kinds, mask, moves)
        for k in range(n):
            assert np.isclose(single[0, k], sum(np.exp(x) for y, x in every.items() if y[k]) / z)
        for k in range(n - 1):
            assert np.isclose(pairs[0, k, 0, 1], sum(np.exp(x) for y, x in every.items() if (y[k], y[k + 1]) == (0, 1)) / z)
        assert single[0, n:].sum() == 0 and pairs[0, max(n - 1, 0) :].sum() == 0


def test_viterbi_against_enumeration(model):
    own = extraction.Extractor(model)
    for page in labelled_pages.compose(40, seed=8):
        blocks = own.reader.blocks(page)[:9]
        titles, flags = extraction.seen_titles(blocks), extraction.on_page(blocks)
        node = [own.node(*b, t, flags) for b, t in zip(blocks, titles)]
        steps = [0] + [extraction.step_kind(a[1], b[1]) for a, b in zip(blocks, blocks[1:])]
        every = brute(node, steps, own.moves)
        assert np.isclose(every[tuple(map(int, own.labels(blocks)))], max(every.values()))


def test_labelled_pages_held_out(model):
    own, right, n = extraction.Extractor(model), 0, 0
    for page in labelled_pages.compose(200, seed=9):
        blocks = own.reader.blocks(page)
        right += sum(bool(b[1].label) == y for b, y in zip(blocks, own.labels(blocks)))
        n += len(blocks)
    assert right / n > 0.985


LAYOUTS = [
    '<body><header><a href="/">Site</a></header><div class="cookie-notice"><p>We use cookies.</p><button>OK</button></div><main><h1>Title here</h1><p>First text.</p><p>Second, longer text of the article.</p></main><aside><h3>Related</h3><ul><li><a href="/a">Other story</a></ul></aside><section id="comments"><h2>Comments</h2><div class="comment"><p>I liked this article a lot, thank you.</p></div></section><footer>Copyright</footer>',
    '<div id="header"><h2>Site</h2></div><ul class="menu"><li><a href=/>Home</a><li><a href=/b>Blog</a></ul><div class="content"><h1>Title here</h1><p>First text.</p><div class="ad">Buy now, a very good offer.</div><p>Second, longer text of the article.</p><form><label>Email</label><button>Send</button></form></div><div class="sidebar"><p>Most read of all pages today.</p></div><div id="footer">Imprint</div>',
]


def test_layouts(model):
    own = extraction.Extractor(model)
    for page in LAYOUTS:
        assert own.text(page) == "Title here\nFirst text.\nSecond, longer text of the article."


class Article(HTMLParser):
    """Text of the article element of the given pages, another way."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.blocks = False, [""]

    def handle_starttag(self, tag, attrs):
        self.inside |= tag == "article"
        if tag in ("p", "h1"):
            self.blocks.append("")
        elif tag == "br":
            self.handle_data(" ")

    def handle_endtag(self, tag):
        self.inside &= tag != "article"
        if tag in ("p", "h1"):
            self.blocks.append("")

    def handle_data(self, data):
        if self.inside:
            self.blocks[-1] += data


def test_given_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r for r in extraction.extract(pages).collect()}
    assert len(got) == pages.count()
    for r in pages.collect():
        parser = Article()
        parser.feed(r.html)
        parser.close()
        want = "\n".join(x for x in (" ".join(b.split()) for b in parser.blocks) if x)
        assert (got[r.page_id].text, got[r.page_id].n_chars, got[r.page_id].url) == (want, len(want), r.url)


def test_odd_rows(spark):
    rows = [(1, "u", LAYOUTS[0], "x"), (1, "u", LAYOUTS[0], "x"), (2, None, None, "x"), (3, "v", "", "x"), (None, "w", "<nav><a href=/>Home</a></nav>", "x")]
    labelled = spark.createDataFrame([(x,) for x in labelled_pages.compose(60)] + [(None,)], "html string")
    got = extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string"), labelled).collect()
    assert sorted((r.page_id or 0, r.n_chars > 0) for r in got) == [(0, False), (1, True), (1, True), (2, False), (3, False)]
    assert got[0].text == got[1].text and all(r.n_chars == len(r.text) for r in got)
    assert extraction.extract(spark.createDataFrame([], "page_id long, url string, html string"), labelled).count() == 0
    # no labelled page: nothing is known, nothing is taken
    assert extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string"), labelled.limit(0)).count() == 5
