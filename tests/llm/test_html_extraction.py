import itertools
import random
import re

import numpy as np
import pytest

from corpus_engine.llm import html_extraction as H

PAGES = {
    "landmarks": (
        '<body><div class=sidebar><p>x y</p></div><main><h1>T &lt;b&gt;</h1><p>one<p>two <a href="a>b">link</a>'
        " &nbsp; end<br>of\nit<div class='comments'><p>c1</p></div></main><form><p>f</p></form><p>Cookie notice</p>",
        "T <b>\none\ntwo link end of it",
    ),
    "names": (
        '<div id="header"><h1>Site</h1></div><div class="post"><h2>Hi</h2><p>A long text, with <b>bold</b>words.</p>'
        "<ul><li>a<li>b</ul></div><div class='ad-box'>buy</div><footer>x</footer>",
        "Hi\nA long text, with boldwords.\na\nb",
    ),
    "scripts": ('<article><script>var t="</p>";</script><p>a<style>p{}</style>b<!-- <p>no -->c</article>', "abc"),
    "article header": ("<header>Top</header><article><header><h1>Title</h1></header><p>x</p></article>", "Title\nx"),
    "comment articles": ("<main><p>x</p><article class=comment-1><p>y</p></article></main>", "x"),
    "unclosed": ("<nav><ul><li>m</ul></nav><article><p><b>head<br><p>body", "head\nbody"),
    "unquoted slash": ("<article><script src=/a/>var x = 1;</script><p>one</article>", "one"),
    "formula": ("<article><p>so <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds</article>", "so x=1 holds"),
    "name of another thing": (
        "<div class=post><h2>On clubs</h2><div class=social-history><p>They met often, as the letters show, and for a "
        "long time nobody asked why; then all was told.</p></div><p>More of it, then.</p></div><div class=social>f t</div>",
        "On clubs\nThey met often, as the letters show, and for a long time nobody asked why; then all was told.\n"
        "More of it, then.",
    ),
    "long comment": (
        "<main><p>The text, such as it is, of the page.</p><div class='comment-list'><p>I liked it, all of it, and most "
        "of all the part in which nothing happens; more, please.</p></div></main>",
        "The text, such as it is, of the page.",
    ),
    "empty": ("", ""),
    "null": (None, ""),
}


@pytest.mark.parametrize("name", PAGES)
def test_pages(name):
    page, want = PAGES[name]
    assert H.main_text(page) == want


def test_minimum_cut_is_minimal():
    rng = random.Random(5)
    for _ in range(60):
        n = rng.randint(1, 6)
        edges = [(a, b, rng.randint(0, 4), rng.randint(0, 4)) for a, b in itertools.combinations(range(n + 2), 2)]
        net = H.Network(n + 2)
        for a, b, forth, back in edges:
            net.add(a, b, forth, back)

        def cost(side):
            return sum(f * (side[a] and not side[b]) + k * (side[b] and not side[a]) for a, b, f, k in edges)

        got = net.source_side(n, n + 1)
        assert got[n] and not got[n + 1]
        best = min(cost([*bits, True, False]) for bits in itertools.product([True, False], repeat=n))
        assert cost(got) == best


def test_long_page_and_table(spark):
    body = "<p>word, word.</p>" * 3000
    rows = [(1, "u", f"<nav>m</nav><article>{body}</article>", "t"), (None, None, None, None), (1, "u", "", "t")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = H.extract(pages, H.fit(pages)).collect()
    assert sorted(len(r.text) for r in got) == [0, 0, 3000 * 12 - 1]
    assert H.extract(pages.limit(0), H.fit(pages.limit(0))).collect() == []


def test_driver_pages(spark):
    """Held against the article element, cut by regular expressions."""
    import html

    from corpus_engine.llm.queries import op10_html_extraction

    d = "/root/testdata/sf0.001"
    got = {r.page_id: r for r in op10_html_extraction(spark, d).collect()}
    pages = spark.read.parquet(f"{d}/pages.parquet").collect()
    assert len(got) == len(pages)
    for p in pages:
        article = re.sub("<br>|</?b>", " ", re.search(r"<article>(.*?)</article>", p.html, re.S)[1])
        parts = (" ".join(html.unescape(x).split()) for x in re.split(r"</?(?:p|h1)>", article))
        want = "\n".join(x for x in parts if x)
        assert got[p.page_id].text == want and got[p.page_id].n_chars == len(want)


def bare(page):
    """A page without names, and with a div for its article, navigation and footer."""
    page = re.sub(r'\s(?:class|id)="[^"]*"', "", page)
    return re.sub(r"<(/?)(?:article|nav|footer)>", r"<\1div>", page)


def test_pages_without_marks(spark):
    """Shapes learned from marked pages find the article in others; the cut decides what they leave open."""
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect()]
    weights = H.fit_weights([H.blocks(p) for p in pages[::2]])
    changed = 0
    for page in pages[1::2]:
        found = H.blocks(bare(page))
        assert all(b.around.landmark == b.around.name == 0 for b in found)
        assert H.main_text(bare(page), weights) == H.main_text(page, weights)
        changed += sum(a != (b > 0) for a, b in zip(H.labels(found, weights), H.prices(found, weights)))
    assert changed > 0


def test_cut_changes_blocks():
    """A short line among paragraphs is boilerplate by itself and content by its neighbours."""
    text = "A line that goes on for a while, with a comma, and that then ends after some more words."
    found = H.blocks(f"<div><p>{text}</p><p>Yes</p><p>{text}</p></div>")
    assert H.prices(found, H.PLAIN)[1] < 0 and H.labels(found, H.PLAIN) == [True, True, True]


def test_misleading_names(spark):
    """Names that say the opposite on every page give way to what the pages mark."""
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("html").collect()]
    wrong = [p.replace("<article>", '<article class="sidebar-left">').replace('class="ad"', 'class="story"') for p in pages]
    weights = H.fit_weights([H.blocks(p) for p in wrong])
    plain = H.fit_weights([H.blocks(p) for p in pages])
    assert [H.main_text(p, weights) for p in wrong] == [H.main_text(p, plain) for p in pages]


def test_weights_without_examples():
    assert np.array_equal(H.fit_weights([]), H.PLAIN)
