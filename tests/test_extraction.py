import json

import pandas as pd
from pyspark.sql import functions as F

from corpus_engine.functions import markup as M
from corpus_engine.functions import urls as U
from corpus_engine.operators import extraction as E

PAGE = """<!DOCTYPE html><html lang="en-GB"><head><title>Plain &amp; simple</title>
<meta content="Shared title" property="og:title"><meta name="description" content="What it is">
<meta property="og:site_name" content="First"><meta property="og:site_name" content="Second">
<link rel="canonical" href="https://a.com/c">
<script type="application/ld+json">[{"@type":"Organization","name":"Acme","telephone":"1",
"address":{"streetAddress":"1 Way","addressLocality":"","postalCode":"99"}},
{"@type":"Product","name":"Box","offers":{"price":5,"priceCurrency":"EUR"}}]</script>
<script type="application/ld+json">{broken</script>
<script type="application/ld+json">{"@type":"FAQPage","mainEntity":[{"@type":"Question","name":"Why?",
"acceptedAnswer":{"text":"Because."}}]}</script></head>
<body><nav><a href="/x">Call 555-123-4567</a></nav><div class="big ad">Buy</div>
<main><h1>Head</h1><p>One <b>two</b><div>inner</div></p><ul><li>a<ul><li>b</li></ul></li></ul>
<table><tr><th>k|v</th><th>n</th></tr><tr><td>1</td></tr></table><p>Same</p><p>Same</p>
<img alt="A nice long picture" src="p.png"><img alt="no"></main>
<footer>mail me@a.com or me@a.com</footer></body></html>"""


def test_extract_page(spark):
    df = spark.createDataFrame([(1, "https://a.com/d/e.html", PAGE)], "page_id bigint, url string, html string")
    r = E.extract_pages(df).first()
    assert (r.title, r.description, r.canonical, r.language) == ("Shared title", "What it is", "https://a.com/c", "en")
    assert r.contacts == ["Phone: 555-123-4567", "Email: me@a.com"]
    assert r.main_text.split("\n") == [
        "## Head", "", "One two", "- a", "- b", "", "| k\\|v | n |", "| --- | --- |", "| 1 |  |", "",
        "Same", "[Image: A nice long picture]",
    ]
    assert r.page_text.startswith("Phone: 555-123-4567\nEmail: me@a.com\n\n## Head")


def test_structured_data(spark):
    df = spark.createDataFrame([(1, PAGE)], "page_id bigint, html string")
    r = E.structured_data(df).first()
    assert [json.loads(o)["@type"] for o in r.json_ld] == ["Organization", "Product", "FAQPage"]
    assert r.open_graph == {"title": "Shared title", "site_name": "Second"}
    assert r.company.company_name == "Acme" and r.company.address == "1 Way, 99" and r.company.email is None
    assert r.text == (
        "Company: Acme\nDescription: What it is\nPhone: 1\nAddress: 1 Way, 99\n\nProduct: Box\nPrice: EUR5\n"
        "\nFrequently Asked Questions:\nQ: Why?\nA: Because."
    )


def test_links_and_spa(spark):
    cases = [
        ("/a", "https://b.com/a"), ("c", "https://b.com/x/c"), ("../c?q=1#f", "https://b.com/c?q=1#f"),
        ("?k", "https://b.com/x/y?k"), ("#f", "https://b.com/x/y#f"), ("//O.com", "https://o.com/"),
        ("mailto:a@b.c", "mailto:a@b.c"), ("http://[bad", None), ("", None), ("/é b", "https://b.com/%C3%A9%20b"),
    ]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, h string")
    got = df.select("i", U.resolve_link(F.col("h"), F.lit("https://b.com/x/y")).alias("u")).orderBy("i").collect()
    assert [r.u for r in got] == [c[1] for c in cases]
    shell = '<html><body class="x"><div id="root"></div><script>var a = "long text";</script></body></html>'
    full = f'<html><body><div id="root">{"word " * 80}</div></body></html>'
    pages = spark.createDataFrame([(shell,), (full,), ("<p>",)], "h string")
    assert [r[0] for r in pages.select(M.likely_spa(F.col("h"))).collect()] == [True, False, False]


def test_normalize_url(spark):
    cases = [
        ("http://Ex.com:80/a/?utm_source=x&b=1&utm_term=#f", "http://ex.com/a/?b=1"),
        ("ex.com/", "https://ex.com"), ("https://ex.com/?utm_medium=1", "https://ex.com"),
        ("not a url", "not a url"), ("https://ex.com/a//", "https://ex.com/a/"), ("https://ex.com/?x", "https://ex.com/?x="),
    ]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, u string")
    got = df.select("i", U.normalize_url(F.col("u")).alias("u")).orderBy("i").collect()
    assert [r.u for r in got] == [c[1] for c in cases]
    bad = ["http://localhost/", "https://10.1.1.1", "https://172.20.0.1", "https://x.local", "https://[::1]/"]
    df = spark.createDataFrame([(u,) for u in [*bad, "a.com", "https://172.32.0.1"]], "u string")
    assert [r[0] for r in df.select(U.is_valid_url(F.col("u"))).collect()] == [False] * 5 + [True] * 2


def test_links_of_ordinary_html(spark):
    html = """<a href=/x>1</a><!-- <a href="/c">no</a> --><script>var s = '<a href="/s">';</script>
      <a title="a>b" href="/q">2</a><a data-href="/d" title=" href='/t'" href='/r'>3</a><A HREF = "/u?a=1&amp;b=2">4</a><abbr href="/v">5</abbr>"""
    pages = spark.createDataFrame([("https://a.com/p", html)], "url string, html string")
    got = [r.dst_url for r in E.extract_links(pages).orderBy("pos").collect()]
    assert got == [f"https://a.com{p}" for p in ("/x", "/q", "/r", "/u?a=1&b=2")]


def test_phones_by_kind_of_frame():
    parts = E.page_parts("<header>555-0101</header><footer>555-0102</footer><nav>555-0103</nav>")
    assert parts["frame_text"].split() == ["555-0103", "555-0102", "555-0101"]


def test_references_are_decoded_everywhere(spark):
    html = """<html lang=de-AT><title>Caf&eacute; &#8217;s &#x26; more</title><meta property=og:site_name content="A&#38;B &eacute;">
      <textarea><a href="/no">x</a> &lt;b&gt;</textarea><script src=/a/>var s = "<a href='/s'>";</script>
      <a href="/x?a=1&#38;b=2">one</a><p>1 &hellip; 2 &notin; 3</p>"""
    pages = spark.createDataFrame([(1, "https://a.com/p", html), (2, "https://a.com/q", None)], "page_id bigint, url string, html string")
    got = {r.page_id: r for r in E.extract_pages(pages).collect()}
    assert (got[1].title, got[1].language) == ("Café ’s & more", "de")
    assert got[1].main_text == "1 … 2 ∉ 3" and got[2].main_text == got[2].title == ""
    assert E.structured_data(pages).filter("page_id = 1").first().open_graph == {"site_name": "A&B é"}
    assert [r.dst_url for r in E.extract_links(pages).collect()] == ["https://a.com/x?a=1&b=2"]
    assert E.page_parts("<textarea><a href='/no'>x</a></textarea>")["body_text"] == "<a href='/no'>x</a>"


def test_typed_parts():
    parts = E.page_parts(PAGE)
    assert parts["tables"] == ["| k\\|v | n |\n| --- | --- |\n| 1 |  |"]
    assert parts["images"] == ["[Image: A nice long picture]"]
    assert parts["links"] == ["/x"] and len(parts["scripts"]) == 3
    assert E.page_parts("")["links"] == [] and E.page_parts(None)["walked"] == ""


def test_parsed_parts_come_a_few_pages_at_a_time(spark):
    """However many pages a batch has, the parts of about a million characters are held; nulls and order stay."""
    html = [None, "", *(f"<p>{i} {'x' * 99_990}</p>" for i in range(40)), "<p>last</p>"]
    frames = list(E.parse_frame(pd.DataFrame({"page_id": range(len(html)), "html": pd.Series(html, dtype=object)})))
    assert 4 <= len(frames) <= 6 and max(map(len, frames)) <= 13
    whole = pd.concat(frames)
    assert list(whole["page_id"]) == list(range(len(html)))
    assert list(whole["walked"]) == [E.page_parts(h)["walked"] for h in html]
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    E.parse_pages(spark.createDataFrame([(1, "<p>a</p>")], "page_id int, html string"))
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "8m"
