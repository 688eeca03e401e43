import gc
import hashlib
import re
import time

from pyspark.sql import functions as F

from corpus_engine.functions.text import parse_structured_answer
from corpus_engine.registry import stream_queries
from corpus_engine.sources import pdf, robots, sinks, sitemaps, transcripts


def test_sitemaps(spark):
    df = spark.createDataFrame(
        [
            ("https://a.com/sitemap.xml", "<urlset><LOC> https://a.com/1 </LOC><loc>https://a.com/sitemap-2.xml</loc></urlset>"),
            ("https://a.com/sitemap-2.xml", "<loc>https://a.com/2</loc><loc>https://a.com/sitemap-3.xml</loc>"),
            ("https://a.com/list.txt", " https://a.com/3\nnothing\nhttp://a.com/4"),
        ],
        "sitemap_url string, body string",
    )
    top = spark.createDataFrame([("https://a.com/sitemap.xml",), ("https://a.com/list.txt",)], "sitemap_url string")
    urls = sorted(r.loc for r in sitemaps.sitemap_urls(df, top).collect())
    assert urls == ["http://a.com/4", "https://a.com/1", "https://a.com/2", "https://a.com/3", "https://a.com/sitemap-3.xml"]


def test_robots(spark):
    body = (
        "User-agent: one\nUser-agent: Two # both\nDisallow: /a\nAllow: /a/b\nCrawl-delay: 3\n\n"
        "User-agent: *\nDisallow: /*.gif$\nDisallow:\nSitemap: https://h.com/s.xml"
    )
    rules = robots.parse_robots(spark.createDataFrame([("h.com", body)], "host string, body string"))
    assert rules.filter("rule = 'sitemap'").first().value == "https://h.com/s.xml"
    urls = ["https://h.com/a", "https://h.com/a/b/c", "https://h.com/x.gif", "https://h.com/x.gif?q", "https://other.com/a"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, url string")

    def allowed(agent):
        return [r.allowed for r in robots.robots_filter(df, rules, agent).orderBy("i").collect()]

    assert allowed("TWO") == [False, True, True, True, True]
    assert allowed("three") == [True, True, False, True, True]
    checks = spark.createDataFrame([("Disallow: /",), ("disallow: /x",), (None,), ("a\nDISALLOW:/ \nb",)], "b string")
    assert [r[0] for r in checks.select(robots.crawl_allowed(F.col("b"))).collect()] == [False, True, True, False]


def test_pdf(spark, tmp_path):
    raw = b"%PDF\n(Hello\\n\\\\you) Tj\n(Hello\\n\\\\you)Tj\n\xff\xfe\nA readable run of more than twenty signs\n<< /Type /Page and some more >>"
    (tmp_path / "a.pdf").write_bytes(raw)
    (tmp_path / "b.pdf").write_bytes(b"\x00\x01")
    rows = {r.path[-5:]: r.text for r in pdf.pdf_text(spark, str(tmp_path)).collect()}
    assert rows["a.pdf"].startswith("Hello\n\\you\n")
    assert "A readable run of more than twenty signs" in rows["a.pdf"] and "/Type" not in rows["a.pdf"]
    assert rows["b.pdf"] == pdf.PLACEHOLDER
    cut = {r.path[-5:]: (r.text, r.skipped) for r in pdf.pdf_text(spark, str(tmp_path), size_limit=10).collect()}
    assert cut["a.pdf"] == (None, "too large") and cut["b.pdf"] == (pdf.PLACEHOLDER, None)


def test_pdf_query_reads_a_file_of_each_row(spark, tmp_path, monkeypatch):
    """Equal, negative and null ids, null texts; files spread over several folders, none for a single file."""
    monkeypatch.setattr(stream_queries, "FILES_LISTED", 20)
    rows = [(i, f"text {i} with (some) signs of its own") for i in range(60)] + [(3, "other text of id three, some signs")] * 3
    rows += [(None, "a text without an id of any kind"), (-4, None), (5, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    folders = []
    monkeypatch.setattr(stream_queries, "scratch_path", lambda spark, name: folders.append(f"{tmp_path}/{name}") or folders[-1])
    got = [tuple(r) for r in stream_queries.pdf_text(spark, str(tmp_path)).collect()]
    assert len(got) == len(rows) and sum(i is None for i, _ in got) == 1
    empty = hashlib.md5(pdf.PLACEHOLDER.encode()).hexdigest()
    assert dict(got)[-4] == empty and len({d for _, d in got}) == 63
    files = [p for p in (tmp_path / "pdf").rglob("*") if p.is_file()]
    assert len(files) == len(rows) and len({p.parent for p in files}) < 20 and len(list((tmp_path / "pdf").iterdir())) > 1


def _listed_files(spark) -> int:
    """File entries that the driver's JVM holds."""
    gc.collect()
    jvm, array = spark._jvm, spark.sparkContext._gateway.new_array
    kind = jvm.java.lang.Class.forName
    types = ["javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;"]
    signature, values, names, given = (
        array(jvm.java.lang.Class, 4), array(jvm.java.lang.Object, 4), array(jvm.java.lang.String, 1), array(jvm.java.lang.Object, 1),
    )
    names[0], given[0] = "[Ljava.lang.String;", array(jvm.java.lang.String, 0)
    command = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
    for i, value in enumerate([command, "gcClassHistogram", given, names]):
        signature[i], values[i] = kind(types[i]), value
    server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
    said = kind("javax.management.MBeanServer").getMethod("invoke", signature).invoke(server, values)
    found = re.search(r"(\d+) +\d+ +org\.apache\.hadoop\.fs\.LocatedFileStatus\b", said)
    return int(found[1]) if found else 0


def test_pdf_query_leaves_no_list_and_few_tasks_with_the_driver(spark, tmp_path, monkeypatch):
    """The driver's memory does not grow with the files: it forgets each folder, and a task reads many files."""
    monkeypatch.setattr(stream_queries, "FILES_LISTED", 400)
    monkeypatch.setattr(stream_queries, "scratch_path", lambda spark, name: f"{tmp_path}/{name}")
    rows = [(i, f"text {i} with (some) signs of its own") for i in range(700)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    names = ["spark.sql.files.maxPartitionNum", "spark.sql.hive.filesourcePartitionFileCacheSize"]
    settings = [spark.conf.get(name, None) for name in names]
    before = _listed_files(spark)
    got = stream_queries.pdf_text(spark, str(tmp_path))
    until = time.time() + 20  # the JVM hears a little later of what Python has dropped
    while (held := _listed_files(spark) - before) >= 100 and time.time() < until:
        time.sleep(0.5)
    assert held < 100
    assert len(list((tmp_path / "texts").rglob("part-*.parquet"))) <= 2 * 5
    assert sorted(r.doc_id for r in got.collect()) == list(range(700))
    assert [spark.conf.get(name, None) for name in names] == settings


def test_pdf_query_of_no_documents(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stream_queries, "scratch_path", lambda spark, name: f"{tmp_path}/{name}")
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert stream_queries.pdf_text(spark, str(tmp_path)).collect() == []


def test_sse(spark):
    bodies = [
        ("a", 'data: {"type":"text","content":"x"}\n\ndata: {bad\ndata: {"type":"text","content":"y"}\n'
              'data: {"type":"sources","confidence":0.8,"answered_from_sources_only":false}\ndata: [DONE]'),
        ("b", 'data: {"type":"sources","confidence":null}'),
        ("c", "nothing"),
    ]
    rows = transcripts.parse_sse(spark.createDataFrame(bodies, "id string, body string")).orderBy("id").collect()
    assert [tuple(r) for r in rows] == [("a", "xy", 0.8, False), ("b", "", 0.0, True), ("c", "", 0.0, True)]


def test_structured_answer(spark):
    raw = ['{"answer":"x","confidence":0.9,"citations":[{"url":"u"}]}', "plain", '{"confidence":"high"}', "[1]"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(raw)], "i int, t string")
    rows = df.orderBy("i").select(parse_structured_answer(F.col("t")).alias("a")).select("a.*").collect()
    assert [(r.answer, r.confidence, len(r.citations)) for r in rows] == [("x", 0.9, 1), ("plain", 0.5, 0), ("", 0.5, 0), ("", 0.5, 0)]


def test_events_sink(spark, tmp_path):
    df = spark.sql(
        "SELECT bigint(id) event_id, bigint(1) agent_id, kind event_type, string(NULL) payload, timestamp'2024-01-02' created_at "
        "FROM VALUES (1, 'chat'), (2, 'nonsense'), (3, NULL) t(id, kind)"
    )
    for _ in range(2):
        sinks.append_events(df, str(tmp_path / "e"))
    rows = sinks.read_events(spark, str(tmp_path / "e")).collect()
    assert [(r.event_id, r.payload) for r in rows] == [(1, "{}"), (1, "{}")]


def test_words_and_shingles_of_odd_white_space(spark):
    from corpus_engine.functions import text as T

    rows = ["", " \t", "a", " A\n\tb  C ", "\x0bx\fy\r", " a b　", None, "\x1ca b\x85c d"]
    df = spark.createDataFrame([(t,) for t in rows], "t string")
    a, b = T.shingles(F.col("t"), 2), T.shingles(F.upper("t"), 2)
    got = df.select(T.words(F.col("t")).alias("w"), a.alias("s"), T.jaccard(a, b).alias("j")).collect()
    assert [r.w for r in got[:5]] == [[], [], ["a"], ["a", "b", "c"], ["x", "y"]]
    assert got[5].w == ["a", "b"] and got[6].w is None and got[6].j is None
    assert [r.s for r in got[:5]] == [[], [], [], ["a b", "b c"], ["x y"]]
    assert [r.j for r in got if r.w is not None] == [1.0] * 7
