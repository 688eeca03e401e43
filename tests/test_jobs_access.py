from pyspark.sql import functions as F

from corpus_engine.operators import access as A
from corpus_engine.operators import graph as G
from corpus_engine.operators import incremental as I
from corpus_engine.operators import jobs as J



def now():
    return F.lit("2024-06-01 12:00:00").cast("timestamp")


def test_due_and_edited_policies(spark):
    policies = spark.sql(
        "SELECT * FROM VALUES (1, true, 6, timestamp'2024-06-01 12:00:00'), (2, true, 6, timestamp'2024-06-02'), "
        "(3, false, 6, timestamp'2024-05-01'), (4, true, 6, timestamp'2024-05-01'), (5, true, 6, timestamp'2024-05-01') "
        "t(agent_id, enabled, frequency_hours, next_run_at)"
    )
    sites = spark.sql("SELECT * FROM VALUES (1, 'ready'), (2, 'ready'), (3, 'ready'), (4, 'crawling') t(agent_id, status)")
    sites = sites.withColumn("root_url", F.lit("u")).withColumn("user_id", F.lit(9))
    (due,) = J.due_recrawls(policies, sites, now()).collect()
    assert (due.agent_id, str(due.next_run_at)) == (1, "2024-06-01 18:00:00")
    changes = spark.sql("SELECT * FROM VALUES (1, false, 5), (9, true, 0), (8, NULL, NULL) t(agent_id, enabled, frequency_hours)")
    rows = {r.agent_id: r for r in J.upsert_policy(policies, changes, now()).collect()}
    assert rows[1].next_run_at is None and not rows[1].enabled
    assert (rows[9].frequency_hours, str(rows[9].next_run_at)) == (24, "2024-06-02 12:00:00")
    assert rows[8].enabled and rows[8].next_run_at is None and rows[2].frequency_hours == 6


def test_eval_scores(spark):
    cases = spark.sql(
        "SELECT 1 case_id, 'q' question, array('Blue', 'red') expected_answer_contains, 0.5D expected_min_confidence, true expected_sources_only "
        "UNION ALL SELECT 2, 'q', NULL, NULL, NULL"
    )
    answers = spark.sql("SELECT 1 case_id, 'It is BLUE' answer, 0.25D confidence, false sources_only")
    rows = {r.case_id: r for r in J.score_evals(cases, answers).collect()}
    assert rows[1].failures == [
        'Answer missing expected keyword: "red"', "Confidence 0.25 below minimum 0.5", "Answer used general knowledge instead of sources only",
    ]
    assert rows[2].passed and rows[2].answer == ""
    manual = {r.case_id: r for r in J.score_evals(cases, answers, nightly=False).collect()}
    assert manual[1].failures == ['Missing keyword: "red"', "Low confidence: 0.25"]
    data = spark.createDataFrame([(1, '[{"question":"a"},{"x":1},{"question":"b","expected_answer_contains":["k"]}]'), (2, "bad")], "agent_id int, eval_dataset string")
    assert [(r.case_no, r.question) for r in J.explode_eval_dataset(data).collect()] == [(0, "a"), (2, "b")]


def test_share_links(spark):
    links = spark.sql(
        "SELECT * FROM VALUES (1, 1, 'ok', timestamp'2024-07-01', 5, 4, NULL), (2, 1, 'old', timestamp'2024-05-01', NULL, 0, NULL), "
        "(3, 1, 'used', NULL, 5, 5, NULL), (4, 1, 'gone', NULL, NULL, 0, timestamp'2024-01-01'), (5, 2, 'free', NULL, 0, 99, NULL) "
        "t(link_id, agent_id, token, expires_at, max_uses, use_count, revoked_at)"
    )
    requests = spark.createDataFrame(
        [(1, 1, "ok", "s"), (2, 1, "old", "s"), (3, 1, "used", "s"), (4, 1, "gone", "s"), (5, 2, "free", "s"), (6, 2, "ok", "s"),
         (7, 3, None, "s"), (8, 3, None, "t"), (9, 4, None, "s")],
        "request_id int, agent_id int, token string, session_id string",
    )
    assert sorted(r.request_id for r in A.valid_share_links(links, requests, now()).collect()) == [1, 5]
    sites = spark.createDataFrame([(1, "private"), (2, "passcode"), (3, "passcode"), (4, "public")], "agent_id int, visibility string")
    sessions = spark.createDataFrame([(3, "s")], "agent_id int, session_id string")
    got = {r.request_id: r.allowed for r in A.accessible_sites(requests, sites, links, sessions, now()).collect()}
    assert [k for k, v in sorted(got.items()) if v] == [1, 5, 7, 9]


def test_crawl_order_depth_and_cap(spark):
    edges = spark.createDataFrame(
        [("https://a.com", 0, "https://a.com/1"), ("https://a.com", 1, "https://a.com/2"), ("https://a.com/1", 0, "https://a.com/3"),
         ("https://a.com/2", 0, "https://a.com/4"), ("https://a.com/3", 0, "https://a.com/5"), ("https://a.com/2", 1, "https://b.com/x"),
         ("https://a.com/4", 0, "https://a.com/"), ("https://a.com/2", 2, "https://a.com/login")],
        "src_url string, pos int, dst_url string",
    )
    seeds = spark.createDataFrame([("a", "https://a.com/", "https://a.com/", 0)], "site string, root_url string, url string, pos int")

    def run(**kw):
        return {r.url[13:]: r.depth for r in G.crawl_order(edges, seeds, **kw).collect()}

    assert run(max_depth=2) == {"": 0, "/1": 1, "/2": 1, "/3": 2, "/4": 2}
    assert run(max_depth=9) == {"": 0, "/1": 1, "/2": 1, "/3": 2, "/4": 2, "/5": 3}
    assert run(max_depth=9, max_pages=4) == {"": 0, "/1": 1, "/2": 1, "/3": 2}
    assert run(max_depth=9, exclude=["/1"]) == {"": 0, "/2": 1, "/4": 2}


def test_line_diff_and_chunk_diff(spark):
    pages = spark.createDataFrame([(1, "a\nb\n\nd", "a\nx"), (2, "n", None)], "page_id int, clean_markdown string, previous_markdown string")
    rows = {r.page_id: r for r in I.page_line_diff(pages).collect()}
    assert [tuple(e) for e in rows[1]["diff"]] == [("unchanged", "a"), ("removed", "x"), ("added", "b"), ("added", "d")]
    assert (rows[2].has_previous, rows[2].added) == (False, 1)
    old = spark.createDataFrame([("o1", 1, 0, "h"), ("o2", 1, 1, "h"), ("o3", 1, 2, "z"), ("o4", 2, 0, "k"), ("o5", 3, 0, "k")],
                                "chunk_id string, page_id int, chunk_index int, content_hash string")
    new = spark.createDataFrame([(1, 5, "h"), (1, 6, "n")], "page_id int, chunk_index int, content_hash string")
    crawled = spark.createDataFrame([(1,), (2,)], "page_id int")
    got = sorted((r.change, r.chunk_id or "", r.chunk_index) for r in I.diff_chunks(new, old, crawled).collect())
    assert got == [("added", "", 6), ("removed", "o1", 0), ("removed", "o3", 2), ("removed", "o4", 0), ("unchanged", "o2", 1)]


def test_blocked_urls_are_found_once(spark):
    asked = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            asked.add(len(batch))
            yield batch

    url = "https://a.org/{}".format
    edges = spark.createDataFrame([(url(i), 0, url(i + 1)) for i in range(1, 6)], "src_url string, pos int, dst_url string")
    seeds = spark.createDataFrame([("a.org", url(""), url(1), 0)], "site string, root_url string, url string, pos int")
    blocked = spark.createDataFrame([(url(4),), (url(4),), (None,)], "url string").mapInPandas(counted, "url string")
    found = G.crawl_order(edges, seeds, blocked=blocked).collect()
    assert sorted(r.url for r in found) == [url(1), url(2), url(3)]
    assert asked.value == 3
