"""Reports and listings.

Orders stand in for conversations (their priority for the site), line items for
messages, customers for sites, usage events for themselves (their user as site).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from corpus_engine.functions import urls as U
from corpus_engine.operators import analytics as A
from corpus_engine.operators import ranking as K
from corpus_engine.registry import query, sql
from corpus_engine.sources.tables import load_table

_DAYS = 400


def at(text):
    return F.lit(text).cast("timestamp")


def conversations(spark, d):
    return load_table(spark, d, "orders", ["o_orderkey", "o_custkey", "o_orderpriority", "o_orderdate"]).select(
        F.col("o_orderkey").alias("conversation_id"),
        F.col("o_orderpriority").alias("agent_id"),
        F.col("o_custkey").cast("string").alias("session_id"),
        F.col("o_orderdate").alias("created_at"),
    )


def messages(spark, d):
    flag = F.col("l_returnflag")
    return load_table(
        spark, d, "lineitem",
        ["l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_discount", "l_shipdate"],
    ).select(
        F.col("l_orderkey").alias("conversation_id"),
        F.when(flag == "A", "assistant").when(flag == "N", "user").otherwise("system").alias("role"),
        F.when(F.col("l_linestatus") == "F", F.col("l_discount") * 8).alias("confidence"),
        F.when(F.col("l_linenumber") > 1, F.concat(F.lit("m"), "l_linenumber")).alias("model_used"),
        F.col("l_shipdate").alias("created_at"),
    )


_CM = """
  conv AS (SELECT o_orderkey AS conversation_id, o_orderpriority AS agent_id, o_custkey AS session_id,
                  o_orderdate AS created_at FROM orders),
  msg AS (SELECT l_orderkey AS conversation_id, CASE l_returnflag WHEN 'A' THEN 'assistant' WHEN 'N' THEN 'user'
                 ELSE 'system' END AS role, CASE WHEN l_linestatus = 'F' THEN l_discount * 8 END AS confidence,
                 CASE WHEN l_linenumber > 1 THEN 'm' || l_linenumber END AS model_used,
                 l_shipdate AS created_at FROM lineitem),
  ms AS (SELECT msg.*, agent_id FROM msg JOIN conv USING (conversation_id))"""
_RECENT = f"created_at >= TIMESTAMP '2000-01-01' - INTERVAL {_DAYS} DAY"


@query(
    f"""WITH {_CM} SELECT c.agent_id, total_conversations, unique_sessions, total_messages,
          round(avg_confidence, 6) AS avg_confidence, low_confidence_count
        FROM (SELECT agent_id, count(DISTINCT conversation_id) AS total_conversations,
                count(DISTINCT session_id) AS unique_sessions FROM conv WHERE {_RECENT} GROUP BY agent_id) c
        JOIN (SELECT agent_id, count(*) AS total_messages, avg(confidence) AS avg_confidence,
                count(*) FILTER (WHERE confidence < 0.4) AS low_confidence_count
              FROM ms WHERE role = 'assistant' AND {_RECENT} GROUP BY agent_id) m ON c.agent_id = m.agent_id"""
)
def site_analytics(spark, d):
    stats = A.site_analytics(conversations(spark, d), messages(spark, d), at("2000-01-01"), _DAYS)
    return stats.withColumn("avg_confidence", F.round("avg_confidence", 6))


@query(
    f"""WITH {_CM} SELECT agent_id, string_agg(day || '=' || n, ',' ORDER BY day) AS days FROM (
          SELECT agent_id, CAST(CAST(created_at AS DATE) AS VARCHAR) AS day, count(*) AS n FROM ms
          WHERE {_RECENT} GROUP BY ALL) GROUP BY agent_id"""
)
def messages_by_day(spark, d):
    days = A.messages_by_day(conversations(spark, d), messages(spark, d), at("2000-01-01"), _DAYS)
    text = F.transform("messages_by_day", lambda x: F.concat_ws("=", x["date"].cast("string"), x["count"].cast("string")))
    return days.select("agent_id", F.array_join(text, ",").alias("days"))


@query(f"WITH {_CM} SELECT agent_id, role, count(*) AS messages FROM ms GROUP BY ALL")
def messages_with_site(spark, d):
    return (
        A.messages_with_site(messages(spark, d), conversations(spark, d))
        .groupBy("agent_id", "role")
        .agg(F.count("*").alias("messages"))
    )


def _usage(spark, d):
    return load_table(spark, d, "events", ["event_id", "ts", "user_id", "event_type"]).select(
        "event_id", F.col("user_id").alias("agent_id"), "event_type", F.col("ts").alias("created_at")
    )


@query(
    """SELECT user_id AS agent_id, event_type, count(*) AS events FROM (
         SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn
         FROM events WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 25 DAY) WHERE rn <= 40 GROUP BY ALL"""
)
def usage_summary(spark, d):
    return A.usage_summary(_usage(spark, d), at("2024-01-31"), 25, 40)


@query(
    """SELECT user_id AS agent_id, event_type, count(*) AS events FROM events
       WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 25 DAY GROUP BY ALL"""
)
def usage_totals(spark, d):
    return A.usage_summary(_usage(spark, d), at("2024-01-31"), 25)


@query(
    f"""WITH {_CM}, newest AS (SELECT * FROM conv QUALIFY row_number() OVER (PARTITION BY agent_id
          ORDER BY created_at DESC, conversation_id DESC) <= 10)
        SELECT n.agent_id, model_used, count(*) AS answers FROM newest n JOIN msg USING (conversation_id)
        WHERE role = 'assistant' AND model_used IS NOT NULL GROUP BY ALL"""
)
def model_usage(spark, d):
    return A.model_usage(messages(spark, d), conversations(spark, d))


@query(
    """SELECT coalesce(p.k, c.k) AS agent_id, coalesce(pages, 0) AS pages, coalesce(chunks, 0) AS chunks
       FROM (SELECT c_nationkey AS k, count(*) AS pages FROM customer GROUP BY 1) p
       FULL JOIN (SELECT s_nationkey AS k, count(*) AS chunks FROM supplier GROUP BY 1) c ON p.k = c.k"""
)
def site_stats(spark, d):
    pages = load_table(spark, d, "customer", ["c_nationkey"]).withColumnRenamed("c_nationkey", "agent_id")
    chunks = load_table(spark, d, "supplier", ["s_nationkey"]).withColumnRenamed("s_nationkey", "agent_id")
    return A.site_stats(pages, chunks)


def _crawled(spark, d):
    status = F.col("o_orderstatus")
    return load_table(spark, d, "orders").select(
        F.col("o_orderkey").alias("page_id"),
        F.col("o_custkey").alias("agent_id"),
        F.when(status == "F", "crawled").when(status == "P", "failed").otherwise("pending").alias("crawl_status"),
        F.when(F.col("o_orderpriority") < "3", F.col("o_orderpriority")).alias("previous_markdown"),
        F.col("o_orderdate").alias("last_crawled_at"),
        F.col("o_totalprice").alias("size"),
    )


@query(
    """SELECT o_custkey AS agent_id, count(*) AS total, count(*) FILTER (WHERE o_orderstatus = 'F') AS crawled,
         count(*) FILTER (WHERE o_orderstatus = 'P') AS failed FROM orders GROUP BY 1"""
)
def page_status_counts(spark, d):
    return A.page_status_counts(_crawled(spark, d))


@query(
    """SELECT o_custkey AS agent_id, count(CASE WHEN o_orderpriority < '3' THEN 1 END) AS changed_pages
       FROM orders GROUP BY 1"""
)
def changed_page_count(spark, d):
    return A.changed_page_count(_crawled(spark, d))


def sites(spark, d):
    kind = F.col("c_mktsegment")
    return load_table(spark, d, "customer").select(
        F.col("c_custkey").alias("agent_id"),
        F.col("c_nationkey").alias("user_id"),
        F.col("c_name").alias("name"),
        F.lower(F.concat(F.lit("https://"), kind, F.lit(".example.com"))).alias("root_url"),
        F.when(kind == "BUILDING", "ready").when(kind == "MACHINERY", "crawling").otherwise("draft").alias("status"),
        F.when(F.col("c_acctbal") > 0, F.floor("c_acctbal")).alias("crawled_pages"),
        F.when(kind.isin("BUILDING", "FURNITURE"), "public").otherwise("private").alias("visibility"),
        F.timestamp_seconds(F.col("c_custkey") % 1000).alias("created_at"),
    )


@query(
    """SELECT c_nationkey AS user_id, count(*) AS sites, count(*) FILTER (WHERE c_mktsegment = 'BUILDING') AS ready,
         count(*) FILTER (WHERE c_mktsegment = 'MACHINERY') AS active,
         CAST(sum(CASE WHEN c_acctbal > 0 THEN floor(c_acctbal) ELSE 0 END) AS BIGINT) AS indexed_pages
       FROM (SELECT * FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey
               ORDER BY c_custkey % 1000 DESC, c_custkey DESC) <= 6) GROUP BY 1"""
)
def dashboard_stats(spark, d):
    return A.dashboard_stats(sites(spark, d))


def _evals(spark, d):
    labels = load_table(spark, d, "labels")
    documents = load_table(spark, d, "documents", ["doc_id", "source"])
    return labels.join(documents, "doc_id").select(
        F.col("source").alias("run_id"),
        F.col("doc_id").cast("string").alias("question"),
        ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("passed"),
    )


_EVALS = """e AS (SELECT source AS run_id, CAST(doc_id AS VARCHAR) AS question, quality = 1 AND toxic = 0 AS passed
                  FROM labels JOIN documents USING (doc_id)),
  s AS (SELECT run_id, count(*) AS total, count(*) FILTER (WHERE passed) AS passed,
               count(*) FILTER (WHERE NOT passed) AS failed FROM e GROUP BY run_id)"""


@query(
    f"""WITH {_EVALS} SELECT *, round(failed / total, 6) AS failure_rate, failed / total > 0.3 AS warning FROM s"""
)
def eval_summary(spark, d):
    return A.eval_summary(_evals(spark, d)).withColumn("failure_rate", F.round("failure_rate", 6))


@query(
    f"""WITH {_EVALS} SELECT run_id, question FROM e WHERE NOT passed
        AND run_id IN (SELECT run_id FROM s WHERE failed / total > 0.3)"""
)
def failed_questions(spark, d):
    return A.failed_questions(_evals(spark, d))


def _counts(spark, d):
    jobs = load_table(spark, d, "orders", ["o_orderstatus"]).select(
        F.when(F.col("o_orderstatus") == "O", "running").otherwise("completed").alias("status")
    )
    usage = _usage(spark, d).withColumn(
        "event_type", F.when(F.col("event_type") == "click", "chat").otherwise(F.col("event_type"))
    )
    tables = [
        load_table(spark, d, name, [key])
        for name, key in (("conversations", "conv_id"), ("lineitem", "l_orderkey"), ("documents", "doc_id"), ("pages", "page_id"))
    ]
    return A.platform_counts(
        sites(spark, d), *tables, jobs, usage, at("2024-01-30 12:00:00")
    )


_COUNTS = """
  SELECT 0 AS position, 'platform_agents_total' AS metric, 'Total number of agents' AS h, count(*) AS value FROM customer
  UNION ALL SELECT 1, 'platform_agents_ready', 'Number of ready agents', count(*) FROM customer WHERE c_mktsegment = 'BUILDING'
  UNION ALL SELECT 2, 'platform_conversations_total', 'Total conversations', count(*) FROM conversations
  UNION ALL SELECT 3, 'platform_messages_total', 'Total messages', count(*) FROM lineitem
  UNION ALL SELECT 4, 'platform_chunks_total', 'Total indexed chunks', count(*) FROM documents
  UNION ALL SELECT 5, 'platform_pages_total', 'Total crawled pages', count(*) FROM pages
  UNION ALL SELECT 6, 'platform_crawl_jobs_active', 'Currently running crawl jobs', count(*) FROM orders WHERE o_orderstatus = 'O'
  UNION ALL SELECT 7, 'platform_chat_requests_1h', 'Chat requests in last hour', count(*) FROM events
    WHERE event_type = 'click' AND ts >= TIMESTAMP '2024-01-30 11:00:00'"""


@query(f"SELECT position, metric, value FROM ({_COUNTS})")
def platform_counts(spark, d):
    return _counts(spark, d)


@query(
    f"""SELECT CAST(position * 4 + part AS INT) AS line_no, CASE part WHEN 0 THEN '# HELP ' || metric || ' ' || h
          WHEN 1 THEN '# TYPE ' || metric || ' gauge' WHEN 2 THEN metric || ' ' || value ELSE '' END AS line
        FROM ({_COUNTS}), range(0, 4) t(part)"""
)
def metrics_exposition(spark, d):
    return A.metrics_exposition(_counts(spark, d))


@query(
    """SELECT o.k AS user_id, c_nationkey AS org_id, o.n AS sites, CAST(c_nationkey % 15 AS INT) AS quota_agents
       FROM (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1) o JOIN customer ON c_custkey = o.k
       WHERE c_nationkey % 15 > 0 AND o.n >= c_nationkey % 15"""
)
def quota_check(spark, d):
    owned = load_table(spark, d, "orders", ["o_custkey"]).select(F.col("o_custkey").alias("user_id"))
    members = load_table(spark, d, "customer", ["c_custkey", "c_nationkey"]).select(
        F.col("c_custkey").alias("user_id"), F.col("c_nationkey").alias("org_id")
    )
    orgs = load_table(spark, d, "nation", ["n_nationkey"]).select(
        F.col("n_nationkey").alias("org_id"), (F.col("n_nationkey") % 15).alias("quota_agents")
    )
    return A.quota_check(owned, members, orgs)


def _results(spark, d):
    flag, late = F.col("l_returnflag"), F.col("l_linestatus") == "O"
    reason = (
        F.when((flag == "N") & late, "not_modified")
        .when(flag == "N", "content_unchanged")
        .when((flag == "R") & late, "robots.txt")
    )
    return load_table(
        spark, d, "lineitem", ["l_suppkey", "l_returnflag", "l_linestatus", "l_quantity"]
    ).select(
        F.col("l_suppkey").alias("job_id"),
        reason.alias("skip_reason"),
        F.when(flag == "A", "crawled").when(reason == "robots.txt", "blocked").when(reason.isNotNull(), "skipped")
        .otherwise("failed").alias("crawl_status"),
        F.col("l_quantity").cast("bigint").alias("chunks"),
    )


@query(
    """SELECT l_suppkey AS job_id, count(*) FILTER (WHERE l_returnflag = 'A' OR (l_returnflag = 'R' AND l_linestatus = 'F')) AS total_pages,
         CAST(sum(CASE WHEN l_returnflag = 'A' THEN l_quantity ELSE 0 END) AS BIGINT) AS total_chunks,
         count(*) FILTER (WHERE l_returnflag = 'R' AND l_linestatus = 'F') AS errors,
         count(*) FILTER (WHERE l_returnflag = 'N' OR (l_returnflag = 'R' AND l_linestatus = 'O')) AS skipped,
         count(*) AS discovered FROM lineitem GROUP BY 1"""
)
def crawl_totals(spark, d):
    return A.crawl_totals(_results(spark, d))


@query(
    """SELECT skip_reason, CASE skip_reason WHEN 'robots.txt' THEN 'blocked' ELSE 'skipped' END AS crawl_status,
         count(*) AS pages FROM (SELECT CASE WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN 'not_modified'
           WHEN l_returnflag = 'N' THEN 'content_unchanged'
           WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN 'robots.txt' END AS skip_reason FROM lineitem)
       WHERE skip_reason IS NOT NULL GROUP BY 1, 2"""
)
def skip_reasons(spark, d):
    return A.skip_reasons(_results(spark, d))


@query(
    """WITH t AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rn FROM documents)
       SELECT source AS agent_id, md5(string_agg('--- Page: ' || CASE WHEN lang = 'de' THEN 'D' ELSE 'doc/' || lpad(CAST(doc_id AS VARCHAR), 9, '0') END
         || ' ---' || chr(10) || left(text, 1000), chr(10) || chr(10) ORDER BY rn)) AS digest
       FROM t WHERE rn <= 10 GROUP BY source"""
)
def sample_context(spark, d):
    return A.sample_context(_sample_pages(spark, d), "profile").select("agent_id", F.md5("context").alias("digest"))


def _sample_sql(text: str, glue: str) -> str:
    """Five pages per site by the time they were crawled, as the given template has them."""
    return f"""WITH t AS (SELECT *, 'doc/' || lpad(CAST(doc_id AS VARCHAR), 9, '0') AS url, CASE WHEN lang = 'de' THEN 'D' ELSE '' END AS title,
                 row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS rn FROM documents)
        SELECT source AS agent_id, md5(string_agg({text}, {glue} ORDER BY rn)) AS digest FROM t WHERE rn <= {{k}} GROUP BY source"""


_BREAK = "chr(10) || chr(10)"
_NAMED = "CASE WHEN title = '' THEN url ELSE title END"


@query(
    _sample_sql(
        f"'## Source ' || rn || chr(10) || 'URL: ' || url || chr(10) || 'Title: ' || {_NAMED} || chr(10) || left(text, {A.SAMPLES['extract'][1]})", _BREAK
    ).format(k=A.SAMPLES["extract"][0])
)
def sample_context_extract(spark, d):
    """The sample that facts are extracted from."""
    return A.sample_context(_sample_pages(spark, d), "extract").select("agent_id", F.md5("context").alias("digest"))


@query(
    _sample_sql(
        f"'# ' || CASE WHEN title = '' THEN 'Page' ELSE title END || chr(10) || left(text, {A.SAMPLES['starters'][1]})",
        f"{_BREAK} || '---' || {_BREAK}",
    ).format(k=A.SAMPLES["starters"][0])
)
def sample_context_starters(spark, d):
    """The sample that opening questions are made from."""
    return A.sample_context(_sample_pages(spark, d), "starters").select("agent_id", F.md5("context").alias("digest"))


def _sample_pages(spark, d):
    return load_table(spark, d, "documents").select(
        F.col("source").alias("agent_id"),
        F.concat(F.lit("doc/"), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("url"),
        F.when(F.col("lang") == "de", "D").otherwise("").alias("title"),
        F.col("text").alias("clean_markdown"),
        F.col("n_chars").alias("raw_html_length"),
        F.lit("crawled").alias("crawl_status"),
        F.timestamp_seconds("doc_id").alias("last_crawled_at"),
    )


@query(
    """SELECT o_orderkey AS page_id, total, CAST(ceil(total / 50.0) AS BIGINT) AS total_pages FROM (
         SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) AS rn, count(*) OVER () AS total
         FROM orders WHERE o_orderstatus = 'F') WHERE rn BETWEEN 101 AND 150"""
)
def paginate(spark, d):
    order = [F.col("last_crawled_at").desc(), F.col("page_id")]
    return K.paginate(_crawled(spark, d), order, 3, 50, F.col("crawl_status") == "crawled").select(
        "page_id", "total", "total_pages"
    )


@query(f"SELECT {sql.host('url')} AS agent_id, url FROM pages ORDER BY 1, 2")
def page_tree(spark, d):
    pages = load_table(spark, d, "pages", ["url"]).select(U.host(F.col("url")).alias("agent_id"), "url")
    return K.page_tree(pages)


@query(
    """SELECT o_custkey AS agent_id, o_orderkey AS page_id, CAST(rn AS INT) AS rn FROM (SELECT *, row_number() OVER
         (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn <= 10"""
)
def latest_per_site(spark, d):
    order = [F.col("last_crawled_at").desc(), F.col("page_id").desc()]
    return K.latest_per_site(_crawled(spark, d), 10, order).select("agent_id", "page_id", "rn")


_LINKS = f"""SELECT regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) || {sql.percent_encode('href')} AS url
  FROM (SELECT url, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM pages)"""


def page_links(spark, d):
    pages = load_table(spark, d, "pages", ["page_id", "url", "html"], spread=True)
    hrefs = pages.select("url", F.explode_outer(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'))).alias("href"))
    return hrefs.select(U.resolve_link(F.col("href"), F.col("url")).alias("url")).filter(F.col("url").isNotNull())


@query(
    f"""WITH n AS (SELECT DISTINCT {sql.normalize_url('url')} AS u FROM (SELECT url FROM pages UNION ALL {_LINKS})),
        s AS (SELECT DISTINCT {sql.host('url')} AS agent_id FROM pages),
        u AS (SELECT agent_id, 'https://' || agent_id AS u FROM s
              UNION SELECT {sql.host('u')}, u FROM n WHERE NOT regexp_matches(lower(u),
                '([.](docx?|xlsx?|pptx?|zip|tar|gz|rar|jpe?g|png|gif|svg|webp|ico|mp[34]|avi|mov|wmv|css|js|json|xml|rss))$|/(feed|rss|login|admin)'))
        SELECT agent_id, u AS url, count(*) OVER (PARTITION BY agent_id) AS discovered FROM u
        QUALIFY row_number() OVER (PARTITION BY agent_id ORDER BY u) <= 200"""
)
def site_url_map(spark, d):
    pages = load_table(spark, d, "pages", ["url"]).withColumn("agent_id", U.host(F.col("url")))
    sites = pages.select("agent_id", F.concat(F.lit("https://"), "agent_id", F.lit("/")).alias("root_url")).distinct()
    links = page_links(spark, d).withColumn("agent_id", U.host(F.col("url")))
    return K.site_url_map(sites, pages, links, 200)


@query(
    """SELECT c_custkey AS agent_id, c_name AS name FROM customer
       WHERE contains(lower(c_name), 'build') OR contains(lower(c_mktsegment), 'build')"""
)
def search_sites(spark, d):
    return K.search_sites(sites(spark, d), "BuilD").select("agent_id", "name")


_PAGE_SET = f"SELECT {sql.normalize_url('url')} AS url FROM pages"
_LINK_SET = f"SELECT {sql.normalize_url('url')} AS url FROM ({_LINKS})"


def _url_sets(spark, d):
    normal = U.normalize_url(F.col("url")).alias("url")
    return load_table(spark, d, "pages", ["url"]).select(normal), page_links(spark, d).select(normal)


@query(f"{_PAGE_SET} UNION {_LINK_SET}")
def union_distinct_urls(spark, d):
    pages, links = _url_sets(spark, d)
    return pages.unionByName(links).distinct()


@query(f"{_LINK_SET} EXCEPT {_PAGE_SET}")
def except_visited(spark, d):
    pages, links = _url_sets(spark, d)
    return links.join(pages, "url", "left_anti").distinct()


@query(
    f"""WITH w AS (SELECT doc_id, {sql.words('text')} AS w FROM documents),
    b AS (SELECT {sql.words('text')} AS w FROM benchmark),
    s AS (SELECT DISTINCT unnest({sql.shingles('w')}) AS g FROM b)
    SELECT doc_id, count(*) AS shared FROM (SELECT doc_id, unnest({sql.shingles('w')}) AS g FROM w) JOIN s USING (g)
    GROUP BY doc_id"""
)
def intersect_shingles(spark, d):
    """Shingles that a document shares with the benchmark texts."""
    from corpus_engine.functions.text import shingles

    docs = load_table(spark, d, "documents", ["doc_id", "text"], spread=True)
    known = load_table(spark, d, "benchmark", ["text"]).select(F.explode_outer(shingles(F.col("text"))).alias("g")).distinct()
    return (
        docs.select("doc_id", F.explode_outer(shingles(F.col("text"))).alias("g"))
        .join(known, "g")
        .groupBy("doc_id")
        .agg(F.count("*").alias("shared"))
    )
