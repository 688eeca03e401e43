"""Crawl order and link statistics over all pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpus_engine.functions import urls as U
from corpus_engine.operators import graph as G
from corpus_engine.operators.extraction import extract_links
from corpus_engine.registry import query, sql
from corpus_engine.sources import robots
from corpus_engine.sources.tables import load_table

_HREFS = """SELECT url, unnest(l) AS href, unnest(range(0, len(l))) AS pos FROM (
  SELECT url, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS l FROM pages)"""
_EDGES = f"""h AS ({_HREFS}),
  e AS (SELECT {sql.normalize_url('url')} AS src, pos, {sql.normalize_url("(regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) || href)")} AS dst FROM h)"""


_SKIPPED = "([.](docx?|xlsx?|pptx?|zip|tar|gz|rar|jpe?g|png|gif|svg|webp|ico|mp[34]|avi|mov|wmv|css|js|json|xml|rss))$|/(feed|rss|login|admin|signin|account|cart|checkout)"


@query(
    f"""WITH RECURSIVE {_EDGES},
        l AS (SELECT DISTINCT src, dst FROM e WHERE src <> dst AND NOT regexp_matches(lower(dst), '{_SKIPPED}')),
        d0 AS (SELECT DISTINCT {sql.host('url')} AS site, {sql.normalize_url('url')} AS url FROM pages
               WHERE NOT regexp_matches(lower({sql.normalize_url('url')}), '{_SKIPPED}')),
        r AS (SELECT site, url, 0 AS depth FROM d0
              UNION SELECT r.site, dst, depth + 1 FROM r JOIN l ON src = r.url WHERE depth < 5 AND {sql.host('dst')} = r.site)
        SELECT site, url, min(depth) AS depth FROM r GROUP BY 1, 2"""
)
def crawl_order(spark, d):
    """From every stored page, as far as the stored links lead."""
    pages = load_table(spark, d, "pages", spread=True)
    seeds = pages.select(
        U.host(F.col("url")).alias("site"),
        F.concat(F.lit("https://"), U.host(F.col("url"))).alias("root_url"),
        "url",
        F.col("page_id").alias("pos"),
    )
    return G.crawl_order(extract_links(pages), seeds).select("site", "url", "depth")


_SITES = 12


@query(
    f"""WITH RECURSIVE o AS (SELECT o_custkey AS a, o_orderkey % (SELECT max(c_custkey) FROM customer) + 1 AS b FROM orders),
        l AS (SELECT DISTINCT a % {_SITES} AS s, a, b FROM o WHERE a % {_SITES} = b % {_SITES} AND a <> b
              AND NOT starts_with(b::VARCHAR, '13') AND NOT starts_with(b::VARCHAR, '2')),
        r AS (SELECT * FROM (SELECT c_custkey % {_SITES} AS s, min(c_custkey) AS p, 0 AS depth FROM customer GROUP BY 1)
              WHERE NOT starts_with(p::VARCHAR, '2')
              UNION SELECT r.s, b, depth + 1 FROM r JOIN l ON l.a = r.p WHERE depth < 5)
        SELECT 's' || s || '.example.org' AS site, 'https://s' || s || '.example.org/p/' || p AS url, min(depth) AS depth
        FROM r GROUP BY ALL"""
)
def crawl_order_rules(spark, d):
    """One seed per site, five levels deep, with robots, include and exclude rules.

    Customers are pages dealt to twelve sites; each order links its customer to another.
    """
    most = load_table(spark, d, "customer", ["c_custkey"]).agg(F.max("c_custkey")).first()[0]

    def page(key):
        return F.concat(F.lit("https://s"), key % _SITES, F.lit(".example.org/p/"), key)

    orders = load_table(spark, d, "orders", ["o_orderkey", "o_custkey"])
    edges = orders.select(
        page(F.col("o_custkey")).alias("src_url"),
        F.col("o_orderkey").alias("pos"),
        page(F.col("o_orderkey") % most + 1).alias("dst_url"),
    )
    customers = load_table(spark, d, "customer", ["c_custkey"]).withColumn("n", F.col("c_custkey") % _SITES)
    seeds = customers.groupBy("n").agg(F.min("c_custkey").alias("c")).select(
        F.concat(F.lit("s"), "n", F.lit(".example.org")).alias("site"),
        F.concat(F.lit("https://s"), "n", F.lit(".example.org/")).alias("root_url"),
        page(F.col("c")).alias("url"),
        F.lit(0).alias("pos"),
    )
    rules = robots.parse_robots(
        seeds.select(F.col("site").alias("host"), F.lit("User-agent: *\nDisallow: /p/13\n").alias("body"))
    )
    targets = edges.select(F.col("dst_url").alias("url")).distinct()
    blocked = robots.robots_filter(targets, rules, "AnyBot").filter("not allowed").select(
        U.normalize_url(F.col("url")).alias("url")
    )
    found = G.crawl_order(edges, seeds, include=["/p/"], exclude=["/p/2"], blocked=blocked)
    return found.select("site", "url", "depth")


@query(
    f"""WITH {_EDGES}, k AS (SELECT {sql.host('src')} AS site, dst AS url FROM e
          UNION SELECT {sql.host('url')}, {sql.normalize_url('url')} FROM pages),
        f AS (SELECT DISTINCT {sql.host('url')} AS site, {sql.normalize_url('url')} AS url, 1 AS f FROM pages)
        SELECT site, count(*) AS discovered, count(f) AS crawled FROM k LEFT JOIN f USING (site, url) GROUP BY site"""
)
def link_stats(spark, d):
    pages = load_table(spark, d, "pages", spread=True)
    normal = U.normalize_url
    edges = extract_links(pages).select(U.host(F.col("src_url")).alias("site"), normal(F.col("dst_url")).alias("url"))
    fetched = pages.select(U.host(F.col("url")).alias("site"), normal(F.col("url")).alias("url"))
    return G.link_stats(edges, fetched)
