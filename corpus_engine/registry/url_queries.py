"""URL functions over all pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpus_engine.functions import urls as U
from corpus_engine.registry import query, sql
from corpus_engine.sources.tables import load_table

_ROOT = "https://www.thther.example.org/start"


def _pages(spark, d, *extra):
    return load_table(spark, d, "pages", ["page_id", "url", *extra], spread=bool(extra))


@query(f"SELECT page_id, {sql.normalize_url('url')} AS url FROM pages")
def normalize_url(spark, d):
    return _pages(spark, d).select("page_id", U.normalize_url(F.col("url")).alias("url"))


@query(f"SELECT page_id, {sql.host('url')} = 'thther.example.org' AS same FROM pages")
def is_same_domain(spark, d):
    base = F.lit("http://THTHER.example.org:8080/x")
    return _pages(spark, d).select("page_id", U.is_same_domain(F.col("url"), base).alias("same"))


@query(
    """SELECT page_id, length(url) % 4 IN (0, 3) AS valid, page_id % 3 = 0 AS bare FROM pages"""
)
def is_valid_url(spark, d):
    kind = F.length("url") % 4
    u = (
        F.when(kind == 1, F.regexp_replace(F.col("url"), "//[^/]+", "//10.1.2.3"))
        .when(kind == 2, F.regexp_replace(F.col("url"), "//[^/]+", "//db.internal"))
        .otherwise(F.col("url"))
    )
    bare = F.col("page_id") % 3 == 0
    u = F.when(bare, F.regexp_replace(u, "^https?://", "")).otherwise(u)
    return _pages(spark, d).select("page_id", U.is_valid_url(u).alias("valid"), bare.alias("bare"))


@query(
    f"""SELECT regexp_replace({sql.host('url')}, '^www\\.', '') AS domain, count(*) AS pages
        FROM pages GROUP BY 1"""
)
def extract_domain(spark, d):
    return _pages(spark, d).groupBy(U.extract_domain(F.col("url")).alias("domain")).agg(F.count("*").alias("pages"))


_SKIP = (
    "regexp_matches(lower({u}), '("
    + "|".join(e.replace(".", "[.]") for e in U.SKIP_EXTENSIONS)
    + "{pdf})$') OR "
    + " OR ".join(f"contains(lower({{u}}), '{p}')" for p in U.SKIP_PATTERNS)
)
_SUFFIX = "url || CASE page_id % 5 WHEN 0 THEN '.PDF' WHEN 1 THEN '/feed/x' WHEN 2 THEN '.docx' ELSE '' END"


@query(
    f"""SELECT page_id, {_SKIP.format(u='u', pdf='|[.]pdf')} AS skip,
          {_SKIP.format(u='u', pdf='')} AS skip_pdf_ok FROM (SELECT page_id, {_SUFFIX} AS u FROM pages)"""
)
def should_skip_url(spark, d):
    u = F.expr(_SUFFIX)
    return _pages(spark, d).select(
        "page_id",
        U.should_skip_url(u).alias("skip"),
        U.should_skip_url(u, allow_pdf=True).alias("skip_pdf_ok"),
    )


@query(
    f"""SELECT page_id, {sql.host('url')} = 'www.thther.example.org'
          OR regexp_matches(regexp_replace({sql.host('url')}, '^www[.]', ''), '(^|[.])(thther.example.org|example.net)$')
          AS in_scope FROM pages"""
)
def is_in_domain_scope(spark, d):
    allowed = F.array(F.lit("www.thther.example.org"), F.lit("example.net"))
    return _pages(spark, d).select(
        "page_id", U.is_in_domain_scope(F.col("url"), F.lit(_ROOT), allowed).alias("in_scope")
    )


@query(f"SELECT page_id, page_id % 5 = 0 AS pdf FROM pages")
def is_pdf_url(spark, d):
    return _pages(spark, d).select("page_id", U.is_pdf_url(F.expr(_SUFFIX)).alias("pdf"))


@query(
    r"""SELECT page_id, regexp_matches(p, '^(/en/.*|/../9)') AND NOT regexp_matches(p, '^/en/.*0') AS allowed
        FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]+([^?#]*)', 1) AS p FROM pages)"""
)
def matches_path_patterns(spark, d):
    return _pages(spark, d).select(
        "page_id", U.path_allowed(F.col("url"), ["/en/*", "/??/9"], ["/en/*0"]).alias("allowed")
    )


@query(
    f"""SELECT page_id, regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) || {sql.percent_encode('href')} AS link
        FROM (SELECT page_id, url, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM pages)"""
)
def resolve_link(spark, d):
    hrefs = _pages(spark, d, "html").select(
        "page_id", "url", F.explode_outer(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'))).alias("href")
    )
    return hrefs.select("page_id", U.resolve_link(F.col("href"), F.col("url")).alias("link"))


@query(
    r"""SELECT page_id, CASE WHEN t = '' THEN 'PDF Document' ELSE t END AS title FROM (
          SELECT page_id, regexp_replace(regexp_replace(regexp_extract(url, '^[a-z]+://[^/]+[^?#]*/([^/?#]*)', 1),
            '(?i)[.]pdf$', ''), '[-_]', ' ', 'g') AS t
          FROM (SELECT page_id, regexp_replace(url, '([a-z]{2})/([0-9]+)', '\1/a-\2_b', '') AS url FROM pages))"""
)
def title_from_url(spark, d):
    u = F.regexp_replace(F.col("url"), "([a-z]{2})/([0-9]+)", "$1/a-$2_b")
    return _pages(spark, d).select("page_id", U.title_from_url(u).alias("title"))


@query(
    rf"""SELECT doc_id, left(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
           lower(text), '[^a-z0-9\t\n\x0B\f\r -]', '', 'g'), '[\t\n\x0B\f\r ]+', '-', 'g'),
           '-+', '-', 'g'), '^-|-$', '', 'g'), 60) AS slug FROM documents"""
)
def slugify(spark, d):
    return load_table(spark, d, "documents", ["doc_id", "text"]).select(
        "doc_id", U.slugify(F.col("text")).alias("slug")
    )


@query(
    f"""SELECT h AS domain, regexp_matches(h, '^[a-zA-Z0-9][a-zA-Z0-9-]*[.][a-zA-Z]{{2,}}$') AS valid,
          count(*) AS pages FROM (
            SELECT {sql.host('url')} AS h FROM pages
            UNION ALL SELECT regexp_extract({sql.host('url')}, '[^.]+[.][^.]+$') FROM pages) GROUP BY 1, 2"""
)
def is_valid_custom_domain(spark, d):
    h = U.host(F.col("url"))
    return (
        _pages(spark, d)
        .select(F.explode(F.array(h, F.regexp_extract(h, r"[^.]+[.][^.]+$", 0))).alias("domain"))
        .groupBy("domain", U.is_valid_custom_domain(F.col("domain")).alias("valid"))
        .agg(F.count("*").alias("pages"))
    )
