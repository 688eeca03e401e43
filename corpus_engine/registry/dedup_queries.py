"""Copies and near copies over all documents; ``source`` plays the page."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpus_engine.operators import dedup as D
from corpus_engine.registry import query, sql
from corpus_engine.sources.tables import load_table

_PRINTS = f"""
  f AS (SELECT {sql.norm_hash('text')} AS hash, count(DISTINCT source) AS pages, min(text) AS text
        FROM documents GROUP BY 1)"""
_NEAR = f"""{_PRINTS},
  w AS (SELECT hash, pages, {sql.words('text')} AS w FROM f),
  s AS (SELECT hash, pages, {sql.shingles('w')} AS s FROM w),
  e AS (SELECT hash, pages, len(s) AS n, unnest(s) AS g FROM s),
  near AS (
    SELECT DISTINCT a.hash FROM (
      SELECT x.hash, y.hash AS of, any_value(x.n) AS n, any_value(y.n) AS m, count(*) AS both_
      FROM e x JOIN e y ON x.g = y.g AND x.pages < 3 AND y.pages >= 3 GROUP BY x.hash, y.hash) a
    WHERE both_ / (n + m - both_) >= 0.85
    UNION SELECT hash FROM s WHERE pages < 3 AND len(s) = 0
      AND EXISTS (SELECT 1 FROM s WHERE pages >= 3 AND len(s) = 0))"""


def _documents(spark, d):
    return load_table(spark, d, "documents", ["doc_id", "text", "source"], spread=True)


@query(f"WITH {_PRINTS} SELECT hash, pages FROM f WHERE pages >= 3")
def exact_boilerplate(spark, d):
    return D.exact_boilerplate(_documents(spark, d), "text", "source")


@query(f"WITH {_NEAR} SELECT hash FROM near")
def near_boilerplate(spark, d):
    return D.near_boilerplate(_documents(spark, d), "text", "source")


@query(
    f"""WITH {_NEAR} SELECT doc_id FROM documents
        WHERE {sql.norm_hash('text')} NOT IN (SELECT hash FROM f WHERE pages >= 3 UNION ALL SELECT hash FROM near)"""
)
def remove_boilerplate(spark, d):
    docs = _documents(spark, d)
    hashes = D.boilerplate_hashes(docs, "text", "source")
    return D.remove_boilerplate(docs, hashes, "text").select("doc_id")


@query(
    f"""SELECT u AS normalized_url, min(page_id) AS page_id FROM (
          SELECT page_id, {sql.normalize_url('url')} AS u FROM pages
          UNION ALL SELECT page_id, {sql.normalize_url("regexp_replace(url, '^https', 'http')")} FROM pages)
        GROUP BY u"""
)
def dedupe_urls(spark, d):
    pages = load_table(spark, d, "pages", ["page_id", "url"])
    plain = pages.withColumn("url", F.regexp_replace("url", "^https", "http"))
    return D.dedupe_urls(pages.unionByName(plain)).select("normalized_url", "page_id")
