"""Extraction over all pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpus_engine.functions import markup as M
from corpus_engine.operators import extraction as E
from corpus_engine.registry import query, sql
from corpus_engine.sources.tables import load_table


def _pages(spark, d):
    return load_table(spark, d, "pages", spread=True)


@query(
    """SELECT page_id, url, trim(replace(regexp_extract(html, '<title>(.*?)</title>', 1), '&amp;', '&')) AS title,
         regexp_extract(html, '<html lang="([a-z]+)', 1) AS language, '' AS description FROM pages"""
)
def page_metadata(spark, d):
    parsed = E.with_metadata(E.parse_pages(_pages(spark, d)))
    return parsed.select("page_id", "url", "title", "language", "description")


@query(
    f"""SELECT url AS src_url, CAST(pos AS INT) AS pos, regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) || {sql.percent_encode('href')} AS dst_url
        FROM (SELECT url, unnest(l) AS href, unnest(range(0, len(l))) AS pos FROM (
          SELECT url, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS l FROM pages))"""
)
def extract_links(spark, d):
    return E.extract_links(_pages(spark, d))


@query(
    rf"""SELECT page_id, array_to_string(list_sort(list_distinct(regexp_extract_all(html, '{M.EMAIL}'))), ',') AS emails FROM pages"""
)
def page_emails(spark, d):
    return _pages(spark, d).select("page_id", F.array_join(F.sort_array(M.emails(F.col("html"))), ",").alias("emails"))


@query(
    """SELECT page_id, length(html) % 2 = 0 AS marked, length(html) % 2 = 0 AND length(trim(regexp_replace(regexp_replace(regexp_replace(
         regexp_replace(regexp_extract(html, '(?is)<body[^>]*>(.*?)</body>', 1), '(?is)<script.*?</script>', '', 'g'),
         '(?is)<style.*?</style>', '', 'g'), '<[^>]+>', '', 'g'), '\\s+', ' ', 'g'))) < 200
         AND regexp_matches(html, '(?is)<body[^>]*>.*?</body>') AS spa FROM pages""".replace("\\\\", "\\")
)
def likely_spa(spark, d):
    html = F.when(F.length("html") % 2 == 0, F.concat("html", F.lit('<div id="root">'))).otherwise(F.col("html"))
    return _pages(spark, d).select("page_id", M.maybe_spa(html).alias("marked"), M.likely_spa(html).alias("spa"))


@query(
    """SELECT doc_id AS page_id, CASE doc_id % 3 WHEN 0 THEN 'html' WHEN 1 THEN 'pdf' ELSE 'dropped' END AS page_type,
         doc_id % 3 = 0 AND length(text) < 100 AS needs_browser, doc_id % 3 < 2 AND length(text) >= 50 AS keep
       FROM documents"""
)
def page_gate(spark, d):
    kind = F.col("doc_id") % 3
    content_type = F.when(kind == 0, "text/html; charset=utf-8").when(kind == 1, "application/pdf").otherwise("image/png")
    docs = load_table(spark, d, "documents", ["doc_id", "text"])
    gate = M.page_gate(content_type, F.col("text")).alias("g")
    return docs.select(F.col("doc_id").alias("page_id"), gate).select("page_id", "g.*")


def _document_pages(spark, d):
    """Every document as a page with a frame, a heading, a table, an image, a mail address and references."""
    docs = load_table(spark, d, "documents", ["doc_id", "text", "lang"], spread=True)
    number = F.col("doc_id").cast("string")
    text = F.col("text")
    for char, reference in (("&", "&amp;"), ("<", "&lt;"), ("é", "&eacute;"), ("ü", "&#252;"), ("ñ", "&#xF1;")):
        text = F.replace(text, F.lit(char), F.lit(reference))
    html = F.concat(
        F.lit('<!DOCTYPE html><html lang="'), "lang", F.lit('-x"><head><title>Caf&eacute; '), number, F.lit(" &#8217; &amp; mehr</title>"),
        F.lit('<meta property=og:site_name content="A&#38;B &eacute; '), number, F.lit('"><meta name="description" content="&Uuml;ber '), number,
        F.lit('"><link rel=canonical href="/c?a=1&#38;n='), number,
        F.lit('"><script type="application/ld+json">[{"@type":"Organization","name":"Firma '), number,
        F.lit('","email":"a@b.example"},{"@type":"FAQPage","mainEntity":[{"@type":"Question","name":"Nummer '), number,
        F.lit('?","acceptedAnswer":{"text":"Ja."}}]}]</script></head><body><nav>Tel. 555-'), F.lpad((F.col("doc_id") % 10000).cast("string"), 4, "0"),
        F.lit('</nav><article><h1>Kopf '), number, F.lit("</h1><p>"), text,
        F.lit("</p><table><tr><th>a</th><th>b|c</th></tr><tr><td>"), number,
        F.lit('</td></tr></table><img src=x alt="Ein Bild &ndash; '), number, F.lit('"></article></body></html>'),
    )
    return docs.select(F.col("doc_id").alias("page_id"), F.lit("https://a.example/").alias("url"), html.alias("html"))


def _squeeze(x: str) -> str:
    return sql.trim(f"regexp_replace({x}, '\\n{{3,}}', chr(10) || chr(10), 'g')")


_WALKED = rf"""
  w AS (SELECT doc_id, lang, text, {_squeeze(f"""chr(10) || '## Kopf ' || doc_id || chr(10) ||
         CASE WHEN {sql.trim('text')} = '' THEN '' ELSE chr(10) || {sql.trim('text')} END || chr(10) ||
         chr(10) || '| a | b' || chr(92) || '|c |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || doc_id || ' |  |' || chr(10) ||
         chr(10) || '[Image: Ein Bild – ' || doc_id || ']'""")} AS x FROM documents),
  l AS (SELECT doc_id, unnest(string_split(x, chr(10))) AS line, unnest(range(0, len(string_split(x, chr(10))))) AS pos FROM w),
  k AS (SELECT *, {sql.trim('line')} AS t, row_number() OVER (PARTITION BY doc_id, {sql.trim('line')} ORDER BY pos) AS rn FROM l),
  m AS (SELECT doc_id, {_squeeze("string_agg(line, chr(10) ORDER BY pos)")} AS main FROM k WHERE rn = 1 OR t = '' GROUP BY doc_id),
  -- the body's text has nothing between its elements
  mails AS (SELECT doc_id, regexp_extract_all('Kopf ' || doc_id || text || 'ab|c' || doc_id, '{M.EMAIL}') AS found FROM documents),
  c AS (SELECT doc_id, ['Phone: 555-' || lpad(CAST(doc_id % 10000 AS VARCHAR), 4, '0')] || list_transform(
          list_filter(found, lambda e, i: list_position(found, e) = i), lambda e: 'Email: ' || e) AS contacts FROM mails)"""


@query(
    rf"""WITH {_WALKED}
        SELECT doc_id AS page_id, 'Café ' || doc_id || ' ’ & mehr' AS title, 'Über ' || doc_id AS description,
          '/c?a=1&n=' || doc_id AS canonical, lang AS language, len(contacts) AS contacts,
          '| a | b\|c |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || doc_id || ' |  |' AS tables,
          '[Image: Ein Bild – ' || doc_id || ']' AS images, md5(main) AS main_digest,
          md5({sql.trim("array_to_string(contacts, chr(10)) || chr(10) || chr(10) || main")}) AS page_digest
        FROM w JOIN m USING (doc_id) JOIN c USING (doc_id)"""
)
def extract_pages(spark, d):
    """Metadata, contacts, main text and full text, each document as a page."""
    return E.extract_pages(_document_pages(spark, d)).select(
        "page_id", "title", "description", "canonical", "language", F.size("contacts").alias("contacts"),
        F.array_join("tables", "\n\n").alias("tables"), F.array_join("images", "\n").alias("images"),
        F.md5("main_text").alias("main_digest"), F.md5("page_text").alias("page_digest"),
    )


@query(
    """SELECT doc_id AS page_id, 2 AS objects, 'A&B é ' || doc_id AS site_name, 'Firma ' || doc_id AS company_name,
         'Company: Firma ' || doc_id || chr(10) || 'Description: Über ' || doc_id || chr(10) || 'Email: a@b.example' || chr(10) ||
         chr(10) || 'Frequently Asked Questions:' || chr(10) || 'Q: Nummer ' || doc_id || '?' || chr(10) || 'A: Ja.' AS text
       FROM documents"""
)
def structured_data(spark, d):
    """Linked data, Open Graph names and owner, each document as a page."""
    out = E.structured_data(_document_pages(spark, d))
    return out.select(
        "page_id", F.size("json_ld").alias("objects"), F.col("open_graph")["site_name"].alias("site_name"),
        F.col("company.company_name").alias("company_name"), "text",
    )


@query("SELECT page_id, length(html) AS length FROM pages")
def parse_pages(spark, d):
    """The row source over all raw pages; the walk gives every page a text."""
    parsed = E.parse_pages(_pages(spark, d)).filter(F.length("walked") > 0)
    return parsed.select("page_id", F.col("raw_html_length").alias("length"))
