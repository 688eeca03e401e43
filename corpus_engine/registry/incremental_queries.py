"""Maintenance over two versions of all documents.

The second version is derived: texts of German documents change their first
line, English ones lose their last line, sources ending in 7 are gone.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from corpus_engine.functions.text import content_hash
from corpus_engine.operators import incremental as I
from corpus_engine.operators.embedding import hashed_words
from corpus_engine.operators.timeline import previous_version as previous
from corpus_engine.plans import maintenance
from corpus_engine.registry import query, sql
from corpus_engine.runtime import durable, scratch_path
from corpus_engine.sources.site_tables import SiteTable
from corpus_engine.sources.tables import load_table
from corpus_engine.streaming import ingest

_NEW = r"""CASE lang WHEN 'de' THEN 'Neu. ' || text WHEN 'en' THEN regexp_replace(text, '\n[^\n]*$', '') ELSE text END"""
_GONE = "source LIKE '%7'"

_V = rf"""
  old AS (SELECT source AS agent_id, 'doc/' || doc_id AS url, doc_id, text, sha256(text) AS hash FROM documents),
  new AS (SELECT source AS agent_id, 'doc/' || doc_id AS url, doc_id, lang, {_NEW} AS text, sha256({_NEW}) AS hash
          FROM documents WHERE NOT {_GONE})"""


def _versions(spark, d):
    docs = load_table(spark, d, "documents", ["doc_id", "text", "lang", "source"], spread=True).select(
        F.col("source").alias("agent_id"),
        F.concat(F.lit("doc/"), "doc_id").alias("url"),
        F.col("doc_id").alias("page_id"),
        "lang",
        F.col("text").alias("clean_markdown"),
    )
    old = docs.drop("lang").withColumn("content_hash", content_hash(F.col("clean_markdown")))
    text, lang = F.col("clean_markdown"), F.col("lang")
    changed = (
        F.when(lang == "de", F.concat(F.lit("Neu. "), text))
        .when(lang == "en", F.regexp_replace(text, r"\n[^\n]*\z", ""))
        .otherwise(text)
    )
    new = (
        docs.filter(~F.col("agent_id").endswith("7"))
        .withColumn("clean_markdown", changed)
        .withColumn("content_hash", content_hash(F.col("clean_markdown")))
        .withColumn("status_code", F.when(F.col("lang") == "fr", 304).otherwise(200))
    )
    return old, new


@query(
    f"""WITH {_V} SELECT n.doc_id AS page_id, CASE WHEN n.lang = 'fr' THEN 'not_modified' WHEN n.hash = o.hash
          THEN 'content_unchanged' WHEN o.doc_id IS NULL THEN 'new' ELSE 'changed' END AS outcome
        FROM new n LEFT JOIN (SELECT * FROM old WHERE agent_id NOT LIKE '%3') o ON n.agent_id = o.agent_id AND n.url = o.url"""
)
def classify_pages(spark, d):
    old, new = _versions(spark, d)
    return I.classify_pages(new, old.filter(~F.col("agent_id").endswith("3"))).select("page_id", "outcome")


@query(
    f"""WITH {_V}, ch AS (SELECT *, CASE lang WHEN 'fr' THEN 'skipped' WHEN 'es' THEN 'failed' ELSE 'crawled' END AS st FROM new)
        SELECT coalesce(o.doc_id, c.doc_id) AS page_id, coalesce(c.st, 'pending') AS crawl_status,
          md5(CASE WHEN c.st = 'crawled' THEN c.text ELSE o.text END) AS digest,
          md5(CASE WHEN c.st = 'crawled' THEN o.text END) AS previous
        FROM (SELECT * FROM old WHERE agent_id NOT LIKE '%3') o FULL JOIN (SELECT * FROM ch WHERE agent_id NOT LIKE '%3' OR st = 'crawled') c
          ON o.agent_id = c.agent_id AND o.url = c.url"""
)
def upsert_pages(spark, d):
    existing, changes = _crawl(spark, d)
    return I.upsert_pages(existing, changes).select(
        "page_id", "crawl_status", F.md5("clean_markdown").alias("digest"), F.md5("previous_markdown").alias("previous")
    )


def _crawl(spark, d):
    """Stored pages, and the changes of a crawl."""
    old, new = _versions(spark, d)
    existing = old.filter(~F.col("agent_id").endswith("3")).withColumns(
        {
            "previous_markdown": F.lit(None).cast("string"),
            "crawl_status": F.lit("pending"),
            "skip_reason": F.lit(None).cast("string"),
            "crawl_job_id": F.lit(1),
            "last_crawled_at": F.timestamp_seconds(F.lit(0)),
        }
    )
    status = F.when(F.col("lang") == "fr", "skipped").when(F.col("lang") == "es", "failed").otherwise("crawled")
    changes = (
        new.withColumn("crawl_status", status)
        .filter(~F.col("agent_id").endswith("3") | (F.col("crawl_status") == "crawled"))
        .withColumn("skip_reason", F.when(F.col("crawl_status") != "crawled", "x"))
        .withColumn("crawl_job_id", F.lit(2))
        .withColumn("last_crawled_at", F.timestamp_seconds(F.lit(9)))
        .drop("lang", "status_code")
    )
    return existing, changes


_ONE_SITE = "agent_id LIKE '%1'"


@query(
    f"""WITH {_V}, ch AS (SELECT *, CASE lang WHEN 'fr' THEN 'skipped' WHEN 'es' THEN 'failed' ELSE 'crawled' END AS st
                          FROM new WHERE {_ONE_SITE})
        SELECT coalesce(o.doc_id, c.doc_id) AS page_id, coalesce(c.st, 'pending') AS crawl_status,
          md5(CASE WHEN c.st = 'crawled' THEN c.text ELSE o.text END) AS digest,
          md5(CASE WHEN c.st = 'crawled' THEN o.text END) AS previous, true AS others_untouched
        FROM (SELECT * FROM old WHERE agent_id NOT LIKE '%3' AND agent_id NOT LIKE '%5') o FULL JOIN ch c
          ON o.agent_id = c.agent_id AND o.url = c.url"""
)
def upsert_site_table(spark, d):
    """A crawl of some sites applied to the stored table, and other sites dropped; other files stay."""
    existing, changes = _crawl(spark, d)
    table = SiteTable(spark, scratch_path(spark, "site-table"), buckets=64)
    table.create(existing)

    def files():
        path = F.col("_metadata.file_path")
        return spark.read.parquet(table.path).select("bucket", path.alias("file")).distinct()

    before = durable(files())
    touched = table.upsert(changes.filter(F.col("agent_id").endswith("1")))
    touched += table.drop_sites(existing.filter(F.col("agent_id").endswith("5")).select("agent_id").distinct())
    lost = before.filter(~F.col("bucket").isin(touched)).join(files(), ["bucket", "file"], "left_anti")
    return table.read().select(
        "page_id", "crawl_status", F.md5("clean_markdown").alias("digest"), F.md5("previous_markdown").alias("previous")
    ).join(F.broadcast(lost.agg((F.count("*") == 0).alias("others_untouched"))))


_LINES = """
  oc AS (SELECT doc_id AS page_id, unnest(string_split(text, chr(10))) AS line,
                unnest(range(0, len(string_split(text, chr(10))))) AS i FROM old),
  nc AS (SELECT doc_id AS page_id, unnest(string_split(text, chr(10))) AS line,
                unnest(range(0, len(string_split(text, chr(10))))) AS i FROM new),
  o AS (SELECT page_id, i, page_id || '-' || lpad(CAST(i AS VARCHAR), 6, '0') AS chunk_id, sha256(line) AS hash FROM oc),
  n AS (SELECT page_id, i, sha256(line) AS hash FROM nc),
  k AS (SELECT page_id, hash, max(chunk_id) AS chunk_id FROM o SEMI JOIN n USING (page_id, hash) GROUP BY ALL),
  rm AS (SELECT * FROM o WHERE page_id IN (SELECT page_id FROM n) AND chunk_id NOT IN (SELECT chunk_id FROM k)),
  ad AS (SELECT * FROM n ANTI JOIN o USING (page_id, hash))"""


def _chunks(spark, d):
    """Lines stand in for chunks."""
    old, new = _versions(spark, d)

    def lines(df):
        return df.select(
            "page_id", F.posexplode(F.split("clean_markdown", "\n")).alias("chunk_index", "content")
        ).withColumn("content_hash", content_hash(F.col("content")))

    number = F.lpad(F.col("chunk_index").cast("string"), 6, "0")
    return lines(new), lines(old).withColumn("chunk_id", F.concat_ws("-", "page_id", number))


@query(
    f"""WITH {_V}, {_LINES} SELECT page_id, change, count(*) AS chunks FROM (
          SELECT page_id, 'unchanged' AS change FROM k UNION ALL SELECT page_id, 'removed' FROM rm
          UNION ALL SELECT page_id, 'added' FROM ad) GROUP BY ALL"""
)
def diff_chunks(spark, d):
    new, existing = _chunks(spark, d)
    return I.diff_chunks(new, existing).groupBy("page_id", "change").agg(F.count("*").alias("chunks"))


@query(
    f"""WITH {_V}, {_LINES} SELECT page_id, count(*) AS chunks, count(DISTINCT hash) AS texts FROM (
          SELECT page_id, hash FROM o WHERE chunk_id NOT IN (SELECT chunk_id FROM rm)
          UNION ALL SELECT ad.page_id, ad.hash FROM ad JOIN nc ON nc.page_id = ad.page_id AND nc.i = ad.i
            WHERE length(line) > 10) GROUP BY page_id"""
)
def apply_chunk_diff(spark, d):
    new, existing = _chunks(spark, d)
    diff = I.diff_chunks(new, existing)
    # short texts stand in for failed embeddings
    vector = F.when(F.length("content") > 10, F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array().cast("array<double>"))
    applied = I.apply_chunk_diff(existing, diff, new.withColumn("embedding", vector), 2)
    return applied.groupBy("page_id").agg(
        F.count("*").alias("chunks"), F.countDistinct("content_hash").alias("texts")
    )


@query(
    f"""WITH {_V}, p AS (SELECT n.doc_id AS page_id, string_split(n.text, chr(10)) AS c, string_split(coalesce(o.text, ''), chr(10)) AS p,
            coalesce(o.text, '') <> '' AS has_previous
          FROM new n LEFT JOIN old o ON o.doc_id = n.doc_id AND o.agent_id NOT LIKE '%3'),
        l AS (SELECT page_id, has_previous, coalesce(c[i], '') AS c, coalesce(p[i], '') AS p
              FROM (SELECT *, unnest(range(1, greatest(len(c), len(p)) + 1)) AS i FROM p))
        SELECT page_id, has_previous, count(*) FILTER (WHERE c <> p AND c <> '') AS added,
          count(*) FILTER (WHERE c <> p AND p <> '') AS removed,
          count(*) FILTER (WHERE c = p AND c <> '') AS unchanged FROM l GROUP BY ALL"""
)
def page_line_diff(spark, d):
    old, new = _versions(spark, d)
    before = old.filter(~F.col("agent_id").endswith("3")).select("page_id", F.col("clean_markdown").alias("previous_markdown"))
    return I.page_line_diff(new.join(before, "page_id", "left")).select(
        "page_id", "has_previous", *[F.col(c).cast("bigint").alias(c) for c in ("added", "removed", "unchanged")]
    )


@query("SELECT doc_id AS page_id FROM documents WHERE source NOT IN (SELECT source FROM documents WHERE lang = 'es' AND n_chars > 2000)")
def full_refresh(spark, d):
    docs = load_table(spark, d, "documents", ["doc_id", "source", "lang", "n_chars"]).withColumnsRenamed(
        {"doc_id": "page_id", "source": "agent_id"}
    )
    again = docs.filter((F.col("lang") == "es") & (F.col("n_chars") > 2000)).select("agent_id").distinct()
    return I.full_refresh(docs, again).select("page_id")


@query(
    """SELECT event_id, lag(props) OVER (PARTITION BY user_id, event_type ORDER BY ts) AS previous FROM events"""
)
def previous_version(spark, d):
    events = load_table(spark, d, "events", ["event_id", "ts", "user_id", "event_type", "props"])
    return previous(events, ["user_id", "event_type"], "ts", "props", "previous", 5 * 86_400_000_000).select(
        "event_id", "previous"
    )


_DIM = 16


@query(
    f"""WITH {_V},
       seen AS (SELECT n.doc_id FROM new n JOIN old o USING (doc_id) WHERE n.lang <> 'fr' AND n.hash <> o.hash),
       c1 AS (SELECT * FROM ({sql.plain_chunks('old', 'doc_id')}) WHERE NOT {sql.boilerplate('content')}),
       changed AS (SELECT * FROM new SEMI JOIN seen USING (doc_id)),
       c2 AS (SELECT * FROM ({sql.plain_chunks('changed', 'doc_id')}) WHERE NOT {sql.boilerplate('content')}),
       kept AS (SELECT doc_id, max(chunk_index) AS chunk_index, content FROM c1 SEMI JOIN c2 USING (doc_id, content)
                GROUP BY doc_id, content),
       present AS (SELECT doc_id, chunk_index, content, 0 AS batch FROM c1 ANTI JOIN seen USING (doc_id)
                   UNION ALL SELECT doc_id, chunk_index, content, 0 FROM kept
                   UNION ALL SELECT doc_id, chunk_index, content, 1 FROM c2 ANTI JOIN c1 USING (doc_id, content))
       SELECT doc_id AS page_id, chunk_index, md5(content) AS digest, batch, {_DIM} AS dim FROM present"""
)
def incremental_ingest(spark, d):
    """The chunk table after a second crawl: unchanged texts keep their row, only new ones are embedded."""
    old, new = _versions(spark, d)
    sink, embedder = scratch_path(spark, "sink"), hashed_words(_DIM)

    def batch(pages, number):
        rows = pages.select("page_id", F.lit("").alias("title"), F.col("clean_markdown").alias("text"), "status_code")
        ingest.ingest_batch(rows, number, sink, embedder, _DIM, 16)

    batch(old.withColumn("status_code", F.lit(200)), 0)
    batch(new, 1)
    chunks = ingest.current_chunks(spark, sink)
    return chunks.select(
        "page_id", "chunk_index", F.md5("content").alias("digest"),
        F.split_part("chunk_id", F.lit("-"), F.lit(1)).cast("int").alias("batch"), F.size("embedding").alias("dim"),
    )


# a paragraph that every page has, and one that a third of them gains
_BASE = "<p>" + "Ein Absatz, der auf jeder Seite steht, damit keine leer ist. " * 2 + "</p></article>"
_NEWS = "<p>Neu auf dieser Seite, Nummer %s: " + "ein ganzer Absatz, der vorher nicht da war. " * 3 + "</p></article>"


@query(
    """SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'not_modified' WHEN 1 THEN 'content_unchanged' ELSE 'changed' END AS outcome,
         page_id % 3 = 2 AS has_news, true AS has_chunks, page_id % 3 < 2 AS untouched FROM pages"""
)
def refresh_pages(spark, d):
    """Two crawls of all pages through the whole job; a third of them gained a paragraph."""
    end, kind = F.lit("</article>"), F.col("page_id") % 3
    pages = load_table(spark, d, "pages", ["page_id", "url", "html"], spread=True)
    pages = pages.withColumn("html", F.replace("html", end, F.lit(_BASE)))
    news = F.replace("html", end, F.format_string(_NEWS, "page_id"))
    second = pages.withColumn("html", F.when(kind == 2, news).otherwise(F.col("html")))
    sink, embedder = scratch_path(spark, "pages-sink"), hashed_words(_DIM)
    maintenance.refresh_pages(pages.withColumn("status_code", F.lit(200)), 0, sink, embedder, _DIM, 16)
    again = second.withColumn("status_code", F.when(kind == 0, 304).otherwise(200))
    outcomes = maintenance.refresh_pages(again, 1, sink, embedder, _DIM, 16)
    found = ingest.current_chunks(spark, sink).groupBy("page_id").agg(
        F.bool_or(F.contains("content", F.format_string("Nummer %s:", "page_id"))).alias("has_news"),
        F.bool_and(F.startswith("chunk_id", F.lit("0-"))).alias("untouched"),
    )
    return outcomes.join(found, "page_id", "left").select(
        "page_id", "outcome", "has_news", F.col("untouched").isNotNull().alias("has_chunks"), "untouched"
    )
