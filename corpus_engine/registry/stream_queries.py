"""Limits, streams and stored-body sources over whole tables."""

from __future__ import annotations

import gc

from pyspark.sql import functions as F

from corpus_engine.functions import urls as U
from corpus_engine.operators import timeline as W
from corpus_engine.registry import query, sql
from corpus_engine.registry.job_queries import outcomes
from corpus_engine.runtime import many_files, scratch_path
from corpus_engine.sources import pdf, robots, sinks, sitemaps, transcripts
from corpus_engine.sources.tables import load_table
from corpus_engine.streaming import ingest, progress, runner, state

_HOUR = W.HOUR_US

#: Files of a folder that the driver lists at once, and of them those that a task reads.
FILES_LISTED, FILES_READ = 50_000, 500


@query(
    """SELECT event_id, n AS in_window, n <= 3 AS allowed FROM (
         SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts)
           RANGE BETWEEN 21599999999 PRECEDING AND CURRENT ROW) AS n FROM events)"""
)
def rate_limit(spark, d):
    """At most three events per user in the trailing six hours."""
    return W.over_limit(outcomes(spark, d), 3, 6 * _HOUR).select("event_id", "in_window", "allowed")


def _stream(spark, d):
    return runner.read_stream(spark, d, "events").select(
        "event_id", "ts", F.col("user_id").alias("key"), (F.col("event_type") == "view").alias("ok")
    )


@query(
    """SELECT epoch_us(time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01')) AS window_start, user_id AS key,
         count(*) AS events, count(*) <= 3 AS allowed FROM events GROUP BY ALL"""
)
def rate_limit_stream(spark, d):
    """The same limit per six-hour window of a stream."""
    counts = runner.run_update(progress.keys_per_window(_stream(spark, d), "6 hours"), "rate-limit", ["window_start", "key"])
    return counts.withColumn("window_start", F.unix_micros("window_start")).withColumn("allowed", F.col("events") <= 3)


_STREAKS = """g AS (SELECT event_id, ts, user_id, event_type, sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END)
    OVER (PARTITION BY user_id ORDER BY ts, event_id) AS grp FROM events),
  s AS (SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id, grp ORDER BY ts, event_id) AS streak
    FROM g WHERE event_type <> 'view')"""


@query(f"WITH {_STREAKS} SELECT event_id, user_id AS key FROM s WHERE streak = 10")
def circuit_breaker(spark, d):
    """Where ten failures in a row open a user's circuit."""
    return W.openings(outcomes(spark, d), 10).select("event_id", "key")


@query(
    """SELECT epoch_us(time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01')) AS window_start, user_id AS key, count(*) AS events,
         count(*) FILTER (WHERE event_type <> 'view') AS failures, count(*) FILTER (WHERE event_type <> 'view') >= 10 AS open
       FROM events GROUP BY ALL"""
)
def circuit_breaker_stream(spark, d):
    """Failures per user and day of a stream; ten of them are too many."""
    counts = progress.keys_per_window(_stream(spark, d), "1 day", failed=~F.col("ok"))
    rows = runner.run_update(counts, "breaker", ["window_start", "key"])
    return rows.withColumn("window_start", F.unix_micros("window_start")).withColumn("open", F.col("failures") >= 10)


@query(
    """WITH w AS (SELECT sha256(user_id || '|' || event_type) AS key,
            epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id, event_type ORDER BY ts) AS gap FROM events)
       SELECT key, count(*) AS events, count(*) FILTER (WHERE gap < 86400000000) AS hits FROM w GROUP BY 1"""
)
def ttl_cache_hits(spark, d):
    """Requests that repeat one of the same key within a day."""
    events = load_table(spark, d, "events", ["event_id", "ts", "user_id", "event_type"]).withColumn(
        "key", W.cache_key(F.col("user_id").cast("string"), F.col("event_type"))
    )
    rows = W.repeats_within(events, 24 * _HOUR, ["key"])
    return rows.groupBy("key").agg(F.count("*").alias("events"), F.count_if("hit").alias("hits"))


_JOB_STATUS = "CASE event_type WHEN 'signup' THEN 'crawl.started' WHEN 'click' THEN 'crawl.progress' WHEN 'purchase' THEN 'crawl.completed' WHEN 'error' THEN 'crawl.failed' ELSE 'other' END"


@query(
    f"""WITH e AS (SELECT *, {_JOB_STATUS} AS event FROM events)
        SELECT user_id AS job_id, arg_max(CASE event WHEN 'crawl.started' THEN 'running' WHEN 'crawl.completed' THEN 'completed'
             ELSE 'failed' END, event_id) FILTER (WHERE event NOT IN ('other', 'crawl.progress')) AS status,
          epoch_us(max(ts) FILTER (WHERE event = 'crawl.started')) AS started,
          epoch_us(max(ts) FILTER (WHERE event IN ('crawl.completed', 'crawl.failed'))) AS completed,
          arg_max(CAST(floor(value) AS BIGINT), event_id) FILTER (WHERE event IN ('crawl.progress', 'crawl.completed')) AS crawled
        FROM e WHERE event <> 'other' GROUP BY user_id"""
)
def fold_job_events(spark, d):
    events = load_table(spark, d, "events").select(
        F.col("user_id").alias("job_id"), F.expr(_JOB_STATUS).alias("event"), "ts", "event_id",
        F.struct(
            F.floor("value").alias("pages_crawled"), F.lit(None).cast("bigint").alias("pages_discovered"),
            F.lit(None).cast("bigint").alias("chunks_created"), F.lit(None).cast("string").alias("error"),
        ).alias("data"),
    )
    return progress.fold_job_events(events).select(
        "job_id", "status", F.unix_micros("started_at").alias("started"), F.unix_micros("completed_at").alias("completed"),
        F.col("total_urls_crawled").alias("crawled"),
    )


@query(
    """SELECT user_id AS agent_id, count(*) FILTER (WHERE event_type IN ('view', 'click')) AS crawled,
         CAST(sum(CASE WHEN event_type IN ('view', 'click') THEN floor(value) ELSE 0 END) AS BIGINT) AS total_chunks,
         count(*) FILTER (WHERE event_type = 'error') AS errors FROM events GROUP BY 1"""
)
def crawl_progress(spark, d):
    kind = F.col("event_type")
    events = runner.read_stream(spark, d, "events").select(
        F.col("user_id").alias("agent_id"),
        F.when(kind.isin("view", "click"), "page_crawled").otherwise(kind).alias("type"),
        F.floor("value").alias("chunks"),
    )
    return runner.run_update(progress.crawl_progress(events), "progress", ["agent_id"])


@query(
    """SELECT epoch_us(date_trunc('hour', ts)) AS window_start, event_type, count(*) AS events FROM events GROUP BY 1, 2"""
)
def events_per_window(spark, d):
    counts = progress.events_per_window(runner.read_stream(spark, d, "events"), "1 hour")
    return runner.run_update(counts, "windows", ["window_start", "event_type"]).withColumn(
        "window_start", F.unix_micros("window_start")
    )


@query(
    """WITH w AS (SELECT event_type, epoch_us(date_trunc('hour', ts)) - i * 3600000000 AS window_start
                  FROM events, (SELECT unnest(range(0, 6)) AS i)),
       m AS (SELECT epoch_us(max(ts)) - 86400000000 AS mark FROM events)
       SELECT window_start, event_type, count(*) AS events FROM w, m
       WHERE window_start + 6 * 3600000000 <= mark GROUP BY ALL"""
)
def closed_windows(spark, d):
    """Sliding windows of six hours, written once the watermark has closed them."""
    counts = progress.events_per_window(runner.read_stream(spark, d, "events"), "6 hours", "1 hour")
    return runner.run_append(counts, "closed").withColumn("window_start", F.unix_micros("window_start"))


@query(
    """SELECT user_id, event_type, CAST(date_trunc('day', ts) AS DATE)::VARCHAR AS day, count(*) OVER () AS kept
       FROM events GROUP BY ALL"""
)
def once_per_key(spark, d):
    """One row per user, event type and day of a stream."""
    events = runner.read_stream(spark, d, "events").select("ts", "user_id", "event_type", F.to_date("ts").cast("string").alias("day"))
    rows = runner.run_append(state.once_per_key(events, ["user_id", "event_type", "day"]), "once")
    total = rows.agg(F.count("*").alias("kept"))
    return rows.drop("ts").join(F.broadcast(total))


@query(
    f"""WITH e AS (SELECT *, {_JOB_STATUS} AS event FROM events),
       f AS (SELECT user_id AS job_id, arg_max(CASE event WHEN 'crawl.started' THEN 'running' WHEN 'crawl.completed' THEN 'completed'
               ELSE 'failed' END, (ts, event_id)) FILTER (WHERE event NOT IN ('other', 'crawl.progress')) AS status,
             epoch_us(max(ts) FILTER (WHERE event = 'crawl.started')) AS started,
             arg_max(CAST(floor(value) AS BIGINT), (ts, event_id)) FILTER (WHERE event IN ('crawl.progress', 'crawl.completed')) AS crawled,
             epoch_us(max(ts)) AS last FROM e WHERE event <> 'other' GROUP BY user_id),
       m AS (SELECT epoch_us(max(ts)) - 86400000000 AS mark FROM e WHERE event <> 'other')
       SELECT job_id, CASE WHEN status = 'running' AND last + 21600000000 <= mark THEN 'timed_out' ELSE status END AS status,
         started, crawled, last FROM f, m"""
)
def track_jobs(spark, d):
    """Job states of an event stream; six hours of silence end a running job."""
    events = runner.read_stream(spark, d, "events").select(
        F.col("user_id").alias("job_id"), "event_id", F.expr(_JOB_STATUS).alias("event"), "ts",
        F.floor("value").alias("pages_crawled"),
    )
    rows = runner.run_update(state.track_jobs(events, 6 * 3_600_000), "jobs", ["job_id"])
    return rows.select(
        "job_id", "status", F.unix_micros("started_at").alias("started"), F.col("total_urls_crawled").alias("crawled"),
        F.unix_micros("last_event_at").alias("last"),
    )


@query(
    """SELECT CAST(ts AS DATE)::VARCHAR AS date, CASE event_type WHEN 'click' THEN 'chat' WHEN 'view' THEN 'crawl' ELSE event_type END AS event_type,
         event_type IN ('click', 'view') AS accepted, count(*) AS events FROM events GROUP BY ALL"""
)
def stream_events(spark, d):
    """Usage events as a stream of files that is stopped in its middle and started again."""
    kind = F.col("event_type")
    table = load_table(spark, d, "events").select(
        "event_id", F.col("user_id").alias("agent_id"),
        F.when(kind == "click", "chat").when(kind == "view", "crawl").otherwise(kind).alias("event_type"),
        F.lit(None).cast("string").alias("payload"), F.col("ts").alias("created_at"),
    )
    files, out, checkpoint = (scratch_path(spark, f"usage-{n}") for n in ("files", "sink", "checkpoint"))
    table.repartition(4, "event_id").write.parquet(files)

    def stream():
        return spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(files)

    for running in sinks.stream_events(stream(), out, checkpoint, available_now=False):
        while not running.recentProgress and running.isActive:
            running.awaitTermination(1)
        running.stop()
    sinks.stream_events(stream(), out, checkpoint)
    accepted = spark.read.parquet(f"{out}/events").select("event_type", "created_at", F.lit(True).alias("accepted"))
    rejects = spark.read.parquet(f"{out}/rejects").select("event_type", "created_at", F.lit(False).alias("accepted"))
    rows = accepted.unionByName(rejects).withColumn("date", F.to_date("created_at").cast("string"))
    return rows.groupBy("date", "event_type", "accepted").agg(F.count("*").alias("events"))


@query(
    f"""WITH c AS ({sql.plain_chunks('documents', 'doc_id')})
        SELECT doc_id AS page_id, chunk_index, md5(content) AS digest FROM c WHERE NOT {sql.boilerplate('content')}"""
)
def ingest_stream(spark, d):
    pages = runner.read_stream(spark, d, "documents").select(
        F.col("doc_id").alias("page_id"), F.lit("").alias("title"), "text"
    )
    sink = scratch_path(spark, "ingest")
    ingest.ingest_stream(pages, sink, scratch_path(spark, "ingest-checkpoint"), buckets=16)
    return ingest.current_chunks(spark, sink).select("page_id", "chunk_index", F.md5("content").alias("digest"))


@query(
    """SELECT 'm' || page_id AS sitemap_url, url AS loc, false AS is_child FROM pages
       UNION ALL SELECT 'm' || page_id, 'sitemap-' || page_id || '.xml', true FROM pages"""
)
def parse_sitemaps(spark, d):
    pages = load_table(spark, d, "pages", ["page_id", "url"])
    bodies = pages.select(
        F.concat(F.lit("m"), "page_id").alias("sitemap_url"),
        F.concat(
            F.lit("<urlset><url><loc> "), "url", F.lit(" </loc></url><LOC>sitemap-"),
            "page_id", F.lit(".xml</LOC></urlset>"),
        ).alias("body"),
    )
    return sitemaps.parse_sitemaps(bodies)


_BODY = "'User-agent: *' || chr(10) || 'Disallow: /' || lang || '/' || chr(10) || 'Allow: /' || lang || '/1' || chr(10) || 'Crawl-delay: 2'"


def _robots(spark, d):
    """One file per host; it closes the host's first language, but for numbers in 1."""
    hosts = (
        load_table(spark, d, "pages", ["url"])
        .select(U.host(F.col("url")).alias("host"), F.regexp_extract("url", "/([a-z]{2})/", 1).alias("lang"))
        .groupBy("host")
        .agg(F.min("lang").alias("lang"))
    )
    nl = F.lit("\n")
    return hosts.select(
        "host",
        F.concat(
            F.lit("User-agent: *\nDisallow: /"), "lang", F.lit("/\nAllow: /"), "lang", F.lit("/1"), nl,
            F.lit("Crawl-delay: 2\nSitemap: https://"), "host", F.lit("/sitemap.xml"),
        ).alias("body"),
    )


_HOSTS = f"hosts AS (SELECT {sql.host('url')} AS host, min(regexp_extract(url, '/([a-z]{{2}})/', 1)) AS lang FROM pages GROUP BY 1)"


@query(
    f"""WITH {_HOSTS} SELECT host, '*' AS agent, 'disallow' AS rule, '/' || lang || '/' AS path FROM hosts
        UNION ALL SELECT host, '*', 'allow', '/' || lang || '/1' FROM hosts
        UNION ALL SELECT host, '*', 'crawl-delay', '2' FROM hosts
        UNION ALL SELECT host, NULL, 'sitemap', 'https://' || host || '/sitemap.xml' FROM hosts"""
)
def parse_robots(spark, d):
    return robots.parse_robots(_robots(spark, d)).select("host", "agent", "rule", F.col("value").alias("path"))


@query(
    f"""WITH {_HOSTS}, p AS (SELECT page_id, {sql.host('url')} AS host, regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)', 1) AS path FROM pages)
        SELECT page_id, NOT (starts_with(path, '/' || lang || '/') AND NOT starts_with(path, '/' || lang || '/1')) AS allowed
        FROM p JOIN hosts USING (host)"""
)
def robots_filter(spark, d):
    pages = load_table(spark, d, "pages", ["page_id", "url"])
    return robots.robots_filter(pages, robots.parse_robots(_robots(spark, d)), "AnyBot").select("page_id", "allowed")


@query(f"WITH {_HOSTS} SELECT host, length(host) % 2 = 0 AS allowed FROM hosts")
def crawl_allowed(spark, d):
    odd = F.length("host") % 2 == 1
    body = F.when(odd, F.concat("body", F.lit("\nDISALLOW:  / \n"))).otherwise(F.col("body"))
    return _robots(spark, d).select("host", robots.crawl_allowed(body).alias("allowed"))


@query(
    """SELECT conv_id || '-' || turn AS id, md5(replace(text, chr(10), ' ')) AS digest,
         round(CASE WHEN turn % 2 = 0 THEN (turn % 10) / 10.0 ELSE 0 END, 6) AS confidence, turn % 2 = 1 AS sources_only FROM conversations"""
)
def parse_sse(spark, d):
    turns = load_table(spark, d, "conversations")
    half = F.floor(F.length("text") / 2).cast("int")
    text = F.replace("text", F.lit("\n"), F.lit(" "))

    def message(content):
        return F.concat(F.lit("data: "), F.to_json(F.struct(F.lit("text").alias("type"), content.alias("content"))), F.lit("\n\n"))

    sources = F.when(
        F.col("turn") % 2 == 0,
        F.concat(
            F.lit('data: {"type":"sources","answered_from_sources_only":false,"confidence":'), (F.col("turn") % 10) / 10, F.lit("}\n\n")
        ),
    ).otherwise(F.lit('data: {"type":"sources","confidence":null}\n\n'))
    body = F.concat(
        message(F.left(text, half)), F.lit("data: {bad json\n\n"), message(F.substring(text, half + 1, F.length(text))), sources, F.lit("data: [DONE]\n")
    )
    parsed = transcripts.parse_sse(turns.select(F.concat_ws("-", "conv_id", "turn").alias("id"), body.alias("body")))
    return parsed.select("id", F.md5("answer").alias("digest"), F.round("confidence", 6).alias("confidence"), "sources_only")


@query(
    """SELECT user_id AS agent_id, CASE event_type WHEN 'click' THEN 'chat' ELSE 'crawl' END AS event_type, count(*) AS events
       FROM events WHERE event_type IN ('click', 'view') GROUP BY 1, 2"""
)
def append_events(spark, d):
    kind = F.col("event_type")
    events = load_table(spark, d, "events").select(
        "event_id", F.col("user_id").alias("agent_id"),
        F.when(kind == "click", "chat").when(kind == "view", "crawl").otherwise(kind).alias("event_type"),
        F.lit(None).cast("string").alias("payload"), F.col("ts").alias("created_at"),
    )
    path = scratch_path(spark, "usage")
    sinks.append_events(events, path)
    return sinks.read_events(spark, path).groupBy("agent_id", "event_type").agg(F.count("*").alias("events"))


@query(
    """SELECT source AS agent_id, name, digest FROM (SELECT source, 'agent-' || source || '-' || left(replace(replace('https://a.b/' || doc_id, ':', '%3A'), '/', '%2F'), 100) || '.md' AS name,
         md5('# ' || lang || chr(10) || 'Source: https://a.b/' || doc_id || chr(10) || chr(10) || text) AS digest,
         row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents) WHERE rn <= 50"""
)
def export_documents(spark, d):
    pages = load_table(spark, d, "documents").select(
        F.col("source").alias("agent_id"), F.col("doc_id").alias("page_id"), F.concat(F.lit("https://a.b/"), "doc_id").alias("url"),
        F.col("lang").alias("title"), F.col("text").alias("clean_markdown"), F.lit("crawled").alias("crawl_status"),
    )
    return sinks.export_documents(pages, 50, [F.col("page_id")]).select("agent_id", "name", F.md5("content").alias("digest"))


_ESCAPED = r"replace(replace(replace(replace(replace(replace(x, '\\n', chr(10)), '\\r', ''), '\\t', ' '), '\\(', '('), '\\)', ')'), '\\\\', '\\')"


@query(
    rf"""WITH b AS (SELECT doc_id, 'BT (' || regexp_replace(text, '([()\\])', '\\\1', 'g') || ') Tj ET' AS raw FROM documents),
        p AS (SELECT doc_id, list_filter(
                list_transform(regexp_extract_all(raw, '\(([^)]+)\)\s*Tj', 1), lambda x: {sql.trim(_ESCAPED)})
                || list_filter(list_transform(regexp_extract_all(raw, '[\x20-\x7E]{{20,}}'), lambda x: {sql.trim('x')}),
                     lambda x: NOT (contains(x, '<<') OR contains(x, '>>') OR contains(x, '/Type'))),
                lambda x: x <> '') AS l FROM b),
        t AS (SELECT doc_id, {sql.trim("array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), chr(10))")} AS t FROM p)
        SELECT doc_id, md5(CASE WHEN coalesce(t, '') = '' THEN '[PDF content could not be extracted]' ELSE t END) AS digest FROM t"""
)
def pdf_text(spark, d):
    """Each document is written as a file of PDF text operators and read back by the file source."""
    docs = load_table(spark, d, "documents", ["doc_id", "text"], spread=True)
    body = F.concat(F.lit("BT ("), F.regexp_replace("text", r"([()\\])", r"\\$1"), F.lit(") Tj ET"))
    rows = docs.select("doc_id", F.concat(F.coalesce(body, F.lit("")), F.lit("\n")).cast("binary").alias("content"))
    path = scratch_path(spark, "pdf")
    n = docs.count()
    folders = [f"{path}/{i}" for i in range(n // FILES_LISTED + 1)]
    if sinks.write_files(rows, "doc_id", "content", folders) != n:
        raise RuntimeError(f"not every document has its file below {path}")
    # the driver lists one folder at a time and forgets it, so its memory does not grow with the files
    out = scratch_path(spark, "texts")
    parts = [f"{out}/{i}" for i in range(len(folders))]
    with many_files(spark, max(spark.sparkContext.defaultParallelism, FILES_LISTED // FILES_READ)):
        for folder, part in zip(folders, parts):
            texts = pdf.pdf_text(spark, folder).filter("skipped is null")
            doc_id = F.regexp_extract("path", r"doc_id=(-?\d*)\.[^/]*$", 1).try_cast("long")
            texts.select(doc_id.alias("doc_id"), F.md5("text").alias("digest")).write.parquet(part)
            del texts
            gc.collect()  # a frame lies in a cycle of Python objects and holds its folder's list
    return spark.read.schema("doc_id long, digest string").parquet(*parts)
