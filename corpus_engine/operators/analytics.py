"""Reporting over all sites at once.

Every report groups by site and combines in the map tasks; lists hold days or
ranked samples only, so none grows with a site's rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpus_engine.functions.text import or_else
from corpus_engine.operators.ranking import latest_per_site
from corpus_engine.runtime import top_per_group

LOW_CONFIDENCE = 0.4
EVAL_WARNING_RATE = 0.3
ACTIVE_STATUSES = ("pending", "crawling", "processing")

# Sample presets (pages, characters) for profile, extraction, starters.
SAMPLES = {"profile": (10, 1000), "extract": (8, 2800), "starters": (5, 800)}

# Gauge names (below a prefix of the user's choice) and help texts.
GAUGES = (
    ("agents_total", "Total number of agents"),
    ("agents_ready", "Number of ready agents"),
    ("conversations_total", "Total conversations"),
    ("messages_total", "Total messages"),
    ("chunks_total", "Total indexed chunks"),
    ("pages_total", "Total crawled pages"),
    ("crawl_jobs_active", "Currently running crawl jobs"),
    ("chat_requests_1h", "Chat requests in last hour"),
)


def _since(as_of: Column, days: int) -> Column:
    return as_of - F.make_dt_interval(F.lit(days))


def messages_with_site(messages: DataFrame, conversations: DataFrame) -> DataFrame:
    """Messages with the site of their conversation."""
    return messages.join(conversations.select("conversation_id", "agent_id"), "conversation_id")


def site_analytics(
    conversations: DataFrame, messages: DataFrame, as_of: Column, days: int = 30
) -> DataFrame:
    """Conversation, session and answer figures of the last ``days`` per site."""
    start = _since(as_of, days)
    conv = (
        conversations.filter(F.col("created_at") >= start)
        .groupBy("agent_id")
        .agg(
            F.countDistinct("conversation_id").alias("total_conversations"),
            F.countDistinct("session_id").alias("unique_sessions"),
        )
    )
    answers = messages.filter((F.col("role") == "assistant") & (F.col("created_at") >= start))
    msg = (
        messages_with_site(answers, conversations)
        .groupBy("agent_id")
        .agg(
            F.count("*").alias("total_messages"),
            F.avg("confidence").alias("avg_confidence"),
            F.count_if(F.col("confidence") < LOW_CONFIDENCE).alias("low_confidence_count"),
        )
    )
    counts = ["total_conversations", "unique_sessions", "total_messages", "low_confidence_count"]
    return conv.join(msg, "agent_id", "full").fillna(0, subset=counts)


def messages_by_day(
    conversations: DataFrame, messages: DataFrame, as_of: Column, days: int = 30
) -> DataFrame:
    """Per site an array of ``{date, count}`` over all roles, in date order."""
    recent = messages.filter(F.col("created_at") >= _since(as_of, days))
    daily = (
        messages_with_site(recent, conversations)
        .groupBy("agent_id", F.to_date("created_at").alias("date"))
        .agg(F.count("*").alias("count"))
    )
    # at most one entry per day of the window
    return daily.groupBy("agent_id").agg(
        F.sort_array(F.collect_list(F.struct("date", "count"))).alias("messages_by_day")
    )


def usage_summary(
    events: DataFrame, as_of: Column, days: int = 30, limit: int | None = None, site: str = "agent_id"
) -> DataFrame:
    """Events per type and site; with ``limit``, over the newest so many events of each site only."""
    recent = events.filter(F.col("created_at") >= _since(as_of, days))
    if limit is not None:
        recent = top_per_group(
            recent, [site], [F.col("created_at").desc(), F.col("event_id").desc()], limit
        )
    return recent.groupBy(site, "event_type").agg(F.count("*").alias("events"))


def model_usage(messages: DataFrame, conversations: DataFrame, n: int = 10) -> DataFrame:
    """Answers per model in the ``n`` newest conversations of each site."""
    newest = latest_per_site(conversations, n, [F.col("created_at").desc(), F.col("conversation_id").desc()])
    answers = messages.filter((F.col("role") == "assistant") & F.col("model_used").isNotNull())
    return messages_with_site(answers, newest).groupBy("agent_id", "model_used").agg(F.count("*").alias("answers"))


def site_stats(pages: DataFrame, chunks: DataFrame) -> DataFrame:
    """Page and chunk counts per site."""
    p = pages.groupBy("agent_id").agg(F.count("*").alias("pages"))
    c = chunks.groupBy("agent_id").agg(F.count("*").alias("chunks"))
    return p.join(c, "agent_id", "full").fillna(0, subset=["pages", "chunks"])


def page_status_counts(pages: DataFrame) -> DataFrame:
    """Total, crawled and failed pages per site."""
    status = F.col("crawl_status")
    return pages.groupBy("agent_id").agg(
        F.count("*").alias("total"),
        F.count_if(status == "crawled").alias("crawled"),
        F.count_if(status == "failed").alias("failed"),
    )


def changed_page_count(pages: DataFrame) -> DataFrame:
    """Pages per site that have an earlier version."""
    return pages.groupBy("agent_id").agg(F.count("previous_markdown").alias("changed_pages"))


def dashboard_stats(sites: DataFrame, newest: int = 6, owner: str = "user_id") -> DataFrame:
    """Totals over the newest sites of each owner."""
    top = top_per_group(sites, [owner], [F.col("created_at").desc(), F.col("agent_id").desc()], newest)
    return top.groupBy(owner).agg(
        F.count("*").alias("sites"),
        F.count_if(F.col("status") == "ready").alias("ready"),
        F.count_if(F.col("status").isin(*ACTIVE_STATUSES)).alias("active"),
        F.sum(F.coalesce("crawled_pages", F.lit(0))).alias("indexed_pages"),
    )


def eval_summary(results: DataFrame, run: str = "run_id") -> DataFrame:
    """Passed and failed cases per run; ``warning`` above 30 % failures."""
    return (
        results.groupBy(run)
        .agg(
            F.count("*").alias("total"),
            F.count_if("passed").alias("passed"),
            F.count_if(~F.col("passed")).alias("failed"),
        )
        .withColumn("failure_rate", F.col("failed") / F.col("total"))
        .withColumn("warning", F.col("failure_rate") > EVAL_WARNING_RATE)
    )


def failed_questions(results: DataFrame, run: str = "run_id") -> DataFrame:
    """The questions behind each warning, as rows: a run may have any number."""
    warned = eval_summary(results, run).filter("warning").select(run)
    return results.filter(~F.col("passed")).join(warned, run, "left_semi").select(run, "question")


def platform_counts(
    sites: DataFrame,
    conversations: DataFrame,
    messages: DataFrame,
    chunks: DataFrame,
    pages: DataFrame,
    jobs: DataFrame,
    events: DataFrame,
    as_of: Column,
    prefix: str = "platform",
) -> DataFrame:
    """One ``(position, metric, value)`` row per gauge."""

    def one(df: DataFrame, *values: tuple[int, Column]) -> DataFrame:
        counted = df.agg(*[v.alias(f"g{i}") for i, v in values])
        return counted.select(
            F.explode(
                F.array(
                    *[
                        F.struct(F.lit(i).alias("position"), F.lit(f"{prefix}_{GAUGES[i][0]}").alias("metric"), F.col(f"g{i}").alias("value"))
                        for i, _ in values
                    ]
                )
            ).alias("g")
        ).select("g.*")

    every = F.count("*")
    hour_ago = as_of - F.make_dt_interval(hours=F.lit(1))
    parts = [
        one(sites, (0, every), (1, F.count_if(F.col("status") == "ready"))),
        one(conversations, (2, every)),
        one(messages, (3, every)),
        one(chunks, (4, every)),
        one(pages, (5, every)),
        one(jobs, (6, F.count_if(F.col("status") == "running"))),
        one(events, (7, F.count_if((F.col("event_type") == "chat") & (F.col("created_at") >= hour_ago)))),
    ]
    return reduce(DataFrame.unionByName, parts)


def metrics_exposition(counts: DataFrame) -> DataFrame:
    """Gauges as text: three lines and a blank one each, in order."""
    helps = F.array(*[F.lit(text) for _, text in GAUGES])
    m = F.col("metric")
    lines = F.array(
        F.concat_ws(" ", F.lit("# HELP"), m, F.get(helps, F.col("position"))),
        F.concat_ws(" ", F.lit("# TYPE"), m, F.lit("gauge")),
        F.concat_ws(" ", m, F.col("value").cast("string")),
        F.lit(""),
    )
    return (
        counts.select("position", F.posexplode(lines).alias("part", "line"))
        .select((F.col("position") * 4 + F.col("part")).alias("line_no"), "line")
        .orderBy("line_no")
    )


def quota_check(sites: DataFrame, memberships: DataFrame, organizations: DataFrame) -> DataFrame:
    """Users at or over the site quota of their organization (0 = unlimited)."""
    owned = sites.groupBy("user_id").agg(F.count("*").alias("sites"))
    quotas = memberships.join(
        organizations.filter(F.col("quota_agents") > 0).select("org_id", "quota_agents"), "org_id"
    )
    return owned.join(quotas, "user_id").filter(F.col("sites") >= F.col("quota_agents")).select(
        "user_id", "org_id", "sites", "quota_agents"
    )


def crawl_totals(results: DataFrame) -> DataFrame:
    """Page, chunk, error and skip totals per job."""
    status = F.col("crawl_status")
    skipped = F.count_if(status.isin("skipped", "blocked"))
    crawled = F.count_if(status.isin("crawled", "failed"))
    return results.groupBy("job_id").agg(
        crawled.alias("total_pages"),
        F.sum(F.when(status == "crawled", F.col("chunks")).otherwise(0)).alias("total_chunks"),
        F.count_if(status == "failed").alias("errors"),
        skipped.alias("skipped"),
        (crawled + skipped).alias("discovered"),
    )


def skip_reasons(results: DataFrame) -> DataFrame:
    """Skipped pages per reason, with the status that the reason gives."""
    status = F.when(F.col("skip_reason") == "robots.txt", "blocked").otherwise("skipped")
    return (
        results.filter(F.col("skip_reason").isNotNull())
        .groupBy("skip_reason", status.alias("crawl_status"))
        .agg(F.count("*").alias("pages"))
    )


def sample_context(
    pages: DataFrame, sample: str = "profile", order: list[Column] | None = None, site: str = "agent_id"
) -> DataFrame:
    """A few clipped pages per site as one text."""
    k, clip = SAMPLES[sample]
    default = [F.col("raw_html_length").desc()] if sample == "profile" else [F.col("last_crawled_at").desc()]
    rows = pages.filter(F.col("crawl_status") == "crawled")
    if sample == "profile":
        rows = rows.filter(F.col("clean_markdown").isNotNull())
    top = top_per_group(rows, [site], order or [*default, F.col("url")], k)
    body = F.left(F.coalesce("clean_markdown", F.lit("")), F.lit(clip))
    name = or_else(F.col("title"), F.col("url"))
    text = {
        "profile": F.concat(F.lit("--- Page: "), name, F.lit(" ---\n"), body),
        "extract": F.concat(
            F.lit("## Source "), F.col("rn").cast("string"), F.lit("\nURL: "), F.col("url"),
            F.lit("\nTitle: "), name, F.lit("\n"), body,
        ),
        "starters": F.concat(F.lit("# "), or_else(F.col("title"), F.lit("Page")), F.lit("\n"), body),
    }[sample]
    glue = "\n\n---\n\n" if sample == "starters" else "\n\n"
    ordered = F.sort_array(F.collect_list(F.struct("rn", text.alias("text"))))
    return top.groupBy(site).agg(
        F.array_join(F.transform(ordered, lambda s: s["text"]), glue).alias("context")
    )
