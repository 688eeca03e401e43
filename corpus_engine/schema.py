"""Table schemas of a knowledge base, and their value constraints."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Column lists as DDL strings, for readers with an explicit schema.
PAGES = (
    "page_id bigint, agent_id bigint, crawl_job_id bigint, url string, canonical_url string, "
    "title string, language string, status_code int, etag string, last_modified string, "
    "content_hash string, robots_allowed boolean, clean_markdown string, previous_markdown string, "
    "raw_html_length bigint, page_type string, crawl_status string, skip_reason string, "
    "last_crawled_at timestamp"
)
CHUNKS = (
    "chunk_id string, agent_id bigint, page_id bigint, chunk_index int, heading_path string, "
    "content string, snippet string, embedding array<float>, language string, token_count bigint, "
    "rank_weight double, content_hash string"
)
SITES = (
    "agent_id bigint, org_id bigint, user_id bigint, name string, slug string, root_url string, "
    "status string, visibility string, created_at timestamp, "
    "crawl_stats struct<discovered_urls: bigint, total_pages: bigint, crawled_pages: bigint, "
    "total_chunks: bigint, errors: bigint, pages_per_minute: double, eta_seconds: double, "
    "embed_queue_depth: bigint, browser_render_share: double, current_stage: string, "
    "error_message: string, started_at: timestamp, completed_at: timestamp>"
)
CRAWL_JOBS = (
    "job_id bigint, agent_id bigint, status string, job_type string, total_urls_discovered bigint, "
    "total_urls_crawled bigint, total_urls_skipped bigint, total_urls_failed bigint, "
    "total_chunks_created bigint, error_message string, started_at timestamp, completed_at timestamp, "
    "created_at timestamp"
)
CONVERSATIONS = "conversation_id bigint, agent_id bigint, session_id string, title string, created_at timestamp"
MESSAGES = (
    "message_id bigint, conversation_id bigint, role string, content string, "
    "sources array<struct<url: string, title: string, snippet: string, heading_path: string, "
    "similarity: double>>, model_used string, confidence double, feedback string, created_at timestamp"
)
USAGE_EVENTS = "event_id bigint, agent_id bigint, event_type string, payload string, created_at timestamp"
SHARE_LINKS = (
    "link_id bigint, agent_id bigint, token string, expires_at timestamp, max_uses int, "
    "use_count int, revoked_at timestamp"
)
POLICIES = (
    "agent_id bigint, enabled boolean, frequency_hours int, last_run_at timestamp, next_run_at timestamp"
)

# The allowed values of each constrained column.
ENUMS = {
    "plan": ("free", "pro", "enterprise"),
    "member_role": ("owner", "admin", "member"),
    "site_status": ("draft", "pending", "crawling", "processing", "ready", "error"),
    "visibility": ("public", "private", "passcode"),
    "job_status": ("queued", "running", "completed", "failed", "cancelled"),
    "job_type": ("full", "incremental", "single_page"),
    "page_type": ("html", "pdf", "other"),
    "crawl_status": ("pending", "crawled", "skipped", "blocked", "failed"),
    "message_role": ("user", "assistant", "system"),
    "usage_event": ("chat", "crawl", "embed", "share_view", "agent_created"),
    "billing_status": ("active", "suspended", "cancelled"),
    "feedback": ("positive", "negative"),
}
NULLABLE_ENUMS = ("feedback", "page_type")

# Bounds of a recrawl interval in hours.
FREQUENCY_HOURS = (1, 8760)


def enum_ok(c: Column, enum: str) -> Column:
    inside = F.coalesce(c.isin(*ENUMS[enum]), F.lit(False))
    return inside | c.isNull() if enum in NULLABLE_ENUMS else inside


def range_ok(c: Column, low: int, high: int) -> Column:
    return F.coalesce(c.between(low, high), F.lit(False))


def validate_enums(
    df: DataFrame, enums: dict[str, str], ranges: dict[str, tuple[int, int]] | None = None
) -> DataFrame:
    """``df`` with ``violations``: the columns whose value is not allowed."""
    checks = [(name, enum_ok(F.col(name), enum)) for name, enum in enums.items()]
    checks += [(name, range_ok(F.col(name), *r)) for name, r in (ranges or {}).items()]
    found = F.filter(
        F.array(*[F.when(~ok, F.lit(name)) for name, ok in checks]), lambda v: v.isNotNull()
    )
    return df.withColumn("violations", found)


def split_valid(df: DataFrame, enums: dict[str, str], ranges=None) -> tuple[DataFrame, DataFrame]:
    """Accepted rows and rejects."""
    checked = validate_enums(df, enums, ranges)
    return checked.filter(F.size("violations") == 0).drop("violations"), checked.filter(
        F.size("violations") > 0
    )


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))
