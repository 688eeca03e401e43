"""Change detection and maintenance of page and chunk tables.

All steps are equi-joins on page or (page, hash) keys. Results are whole new
table versions; on a table format with row-level updates the same frames can
feed ``DataFrame.mergeInto``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpus_engine.functions.vectors import valid_embedding

PAGE_KEY = ["agent_id", "url"]
# written for every outcome; all other columns only for crawled pages
STATUS_COLUMNS = ("crawl_status", "skip_reason", "crawl_job_id", "last_crawled_at")


def classify_pages(fetched: DataFrame, existing: DataFrame, incremental: bool = True) -> DataFrame:
    """Fetched pages with ``outcome``: new, changed, or why they are skipped."""
    known = existing.select(*PAGE_KEY, F.col("content_hash").alias("_old"), F.lit(True).alias("_known"))
    joined = fetched.join(known, PAGE_KEY, "left")
    outcome = F.when(F.col("_known").isNull(), "new").otherwise("changed")
    if incremental:
        outcome = (
            F.when(F.col("status_code") == 304, "not_modified")
            .when(F.col("_old") == F.col("content_hash"), "content_unchanged")
            .otherwise(outcome)
        )
    return joined.withColumn("outcome", outcome).drop("_old", "_known")


def latest_change(changes: DataFrame) -> DataFrame:
    """The last change of each page, by a combining aggregate."""
    rest = [c for c in changes.columns if c not in PAGE_KEY]
    return changes.groupBy(*PAGE_KEY).agg(F.max_by(F.struct(*rest), "last_crawled_at").alias("_r")).select(
        *PAGE_KEY, "_r.*"
    )


def upsert_pages(existing: DataFrame, changes: DataFrame) -> DataFrame:
    """The page table after a crawl.

    Crawled rows replace the page and keep its old text as the previous one;
    failed and skipped rows touch the status columns only.
    """
    new = latest_change(changes).withColumn("_new", F.lit(True))
    e, n = existing.alias("e"), new.alias("n")
    joined = e.join(n, PAGE_KEY, "full")
    touched = F.col("n._new").isNotNull()
    crawled = touched & (F.col("n.crawl_status") == "crawled")

    def merged(c: str) -> Column:
        old = F.col(f"e.{c}")
        if c == "previous_markdown":
            return F.when(crawled, F.col("e.clean_markdown")).otherwise(old)
        if c not in new.columns:
            return old
        return F.when(touched if c in STATUS_COLUMNS else crawled, F.col(f"n.{c}")).otherwise(old)

    columns = [c for c in existing.columns if c not in PAGE_KEY]
    return joined.select(*PAGE_KEY, *[merged(c).alias(c) for c in columns])


def diff_chunks(new: DataFrame, existing: DataFrame, crawled: DataFrame | None = None) -> DataFrame:
    """Chunk changes of the crawled pages: unchanged, added, removed.

    ``new`` has ``page_id, chunk_index, content_hash``; ``existing`` also has
    ``chunk_id``. Unchanged chunks keep their old row and index; of several old
    chunks with one hash only the last stays. ``crawled`` names pages that may
    have lost all their chunks.
    """
    pages = new.select("page_id")
    if crawled is not None:
        pages = pages.unionByName(crawled.select("page_id"))
    old = existing.join(pages.distinct(), "page_id", "left_semi")
    wanted = new.select("page_id", "content_hash").distinct()
    kept = (
        old.join(wanted, ["page_id", "content_hash"], "left_semi")
        .groupBy("page_id", "content_hash")
        .agg(F.max_by(F.struct("chunk_id", "chunk_index"), "chunk_id").alias("_k"))
        .select("page_id", "content_hash", "_k.chunk_id", "_k.chunk_index")
    )
    removed = old.join(kept.select("chunk_id"), "chunk_id", "left_anti")
    stored = old.select("page_id", "content_hash").distinct()
    added = new.join(stored, ["page_id", "content_hash"], "left_anti")
    id_type = existing.schema["chunk_id"].dataType
    cols = ["page_id", "content_hash", "chunk_index", "chunk_id"]
    return (
        kept.select(*cols, F.lit("unchanged").alias("change"))
        .unionByName(removed.select(*cols, F.lit("removed").alias("change")))
        .unionByName(
            added.withColumn("chunk_id", F.lit(None).cast(id_type)).select(*cols, F.lit("added").alias("change"))
        )
    )


def apply_chunk_diff(existing: DataFrame, diff: DataFrame, embedded: DataFrame, dim: int) -> DataFrame:
    """The chunk table after a crawl; added chunks need a valid embedding."""
    gone = diff.filter(F.col("change") == "removed").select("chunk_id")
    added = diff.filter(F.col("change") == "added").select("page_id", "content_hash", "chunk_index")
    fresh = (
        embedded.filter(valid_embedding(F.col("embedding"), dim))
        .join(added, ["page_id", "content_hash", "chunk_index"], "left_semi")
        .withColumn("rank_weight", F.lit(1.0))
    )
    return existing.join(gone, "chunk_id", "left_anti").unionByName(fresh, allowMissingColumns=True)


def line_changes(current: Column, previous: Column) -> Column:
    """Array of ``(type, line)``: lines are compared place by place."""
    lines = F.zip_with(
        F.split(F.coalesce(previous, F.lit("")), "\n"),
        F.split(F.coalesce(current, F.lit("")), "\n"),
        lambda p, c: F.struct(F.coalesce(p, F.lit("")).alias("p"), F.coalesce(c, F.lit("")).alias("c")),
    )

    def entry(kind: str, line: Column) -> Column:
        return F.struct(F.lit(kind).alias("type"), line.alias("line"))

    def compare(l: Column) -> Column:
        both = F.when(
            l["p"] == l["c"], F.array(entry("unchanged", l["c"]))
        ).otherwise(F.array(entry("removed", l["p"]), entry("added", l["c"])))
        return F.filter(both, lambda e: e["line"] != "")

    return F.flatten(F.transform(lines, compare))


def page_line_diff(pages: DataFrame) -> DataFrame:
    """Pages with their line changes, counts per type, and ``has_previous``."""
    diffed = pages.withColumn(
        "diff", line_changes(F.col("clean_markdown"), F.col("previous_markdown"))
    ).withColumn("has_previous", F.coalesce(F.col("previous_markdown") != "", F.lit(False)))

    def count(kind: str) -> Column:
        return F.size(F.filter("diff", lambda e: e["type"] == kind))

    return diffed.withColumns({kind: count(kind) for kind in ("added", "removed", "unchanged")})


def full_refresh(table: DataFrame, sites: DataFrame) -> DataFrame:
    """A table without the rows of the sites about to be crawled afresh."""
    return table.join(sites.select("agent_id"), "agent_id", "left_anti")
