"""Progress, job and window aggregates for streams and tables alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

JOB_EVENTS = ("crawl.started", "crawl.progress", "crawl.completed", "crawl.failed")


def crawl_progress(events: DataFrame, site: str = "agent_id") -> DataFrame:
    """Running totals per site: pages crawled, chunks, errors."""
    kind = F.col("type")
    return events.groupBy(site).agg(
        F.count_if(kind == "page_crawled").alias("crawled"),
        F.sum(F.when(kind == "page_crawled", F.col("chunks")).otherwise(0)).alias("total_chunks"),
        F.count_if(kind == "error").alias("errors"),
    )


def events_per_window(
    events: DataFrame, size: str = "1 hour", slide: str | None = None, late: str = "1 day", time: str = "ts"
) -> DataFrame:
    """Events per type and tumbling or sliding window."""
    return (
        events.withWatermark(time, late)
        .groupBy(F.window(time, size, slide or size).alias("w"), "event_type")
        .agg(F.count("*").alias("events"))
        .select(F.col("w.start").alias("window_start"), "event_type", "events")
    )


def keys_per_window(
    events: DataFrame, size: str, key: str = "key", late: str = "1 day", time: str = "ts", failed: Column | None = None
) -> DataFrame:
    """Events, and with ``failed`` failures, per key and tumbling window."""
    counts = [F.count("*").alias("events")]
    if failed is not None:
        counts.append(F.count_if(failed).alias("failures"))
    return (
        events.withWatermark(time, late)
        .groupBy(F.window(time, size).alias("w"), key)
        .agg(*counts)
        .withColumn("window_start", F.col("w.start"))
        .drop("w")
    )


def fold_job_events(events: DataFrame) -> DataFrame:
    """State of each job after its events; unknown events are dropped.

    ``events`` has ``job_id, event, ts, event_id`` and ``data`` with the fields
    ``pages_crawled, pages_discovered, chunks_created, error``. Progress and
    final statistics set the counters, each field by its last event; an aggregate
    that combines in the map tasks, and a stream aggregate as well.
    """
    known = events.filter(F.col("event").isin(*JOB_EVENTS) & F.col("job_id").isNotNull())
    order = F.struct("ts", "event_id")
    kind = F.col("event")

    def last(value: Column, *kinds: str) -> Column:
        return F.max_by(value, F.when(kind.isin(*kinds), order))

    data = F.col("data")
    counters = ("crawl.progress", "crawl.completed")
    final = ("crawl.completed", "crawl.failed")
    changes = ("crawl.started", *final)
    status = (
        F.when(kind == "crawl.started", "running").when(kind == "crawl.completed", "completed").otherwise("failed")
    )
    return known.groupBy("job_id").agg(
        last(status, *changes).alias("status"),
        last(F.col("ts"), "crawl.started").alias("started_at"),
        last(F.col("ts"), *final).alias("completed_at"),
        last(F.coalesce(data["pages_crawled"], F.lit(0)), *counters).alias("total_urls_crawled"),
        last(F.coalesce(data["pages_discovered"], F.lit(0)), *counters).alias("total_urls_discovered"),
        last(F.coalesce(data["chunks_created"], F.lit(0)), *counters).alias("total_chunks_created"),
        last(F.coalesce(data["error"], F.lit("Unknown error")), "crawl.failed").alias("error_message"),
    )
