"""Crawl jobs, recrawl policies and answer evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_FREQUENCY_HOURS = 24

# Stage of a job by its status.
STAGES = {
    "queued": "queued",
    "completed": "ready",
    "failed": "failed",
    "cancelled": "failed",
    "running": "fetching",
}

EVAL_CASES = (
    "array<struct<question: string, expected_answer_contains: array<string>, "
    "expected_min_confidence: double, expected_sources_only: boolean>>"
)


def nonzero(*cs: Column) -> Column:
    """First value that is neither null nor zero, else zero."""
    return F.coalesce(*[F.nullif(c, F.lit(0)) for c in cs], F.lit(0))


def _hours(c: Column) -> Column:
    return F.make_dt_interval(hours=c)


def due_recrawls(policies: DataFrame, sites: DataFrame, as_of: Column) -> DataFrame:
    """Queued jobs for the due policies of sites that are not being crawled."""
    due = policies.filter(F.col("enabled") & (F.col("next_run_at") <= as_of))
    return (
        due.join(sites.select("agent_id", "root_url", "user_id", "status"), "agent_id")
        .filter(F.col("status") != "crawling")
        .select(
            "agent_id",
            "root_url",
            "user_id",
            F.lit("queued").alias("status"),
            F.lit("incremental").alias("job_type"),
            as_of.alias("last_run_at"),
            (as_of + _hours(F.col("frequency_hours"))).alias("next_run_at"),
        )
    )


def upsert_policy(policies: DataFrame, changes: DataFrame, as_of: Column) -> DataFrame:
    """Policies after edits; a disabled policy has no next run."""
    hours = nonzero(F.col("n.frequency_hours"), F.lit(DEFAULT_FREQUENCY_HOURS)).cast("int")
    joined = policies.alias("p").join(
        changes.withColumn("_new", F.lit(True)).alias("n"), "agent_id", "full"
    )
    edited = F.col("n._new").isNotNull()
    run = F.when(F.coalesce("n.enabled", F.lit(False)), as_of + _hours(hours))
    return joined.select(
        "agent_id",
        F.when(edited, F.coalesce("n.enabled", F.lit(True))).otherwise(F.col("p.enabled")).alias("enabled"),
        F.when(edited, hours).otherwise(F.col("p.frequency_hours")).alias("frequency_hours"),
        F.when(edited, run).otherwise(F.col("p.next_run_at")).alias("next_run_at"),
    )


def job_metrics(jobs: DataFrame, as_of: Column) -> DataFrame:
    """Progress figures of jobs; ``stats`` holds the site's crawl statistics."""
    s = F.col("stats")
    start = F.coalesce("started_at", s["started_at"])
    end = F.coalesce("completed_at", s["completed_at"])
    minutes = (
        F.unix_micros(F.coalesce(end, as_of)) - F.unix_micros(start)
    ) / F.lit(60_000_000.0)
    out = (
        jobs.withColumn("discovered_urls", nonzero(F.col("total_urls_discovered"), s["discovered_urls"], s["total_pages"]))
        .withColumn("crawled_urls", nonzero(F.col("total_urls_crawled"), s["crawled_pages"]))
        .withColumn("skipped_urls", nonzero(F.col("total_urls_skipped")))
        .withColumn("failed_urls", nonzero(F.col("total_urls_failed"), s["errors"]))
        .withColumn("total_chunks", nonzero(F.col("total_chunks_created"), s["total_chunks"]))
    )
    computed = F.floor(F.col("crawled_urls") / F.greatest(minutes, F.lit(0.1)) + F.lit(0.5))
    rate = F.when(nonzero(s["pages_per_minute"]) != 0, s["pages_per_minute"]).otherwise(
        F.coalesce(computed, F.lit(0)).cast("double")
    )
    left = F.col("discovered_urls") - F.col("crawled_urls")
    eta = F.coalesce(
        s["eta_seconds"],
        F.when(
            end.isNull() & (F.col("pages_per_minute") > 0) & (left > 0),
            F.ceil(left / F.col("pages_per_minute") * 60).cast("double"),
        ),
    )
    stage = F.coalesce(
        F.nullif(s["current_stage"], F.lit("")),
        F.create_map(*[F.lit(x) for pair in STAGES.items() for x in pair])[F.col("status")],
        F.lit("discovering"),
    )
    return (
        out.withColumn("pages_per_minute", rate)
        .withColumn("eta_seconds", eta)
        .withColumn("eta_minutes", F.ceil(F.col("eta_seconds") / 60))
        .withColumn(
            "embed_queue_depth",
            F.coalesce(s["embed_queue_depth"], F.greatest(F.col("total_chunks") - F.col("crawled_urls"), F.lit(0))),
        )
        .withColumn("failure_reason", F.coalesce(F.nullif("error_message", F.lit("")), s["error_message"]))
        .withColumn("current_stage", stage)
    )


def progress_percent(crawled: Column, discovered: Column) -> Column:
    return F.when(discovered > 0, F.try_divide(crawled, discovered) * 100).otherwise(F.lit(0.0))


def remaining_ms(elapsed_ms: Column, progress: Column) -> Column:
    """Estimated time left; nothing is said up to 5 %."""
    return F.when(progress > 5, F.try_divide(elapsed_ms, progress) * (F.lit(100) - progress)).otherwise(F.lit(0.0))


def preview_minutes(urls: Column, spa: Column) -> Column:
    """Planned crawl time: 120 pages a minute, 30 for script-built sites."""
    return F.greatest(F.lit(1), F.ceil(urls / F.when(spa, 30).otherwise(120)))


def missing_keywords(answer: Column, keywords: Column) -> Column:
    return F.filter(keywords, lambda k: ~F.lower(answer).contains(F.lower(k)))


def score_evals(cases: DataFrame, answers: DataFrame, nightly: bool = True) -> DataFrame:
    """Cases with their answers, the failed checks, and ``passed``.

    ``cases`` has ``case_id, question`` and the expectations; ``answers`` has
    ``case_id, answer, confidence, sources_only``. The on-demand form keeps less
    of the answer, words failures shorter and does not check the sources.
    """
    joined = cases.join(answers, "case_id", "left")
    answer = F.coalesce("answer", F.lit(""))
    confidence = F.coalesce("confidence", F.lit(0.0))
    least = F.col("expected_min_confidence")
    none = F.array().cast("array<string>")
    quote = F.lit("Answer missing expected keyword: \"" if nightly else "Missing keyword: \"")
    words = F.transform(
        missing_keywords(answer, F.coalesce("expected_answer_contains", none)),
        lambda k: F.concat(quote, k, F.lit('"')),
    )
    if nightly:
        low = F.when(
            confidence < least,
            F.array(F.concat(F.lit("Confidence "), confidence.cast("string"), F.lit(" below minimum "), least.cast("string"))),
        )
        open_ = F.when(
            F.coalesce("expected_sources_only", F.lit(False)) & ~F.coalesce("sources_only", F.lit(True)),
            F.array(F.lit("Answer used general knowledge instead of sources only")),
        )
        failures = F.concat(words, F.coalesce(low, none), F.coalesce(open_, none))
    else:
        low = F.when((least != 0) & (confidence < least), F.array(F.concat(F.lit("Low confidence: "), confidence.cast("string"))))
        failures = F.concat(words, F.coalesce(low, none))
    return joined.select(
        "case_id",
        "question",
        F.left(answer, F.lit(500 if nightly else 300)).alias("answer"),
        confidence.alias("confidence"),
        failures.alias("failures"),
    ).withColumn("passed", F.size("failures") == 0)


def explode_eval_dataset(settings: DataFrame) -> DataFrame:
    """One row per case of each site's JSON data set; a case needs a question."""
    cases = F.from_json("eval_dataset", EVAL_CASES)
    return (
        settings.select("agent_id", F.posexplode_outer(cases).alias("case_no", "c"))
        .filter(F.col("c.question").isNotNull())
        .select("agent_id", "case_no", "c.*")
    )


def escalate(primary: DataFrame, escalated: DataFrame, threshold: float) -> DataFrame:
    """The stronger model's answer where the first is unsure and it is surer."""
    p, e = primary.alias("p"), escalated.alias("e")
    better = (
        (F.col("p.confidence") < threshold)
        & (F.col("e.model") != F.col("p.model"))
        & (F.col("e.confidence") > F.col("p.confidence"))
    )
    use = F.coalesce(better, F.lit(False))
    return p.join(e, "question_id", "left").select(
        "question_id",
        *[F.when(use, F.col(f"e.{c}")).otherwise(F.col(f"p.{c}")).alias(c) for c in ("answer", "confidence", "model")],
    )
