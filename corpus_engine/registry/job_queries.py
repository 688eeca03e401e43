"""Jobs, policies, evaluations and per-key timelines."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpus_engine.operators import jobs as J
from corpus_engine.operators import timeline as W
from corpus_engine.plans import evaluation
from corpus_engine.registry import query
from corpus_engine.registry.analytics_queries import at, sites
from corpus_engine.sources.tables import load_table



def _policies(spark, d):
    return load_table(spark, d, "orders").select(
        F.col("o_custkey").alias("agent_id"),
        (F.col("o_orderstatus") != "P").alias("enabled"),
        (F.col("o_orderkey") % 100 + 1).cast("int").alias("frequency_hours"),
        F.col("o_orderdate").alias("next_run_at"),
    )


@query(
    """SELECT o_custkey AS agent_id, CAST(c_nationkey AS INT) AS user_id, 'incremental' AS job_type,
         CAST(TIMESTAMP '1999-01-01' + to_hours(CAST(o_orderkey % 100 + 1 AS INT)) AS VARCHAR) AS next_run_at
       FROM orders JOIN customer ON c_custkey = o_custkey
       WHERE o_orderstatus <> 'P' AND o_orderdate <= TIMESTAMP '1999-01-01' AND c_mktsegment <> 'MACHINERY'"""
)
def due_recrawls(spark, d):
    return J.due_recrawls(_policies(spark, d), sites(spark, d), at("1999-01-01")).select(
        "agent_id", "user_id", "job_type", F.date_format("next_run_at", "yyyy-MM-dd HH:mm:ss").alias("next_run_at")
    )


@query(
    """WITH p AS (SELECT c_custkey AS agent_id, c_acctbal > 0 AS enabled, 12 AS hours, TIMESTAMP '1998-01-01' AS nxt FROM customer),
       n AS (SELECT o_custkey AS agent_id, CASE max(o_orderstatus) WHEN 'P' THEN false WHEN 'O' THEN true END AS enabled,
               CAST(count(*) % 3 * 10 AS INT) AS hours FROM orders GROUP BY 1)
       SELECT coalesce(p.agent_id, n.agent_id) AS agent_id,
         CASE WHEN n.agent_id IS NULL THEN p.enabled ELSE coalesce(n.enabled, true) END AS enabled,
         CAST(CASE WHEN n.agent_id IS NULL THEN p.hours WHEN n.hours = 0 THEN 24 ELSE n.hours END AS INT) AS frequency_hours,
         CAST(CASE WHEN n.agent_id IS NULL THEN nxt WHEN n.enabled THEN TIMESTAMP '1999-01-01'
           + to_hours(CASE WHEN n.hours = 0 THEN 24 ELSE n.hours END) END AS VARCHAR) AS next_run_at
       FROM p FULL JOIN n ON p.agent_id = n.agent_id"""
)
def upsert_policy(spark, d):
    policies = load_table(spark, d, "customer", ["c_custkey", "c_acctbal"]).select(
        F.col("c_custkey").alias("agent_id"),
        (F.col("c_acctbal") > 0).alias("enabled"),
        F.lit(12).alias("frequency_hours"),
        F.lit("1998-01-01").cast("timestamp").alias("next_run_at"),
    )
    changes = (
        load_table(spark, d, "orders", ["o_custkey", "o_orderstatus"])
        .groupBy(F.col("o_custkey").alias("agent_id"))
        .agg(
            F.max("o_orderstatus").alias("s"),
            (F.count("*") % 3 * 10).cast("int").alias("frequency_hours"),
        )
        .withColumn("enabled", F.when(F.col("s") == "P", False).when(F.col("s") == "O", True))
        .drop("s")
    )
    return J.upsert_policy(policies, changes, at("1999-01-01")).withColumn(
        "next_run_at", F.date_format("next_run_at", "yyyy-MM-dd HH:mm:ss")
    )


_JOBS = """SELECT o_orderkey AS job_id, CASE o_orderstatus WHEN 'O' THEN 'running' WHEN 'F' THEN 'completed' ELSE 'cancelled' END AS status,
    CAST(o_totalprice AS BIGINT) AS discovered, o_orderkey % 500 AS crawled, o_orderkey % 900 AS chunks,
    o_orderdate AS started, CASE WHEN o_orderstatus <> 'O' THEN o_orderdate + to_hours(CAST(o_orderkey % 30 AS INT)) END AS done FROM orders"""


@query(
    f"""WITH j AS ({_JOBS}), m AS (SELECT *, CASE WHEN crawled = 0 THEN 7 ELSE crawled END AS c,
          floor(CASE WHEN crawled = 0 THEN 7 ELSE crawled END / greatest((epoch_us(coalesce(done, TIMESTAMP '2002-01-01')) - epoch_us(started)) / 60000000.0, 0.1) + 0.5) AS ppm FROM j)
        SELECT job_id, c AS crawled_urls, CAST(ppm AS DOUBLE) AS pages_per_minute,
          CAST(CASE WHEN done IS NULL AND ppm > 0 AND discovered > c THEN ceil((discovered - c) / ppm * 60) END AS DOUBLE) AS eta_seconds,
          greatest(chunks - c, 0) AS embed_queue_depth,
          CASE status WHEN 'running' THEN 'fetching' WHEN 'completed' THEN 'ready' ELSE 'failed' END AS current_stage FROM m"""
)
def job_metrics(spark, d):
    o = F.col("o_orderkey")
    status = F.col("o_orderstatus")
    none = F.lit(None)
    jobs = load_table(spark, d, "orders").select(
        o.alias("job_id"),
        F.when(status == "O", "running").when(status == "F", "completed").otherwise("cancelled").alias("status"),
        F.round("o_totalprice").cast("bigint").alias("total_urls_discovered"),
        (o % 500).alias("total_urls_crawled"),
        F.lit(0).alias("total_urls_skipped"),
        F.lit(0).alias("total_urls_failed"),
        (o % 900).alias("total_chunks_created"),
        F.lit("").alias("error_message"),
        F.col("o_orderdate").alias("started_at"),
        F.when(status != "O", F.col("o_orderdate") + F.make_dt_interval(hours=(o % 30).cast("int"))).alias("completed_at"),
        F.struct(
            none.cast("bigint").alias("discovered_urls"), none.cast("bigint").alias("total_pages"),
            F.lit(7).cast("bigint").alias("crawled_pages"), none.cast("bigint").alias("total_chunks"),
            none.cast("bigint").alias("errors"), none.cast("double").alias("pages_per_minute"),
            none.cast("double").alias("eta_seconds"), none.cast("bigint").alias("embed_queue_depth"),
            none.cast("string").alias("current_stage"), none.cast("string").alias("error_message"),
            none.cast("timestamp").alias("started_at"), none.cast("timestamp").alias("completed_at"),
        ).alias("stats"),
    )
    return J.job_metrics(jobs, F.lit("2002-01-01").cast("timestamp")).select(
        "job_id", "crawled_urls", "pages_per_minute", "eta_seconds", "embed_queue_depth", "current_stage"
    )


@query(
    """SELECT l_orderkey, l_linenumber, round(CASE WHEN l_extendedprice > 0 THEN l_quantity / 60 * 100 ELSE 0 END, 6) AS progress,
         round(CASE WHEN l_quantity / 60 * 100 > 5 THEN l_extendedprice / (l_quantity / 60 * 100) * (100 - l_quantity / 60 * 100) ELSE 0 END + 0.0001234, 3) AS remaining
       FROM lineitem"""
)
def progress_estimate(spark, d):
    progress = J.progress_percent(F.col("l_quantity"), F.lit(60.0))
    return load_table(spark, d, "lineitem", ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"]).select(
        "l_orderkey", "l_linenumber",
        F.round(progress, 6).alias("progress"),
        F.round(J.remaining_ms(F.col("l_extendedprice"), progress) + 0.0001234, 3).alias("remaining"),
    )


@query(
    """SELECT p_partkey, greatest(1, CAST(ceil(p_partkey / CASE WHEN p_size > 25 THEN 30.0 ELSE 120.0 END) AS BIGINT)) AS minutes FROM part"""
)
def preview_estimate(spark, d):
    return load_table(spark, d, "part", ["p_partkey", "p_size"]).select(
        "p_partkey", J.preview_minutes(F.col("p_partkey"), F.col("p_size") > 25).alias("minutes")
    )


def _eval_cases(spark, d):
    """Turns as answers to the turn before."""
    turns = load_table(spark, d, "conversations")
    key = F.concat_ws("-", "conv_id", "turn").alias("case_id")
    before = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("question"))
    cases = turns.select("conv_id", "turn").join(before, ["conv_id", "turn"], "left").select(
        key, "question",
        F.filter(F.split(F.coalesce("question", F.lit("")), " "), lambda w: F.length(w) > 12).alias("expected_answer_contains"),
        F.lit(0.2).alias("expected_min_confidence"),
        F.lit(True).alias("expected_sources_only"),
    )
    answers = turns.select(
        key, F.col("text").alias("answer"), ((F.col("turn") % 10) / 10).alias("confidence"), F.lit(True).alias("sources_only")
    )
    return cases, answers


@query(
    """WITH a AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS q FROM conversations),
       k AS (SELECT conv_id, turn, text, (turn % 10) / 10.0 AS conf, list_filter(string_split(coalesce(q, ''), ' '), lambda w: length(w) > 12) AS ks FROM a)
       SELECT conv_id || '-' || turn AS case_id,
         len(list_filter(ks, lambda w: NOT contains(lower(text), lower(w)))) + CASE WHEN conf < 0.2 THEN 1 ELSE 0 END AS failures,
         len(list_filter(ks, lambda w: NOT contains(lower(text), lower(w)))) = 0 AND conf >= 0.2 AS passed,
         md5(left(text, 500)) AS digest FROM k"""
)
def score_evals(spark, d):
    cases, answers = _eval_cases(spark, d)
    return J.score_evals(cases, answers).select(
        "case_id", F.size("failures").alias("failures"), "passed", F.md5("answer").alias("digest")
    )


@query(
    """SELECT user_id AS agent_id, CAST(0 AS INT) AS case_no, event_type AS question, round(value / 20, 6) AS least FROM events
       UNION ALL SELECT user_id, 2, props, NULL FROM events WHERE event_type <> 'view'"""
)
def explode_eval_dataset(spark, d):
    first = F.struct(F.col("event_type").alias("question"), (F.col("value") / 20).alias("expected_min_confidence"))
    empty = F.struct(F.lit(None).cast("string").alias("question"), F.lit(None).cast("double").alias("expected_min_confidence"))
    last = F.struct(
        F.when(F.col("event_type") != "view", F.col("props")).alias("question"),
        F.lit(None).cast("double").alias("expected_min_confidence"),
    )
    settings = load_table(spark, d, "events", ["user_id", "event_type", "value", "props"]).select(
        F.col("user_id").alias("agent_id"), F.to_json(F.array(first, empty, last)).alias("eval_dataset")
    )
    return J.explode_eval_dataset(settings).select(
        "agent_id", "case_no", "question", F.round("expected_min_confidence", 6).alias("least")
    )


@query(
    """SELECT e.event_id AS question_id, round(CASE WHEN use THEN x.value ELSE e.value END / 20, 6) AS confidence,
         CASE WHEN use THEN 'pro' ELSE 'lite' END AS model FROM (
         SELECT e.*, x.value AS xv, coalesce(e.value / 20 < 0.5 AND x.value > e.value, false) AS use
         FROM events e LEFT JOIN events x ON x.event_id = e.event_id + 1 AND x.event_type <> 'view') e
       LEFT JOIN events x ON x.event_id = e.event_id + 1"""
)
def escalate(spark, d):
    events = load_table(spark, d, "events", ["event_id", "event_type", "value"])
    primary = events.select(
        F.col("event_id").alias("question_id"), F.lit("a").alias("answer"), (F.col("value") / 20).alias("confidence"), F.lit("lite").alias("model")
    )
    second = events.filter(F.col("event_type") != "view").select(
        (F.col("event_id") - 1).alias("question_id"), F.lit("b").alias("answer"), (F.col("value") / 20).alias("confidence"), F.lit("pro").alias("model")
    )
    return J.escalate(primary, second, 0.5).select("question_id", F.round("confidence", 6).alias("confidence"), "model")


def outcomes(spark, d):
    return load_table(spark, d, "events", ["event_id", "ts", "user_id", "event_type"]).select(
        "event_id", "ts", F.col("user_id").alias("key"), (F.col("event_type") == "view").alias("ok")
    )


@query(
    """WITH g AS (SELECT event_id, ts, user_id, event_type, sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END)
            OVER (PARTITION BY user_id ORDER BY ts, event_id) AS grp FROM events)
       SELECT event_id, count(*) OVER (PARTITION BY user_id, grp ORDER BY ts, event_id) AS streak,
         count(*) OVER (PARTITION BY user_id, grp ORDER BY ts, event_id) >= 10 AS open
       FROM g WHERE event_type <> 'view'"""
)
def failure_streaks(spark, d):
    return W.failure_streaks(outcomes(spark, d)).select("event_id", "streak", "open")


@query(
    """SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts)
         RANGE BETWEEN 21599999999 PRECEDING AND CURRENT ROW) AS in_window FROM events"""
)
def sliding_counts(spark, d):
    return W.sliding_counts(outcomes(spark, d), 6 * 3_600_000_000).select("event_id", "in_window")


@query(
    """WITH t AS (SELECT conv_id, text AS q, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS a,
                   row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS n FROM conversations),
       k AS (SELECT conv_id, n, coalesce(a, '') AS a, CASE WHEN a IS NULL THEN 0 ELSE (n % 10) / 10.0 END AS conf,
               list_filter(string_split(q, ' '), lambda w: length(w) > 14) AS ks FROM t WHERE conv_id % 4 <> 0 AND q IS NOT NULL),
       r AS (SELECT conv_id, len(list_filter(ks, lambda w: NOT contains(lower(a), lower(w)))) = 0 AND conf >= 0.1 AS passed FROM k)
       SELECT conv_id AS agent_id, count(*) AS total, count(*) FILTER (WHERE passed) AS passed,
         count(*) FILTER (WHERE NOT passed) AS failed, count(*) FILTER (WHERE NOT passed) / count(*) > 0.3 AS warning,
         CASE WHEN count(*) FILTER (WHERE NOT passed) / count(*) > 0.3 THEN count(*) FILTER (WHERE NOT passed) ELSE 0 END AS named
       FROM r GROUP BY conv_id"""
)
def nightly_evaluation(spark, d):
    """Each conversation as a site's data set: a turn is a case, the next turn its answer."""
    turns = load_table(spark, d, "conversations")
    order = Window.partitionBy("conv_id").orderBy("turn")
    turns = turns.withColumns({"n": F.row_number().over(order) - 1, "reply": F.lead("text").over(order)})
    case = F.struct(
        "n",
        F.col("text").alias("question"),
        F.filter(F.split("text", " "), lambda w: F.length(w) > 14).alias("expected_answer_contains"),
        F.lit(0.1).alias("expected_min_confidence"),
    )
    sets = turns.groupBy(F.col("conv_id").alias("agent_id")).agg(F.to_json(F.sort_array(F.collect_list(case))).alias("eval_dataset"))
    status = F.when(F.col("agent_id") % 4 == 0, "crawling").otherwise("ready")
    sites = sets.select("agent_id", status.alias("status"))
    replies = turns.filter("reply is not null").select(F.col("conv_id").alias("agent_id"), F.col("n").alias("case_no"), "reply")

    def answer(cases):
        return cases.join(replies, ["agent_id", "case_no"]).select(
            "case_id", F.col("reply").alias("answer"), ((F.col("case_no") % 10) / 10).alias("confidence"), F.lit(True).alias("sources_only")
        )

    run = evaluation.run_evaluations(sites, sets, answer)
    named = run.warnings.groupBy("agent_id").agg(F.count("*").alias("named"))
    return run.log.join(named, "agent_id", "left").select(
        "agent_id", "total", "passed", "failed", "warning", F.coalesce("named", F.lit(0)).alias("named")
    )


@query(
    """WITH a AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS q FROM conversations),
       k AS (SELECT conv_id, turn, text, (turn % 10) / 10.0 AS conf, list_filter(string_split(coalesce(q, ''), ' '), lambda w: length(w) > 12) AS ks FROM a),
       m AS (SELECT *, list_filter(ks, lambda w: NOT contains(lower(text), lower(w))) AS missing FROM k)
       SELECT conv_id || '-' || turn AS case_id, md5(left(text, 300)) AS digest, len(missing) = 0 AND conf >= 0.2 AS passed,
         CASE WHEN len(missing) > 0 THEN 'Missing keyword: "' || missing[1] || '"' WHEN conf < 0.2 THEN 'Low confidence' END AS first_failure FROM m"""
)
def score_evals_on_demand(spark, d):
    """The on-demand form: shorter answers and messages, no check of the sources."""
    cases, answers = _eval_cases(spark, d)
    scored = J.score_evals(cases, answers.withColumn("sources_only", F.lit(False)), nightly=False)
    first = F.get("failures", 0)
    short = F.when(first.startswith("Low confidence"), "Low confidence").otherwise(first)
    return scored.select("case_id", F.md5("answer").alias("digest"), "passed", short.alias("first_failure"))
