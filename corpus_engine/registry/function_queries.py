"""SQL table functions, called through ``spark.sql`` for all sites at once."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpus_engine.operators.analytics import messages_with_site
from corpus_engine.plans import sql_functions
from corpus_engine.registry import query
from corpus_engine.registry.analytics_queries import _CM, _DAYS, _RECENT, conversations, messages
from corpus_engine.registry.job_queries import outcomes
from corpus_engine.sources.tables import load_table


def _analytics(spark, d):
    c, m = conversations(spark, d), messages(spark, d)
    sql_functions.register(spark, c, messages_with_site(m, c))


@query(
    f"""WITH {_CM}, s AS (SELECT DISTINCT agent_id FROM conv)
        SELECT s.agent_id, coalesce(total_conversations, 0) AS total_conversations, coalesce(unique_sessions, 0) AS unique_sessions,
          coalesce(total_messages, 0) AS total_messages, round(avg_confidence, 6) AS avg_confidence,
          coalesce(low_confidence_count, 0) AS low_confidence_count
        FROM s LEFT JOIN (SELECT agent_id, count(DISTINCT conversation_id) AS total_conversations,
                count(DISTINCT session_id) AS unique_sessions FROM conv WHERE {_RECENT} GROUP BY agent_id) c USING (agent_id)
          LEFT JOIN (SELECT agent_id, count(*) AS total_messages, avg(confidence) AS avg_confidence,
                count(*) FILTER (WHERE confidence < 0.4) AS low_confidence_count
              FROM ms WHERE role = 'assistant' AND {_RECENT} GROUP BY agent_id) m USING (agent_id)"""
)
def site_figures_function(spark, d):
    """The analytics function, called laterally for every site."""
    _analytics(spark, d)
    return spark.sql(
        f"""SELECT s.agent_id, f.total_conversations, f.unique_sessions, f.total_messages,
              round(f.avg_confidence, 6) AS avg_confidence, f.low_confidence_count
            FROM (SELECT DISTINCT agent_id FROM site_conversations) s,
              LATERAL site_figures(s.agent_id, {_DAYS}, TIMESTAMP '2000-01-01') f"""
    )


@query(
    f"""WITH {_CM} SELECT agent_id, CAST(CAST(created_at AS DATE) AS VARCHAR) AS day, count(*) AS messages
        FROM ms WHERE {_RECENT} GROUP BY ALL"""
)
def message_days_function(spark, d):
    _analytics(spark, d)
    return spark.sql(
        f"""SELECT s.agent_id, CAST(f.day AS STRING) AS day, f.messages
            FROM (SELECT DISTINCT agent_id FROM site_conversations) s,
              LATERAL site_message_days(s.agent_id, {_DAYS}, TIMESTAMP '2000-01-01') f"""
    )


@query(
    """WITH c AS (SELECT vec_id AS chunk_id, CAST(label AS VARCHAR) AS agent_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
         q AS (SELECT min(chunk_id) AS chunk_id FROM c GROUP BY agent_id)
       SELECT a.chunk_id AS query_id, b.chunk_id, round(list_cosine_similarity(a.v, b.v), 6) AS similarity
       FROM c a SEMI JOIN q USING (chunk_id) JOIN c b ON a.agent_id = b.agent_id
       WHERE list_cosine_similarity(a.v, b.v) > 0.1"""
)
def match_chunks_function(spark, d):
    """Chunks like the first one of each site, above a threshold."""
    vectors = load_table(spark, d, "embeddings", ["vec_id", "label", "embedding"])
    chunks = vectors.select(
        F.col("vec_id").alias("chunk_id"), F.col("label").cast("string").alias("agent_id"),
        F.col("embedding").cast("array<double>").alias("embedding"),
    )
    sql_functions.register(spark, chunks=chunks)
    return spark.sql(
        """SELECT q.chunk_id AS query_id, f.chunk_id, round(f.similarity, 6) AS similarity
           FROM (SELECT agent_id, min(chunk_id) AS chunk_id, min_by(embedding, chunk_id) AS embedding
                 FROM site_chunks GROUP BY agent_id) q,
             LATERAL match_chunks(q.embedding, q.agent_id, 0.1D) f"""
    )


@query(
    """WITH g AS (SELECT event_id, ts, user_id, event_type, sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END)
            OVER (PARTITION BY user_id ORDER BY ts, event_id) AS grp FROM events)
       SELECT event_id, CAST(count(*) OVER (PARTITION BY user_id, grp ORDER BY ts, event_id) AS INT) AS streak,
         count(*) OVER (PARTITION BY user_id, grp ORDER BY ts, event_id) >= 10 AS open
       FROM g WHERE event_type <> 'view'"""
)
def failure_runs_function(spark, d):
    """Failure runs by a Python table function; one SELECT has no such state."""
    sql_functions.register(spark)
    outcomes(spark, d).createOrReplaceTempView("outcomes")
    return spark.sql(
        "SELECT event_id, streak, open FROM failure_runs(TABLE(SELECT * FROM outcomes) PARTITION BY key ORDER BY (ts, event_id), 10)"
    )
