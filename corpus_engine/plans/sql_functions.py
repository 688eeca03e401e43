"""Table functions for SQL users: site analytics, nearest chunks, failure runs.

They are session functions over views named here, so ``spark.sql`` can call them alone
or laterally for many sites at once; Spark turns a lateral call into joins and
aggregates over all sites.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import udtf

from corpus_engine.operators.analytics import LOW_CONFIDENCE

SITE_ANALYTICS = f"""
CREATE OR REPLACE TEMPORARY FUNCTION site_figures(site STRING, days INT, as_of TIMESTAMP)
RETURNS TABLE (total_conversations BIGINT, unique_sessions BIGINT, total_messages BIGINT,
               avg_confidence DOUBLE, low_confidence_count BIGINT)
RETURN
  SELECT c.total_conversations, c.unique_sessions, m.total_messages, m.avg_confidence, m.low_confidence_count
  FROM (SELECT count(DISTINCT conversation_id) AS total_conversations, count(DISTINCT session_id) AS unique_sessions
        FROM site_conversations
        WHERE agent_id = site_figures.site AND created_at >= site_figures.as_of - make_dt_interval(site_figures.days)) c
  CROSS JOIN
       (SELECT count(*) AS total_messages, avg(confidence) AS avg_confidence,
               count_if(confidence < {LOW_CONFIDENCE}) AS low_confidence_count
        FROM site_messages
        WHERE agent_id = site_figures.site AND role = 'assistant'
          AND created_at >= site_figures.as_of - make_dt_interval(site_figures.days)) m
"""

MESSAGE_DAYS = """
CREATE OR REPLACE TEMPORARY FUNCTION site_message_days(site STRING, days INT, as_of TIMESTAMP)
RETURNS TABLE (day DATE, messages BIGINT)
RETURN
  SELECT CAST(created_at AS DATE), count(*)
  FROM site_messages
  WHERE agent_id = site_message_days.site AND created_at >= site_message_days.as_of - make_dt_interval(site_message_days.days)
  GROUP BY CAST(created_at AS DATE)
"""

_DOT = "aggregate(zip_with({a}, {b}, (x, y) -> CAST(x AS DOUBLE) * CAST(y AS DOUBLE)), 0D, (s, x) -> s + x)"
_SIMILARITY = "{ab} / nullif(sqrt({aa}) * sqrt({bb}), 0D)".format(
    ab=_DOT.format(a="match_chunks.query", b="embedding"),
    aa=_DOT.format(a="match_chunks.query", b="match_chunks.query"),
    bb=_DOT.format(a="embedding", b="embedding"),
)

MATCH_CHUNKS = f"""
CREATE OR REPLACE TEMPORARY FUNCTION match_chunks(query ARRAY<DOUBLE>, site STRING, threshold DOUBLE)
RETURNS TABLE (chunk_id BIGINT, similarity DOUBLE)
RETURN
  SELECT chunk_id, similarity
  FROM (SELECT chunk_id, {_SIMILARITY} AS similarity FROM site_chunks WHERE agent_id = match_chunks.site)
  WHERE similarity > match_chunks.threshold
"""


@udtf(returnType="event_id bigint, streak int, open boolean")
class FailureRuns:
    """The failures of one key in order, with their number in the run; it holds two numbers.

    To be called with ``TABLE(...) PARTITION BY key ORDER BY (ts, event_id)``; the rows need
    ``event_id`` and ``ok``. A null outcome counts as a failure.
    """

    def __init__(self):
        self.streak = 0

    def eval(self, row, opens_at: int) -> Iterator[tuple[int, int, bool]]:
        self.streak = 0 if row["ok"] else self.streak + 1
        if self.streak:
            yield row["event_id"], self.streak, self.streak >= opens_at


def register(
    spark: SparkSession,
    conversations: DataFrame | None = None,
    messages: DataFrame | None = None,
    chunks: DataFrame | None = None,
) -> None:
    """Define the functions whose tables are given; later calls replace earlier ones.

    ``messages`` carries the site of its conversation.
    """
    spark.udtf.register("failure_runs", FailureRuns)
    if conversations is not None and messages is not None:
        conversations.createOrReplaceTempView("site_conversations")
        messages.createOrReplaceTempView("site_messages")
        spark.sql(SITE_ANALYTICS)
        spark.sql(MESSAGE_DAYS)
    if chunks is not None:
        chunks.createOrReplaceTempView("site_chunks")
        spark.sql(MATCH_CHUNKS)
