"""Conversation windows over all chats."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpus_engine.operators import conversation as C
from corpus_engine.registry import query
from corpus_engine.sources.tables import load_table


def _turns(spark, d):
    return load_table(spark, d, "conversations", ["conv_id", "turn", "role", "text"])


@query(
    """SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 4 AS recent
       FROM conversations"""
)
def recent_messages(spark, d):
    return C.recent_messages(_turns(spark, d)).select("conv_id", "turn", "recent")


@query(
    """SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS context FROM (
         SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations)
       WHERE rn <= 4 AND text <> '' GROUP BY conv_id"""
)
def search_context(spark, d):
    return C.search_context(_turns(spark, d))


@query(
    """SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INT) AS position
       FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) <= 20"""
)
def history_window(spark, d):
    return C.history_window(_turns(spark, d)).select("conv_id", "turn", "position")
