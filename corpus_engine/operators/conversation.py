"""Windows over the messages of each conversation.

Only the few messages at one end of a conversation are ranked; Spark cuts them
in the map tasks, so a very long conversation is no burden.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpus_engine.runtime import top_per_group

RECENT = 4
HISTORY = 20


def recent_messages(
    df: DataFrame, n: int = RECENT, conversation: str = "conv_id", order: str = "turn"
) -> DataFrame:
    """Messages with ``recent``: the last ``n`` of each conversation.

    The others are left to be summarised.
    """
    last = top_per_group(df.select(conversation, order), [conversation], [F.col(order).desc()], n)
    since = last.groupBy(conversation).agg(F.min(order).alias("_since"))
    return (
        df.join(since, conversation, "left").withColumn("recent", F.col(order) >= F.col("_since")).drop("_since")
    )


def search_context(
    df: DataFrame,
    n: int = RECENT,
    conversation: str = "conv_id",
    order: str = "turn",
    text: str = "text",
    summaries: DataFrame | None = None,
) -> DataFrame:
    """Summary, if any, and the last ``n`` texts of each conversation."""
    last = top_per_group(df.select(conversation, order, text), [conversation], [F.col(order).desc()], n)
    texts = last.groupBy(conversation).agg(
        F.transform(F.sort_array(F.collect_list(F.struct(order, text))), lambda s: s[text]).alias("_texts")
    )
    parts: Column = F.col("_texts")
    if summaries is not None:
        texts = texts.join(summaries.select(conversation, "summary"), conversation, "left")
        parts = F.concat(F.array(F.coalesce("summary", F.lit(""))), parts)
    return texts.select(conversation, F.array_join(F.filter(parts, lambda t: t != ""), " ").alias("context"))


def history_window(
    df: DataFrame, n: int = HISTORY, conversation: str = "conv_id", order: str = "turn"
) -> DataFrame:
    """The first ``n`` messages by time (a long chat loses its newest turns)."""
    return top_per_group(df, [conversation], [F.col(order)], n, "position")
