"""Retrieval: many questions against all knowledge bases."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpus_engine.operators.keyword import KeywordIndex
from corpus_engine.operators.ranking import attach_pages, citations, rerank
from corpus_engine.operators.search import PRESETS, hybrid_search
from corpus_engine.runtime import durable


def search_knowledge(
    queries: DataFrame,
    chunks: DataFrame,
    index: KeywordIndex,
    pages: DataFrame,
    preset: str = "data",
    threshold: float = 0.5,
    stop_words: bool = True,
) -> DataFrame:
    """Hybrid hits of a preset size with their chunk text and page."""
    hits = hybrid_search(queries, chunks, index, PRESETS[preset], threshold, stop_words=stop_words)
    details = chunks.drop("agent_id", "embedding", "rank_weight")
    return attach_pages(hits.join(details, "chunk_id"), pages)


def answer_context(
    queries: DataFrame,
    chunks: DataFrame,
    index: KeywordIndex,
    pages: DataFrame,
    rank: Callable[[DataFrame], DataFrame],
    threshold: float = 0.5,
    stop_words: bool = True,
) -> DataFrame:
    """Citations for chat: over-fetch, re-rank to six, cite five.

    ``rank`` maps the numbered hits ``(query_id, orig, chunk_id, ...)`` to index lists
    ``(query_id, indices)``; it sees each hit once, so the search is written first.
    """
    hits = durable(hybrid_search(queries, chunks, index, PRESETS["chat"], threshold, stop_words=stop_words))
    details = chunks.drop("agent_id", "embedding", "rank_weight")
    numbered = hits.withColumn("orig", F.col("rank") - 1).drop("rank").join(details, "chunk_id")
    return citations(rerank(numbered, rank(numbered), 6), pages, 5)
