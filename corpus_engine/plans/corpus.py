"""Corpus building: documents to clean, counted chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpus_engine.operators.chunking import chunk_pages, filter_boilerplate_chunks
from corpus_engine.functions.text import normalized_hash
from corpus_engine.operators.dedup import MIN_PAGES, exact_boilerplate, remove_boilerplate
from corpus_engine.runtime import durable
from corpus_engine.sources.tables import load_table


def clean_chunks(documents: DataFrame) -> DataFrame:
    """Chunks of all documents without pattern and repeated boilerplate.

    The chunks are written once: they are needed to find the repeated texts and
    again to drop them, and chunking costs more than reading them back.
    """
    chunks = durable(filter_boilerplate_chunks(chunk_pages(documents)))
    return remove_boilerplate(chunks, exact_boilerplate(chunks, "content", "source"))


def corpus_summary(spark: SparkSession, directory: str) -> DataFrame:
    """Chunk and token totals per language.

    Only the hash of each chunk is kept for the totals, not its text.
    """
    documents = load_table(spark, directory, "documents", ["doc_id", "text", "lang", "source"], spread=True)
    keyed = durable(
        filter_boilerplate_chunks(chunk_pages(documents)).select(
            "doc_id", "lang", "source", "token_count", normalized_hash(F.col("content")).alias("hash")
        )
    )
    repeated = (
        keyed.groupBy("hash").agg(F.countDistinct("source").alias("pages")).filter(F.col("pages") >= MIN_PAGES)
    )
    return (
        keyed.join(repeated, "hash", "left_anti")
        .groupBy("lang")
        .agg(
            F.count("*").alias("chunks"),
            F.countDistinct("doc_id").alias("documents"),
            F.sum("token_count").alias("tokens"),
        )
    )
