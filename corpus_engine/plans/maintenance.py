"""The incremental job: fetched HTML to an updated chunk table, as one flow."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpus_engine.operators.embedding import Embedder
from corpus_engine.operators.extraction import extract_pages
from corpus_engine.runtime import durable
from corpus_engine.streaming.buckets import BUCKETS
from corpus_engine.streaming.ingest import ingest_batch


def refresh_pages(fetched: DataFrame, batch: int, sink: str, embedder: Embedder, dim: int, buckets: int = BUCKETS) -> DataFrame:
    """Extract, classify, chunk, filter, diff, embed and apply one crawl.

    ``fetched`` has ``page_id, url, html, status_code``; a page of status 304 needs no
    HTML and is not parsed. The result names the outcome of each page.
    """
    parsed = extract_pages(fetched.filter("status_code != 304").select("page_id", "url", "html"))
    parsed = parsed.select("page_id", F.col("title"), F.col("page_text").alias("text"), F.lit(200).alias("status_code"))
    same = fetched.filter("status_code = 304").select(
        "page_id", F.lit("").alias("title"), F.lit(None).cast("string").alias("text"), F.lit(304).alias("status_code")
    )
    # the tag walk runs once, whatever reads its rows
    return ingest_batch(durable(parsed.unionByName(same)), batch, sink, embedder, dim, buckets)
