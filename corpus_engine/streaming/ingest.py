"""Incremental ingest: fetched pages to stored, embedded chunks, batch by batch.

One batch runs classify, chunk, filter, diff, embed and apply over its pages; each
costly step is written once. The sink keeps three tables in buckets of page ids
(:mod:`corpus_engine.streaming.buckets`): ``pages`` with the hash of each page,
``manifest`` with its chunks, and ``bodies`` with the texts and vectors of chunks,
which are written once and named by the manifest. A batch reads the present pages and
manifests of its own buckets and no bodies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpus_engine.functions.text import content_hash
from corpus_engine.operators.chunking import chunk_pages, filter_boilerplate_chunks
from corpus_engine.operators.embedding import Embedder, embed_pages
from corpus_engine.operators.incremental import apply_chunk_diff, diff_chunks
from corpus_engine.runtime import durable
from corpus_engine.streaming.buckets import BUCKETS, Sink

_PAGE = "page_id bigint, page_hash string, crawl_status string"
_MANIFEST = "page_id bigint, content_hash string, chunk_index int, chunk_id string, body_batch bigint, rank_weight double"
_BODY = (
    "page_id bigint, chunk_id string, heading_path string, content string, snippet string, "
    "token_count bigint, embedding array<double>"
)
STATES = ["pages", "manifest"]


def current_manifest(spark: SparkSession, sink: str) -> DataFrame:
    """Chunks of every page as of the last batch."""
    return Sink(spark, sink).read("manifest", _MANIFEST)


def current_pages(spark: SparkSession, sink: str) -> DataFrame:
    return Sink(spark, sink).read("pages", _PAGE)


def current_chunks(spark: SparkSession, sink: str) -> DataFrame:
    """The chunk table: a join of the manifest with the bodies it names."""
    held = Sink(spark, sink)
    bodies = held.all_batches("bodies", _BODY).drop("bucket").withColumnRenamed("batch", "body_batch")
    return held.read("manifest", _MANIFEST).join(bodies, ["page_id", "chunk_id", "body_batch"]).drop("body_batch")


def classify(pages: DataFrame, known: DataFrame) -> DataFrame:
    """Fetched pages with ``page_hash`` and ``outcome``: new, changed, or why they are skipped."""
    hashed = pages.withColumn("page_hash", content_hash(F.col("text")))
    old = known.select("page_id", F.col("page_hash").alias("old_hash"), F.lit(True).alias("held"))
    status = F.col("status_code") if "status_code" in pages.columns else F.lit(200)
    outcome = (
        F.when(status == 304, "not_modified")
        .when(F.col("old_hash") == F.col("page_hash"), "content_unchanged")
        .when(F.col("held").isNull(), "new")
        .otherwise("changed")
    )
    return hashed.join(old, "page_id", "left").withColumn("outcome", outcome).drop("old_hash", "held")


def ingest_batch(
    pages: DataFrame, batch: int, sink: str, embedder: Embedder | None = None, dim: int = 0, buckets: int = BUCKETS
) -> DataFrame:
    """Apply one batch of pages ``(page_id, title, text[, status_code])``; gives page ids and outcomes.

    A page that comes with status 304, or whose text has the stored hash, is left alone. Of
    the others, chunks whose text is still there keep their row, number and vector;
    only added chunks are embedded, and one whose embedding fails is not stored.
    Repeating a batch overwrites it. Page ids are unique within a batch. ``buckets``
    counts for a new sink; it should keep the rows of a bucket within a task's memory.
    """
    spark = pages.sparkSession
    held = Sink(spark, sink, before=batch, buckets=buckets)
    touched = held.touched(pages, "page_id")
    known = held.read("pages", _PAGE, touched)
    seen = durable(classify(pages, known))
    work = seen.filter(F.col("outcome").isin("new", "changed"))

    chunks = filter_boilerplate_chunks(chunk_pages(work.select("page_id", "title", "text"), title=F.col("title")))
    chunks = durable(chunks.drop("title").withColumn("content_hash", content_hash(F.col("content"))))
    manifest = held.read("manifest", _MANIFEST, touched)
    diff = durable(diff_chunks(chunks, manifest, crawled=work))

    added = diff.filter("change = 'added'").select("page_id", "content_hash", "chunk_index")
    # a page may hold a text twice
    keys = ["page_id", "content_hash", "chunk_index"]
    number = F.concat_ws("-", F.lit(batch), "page_id", "chunk_index")
    bodies = chunks.join(added, keys, "left_semi").withColumn("chunk_id", number)
    if embedder is None:
        bodies = bodies.withColumn("embedding", F.array().cast("array<double>"))
    else:
        bodies = durable(embed_pages(bodies, "content", embedder).drop("error"))
    stored = bodies.select("page_id", "chunk_id", "heading_path", "content", "snippet", "token_count", "embedding")
    size = F.coalesce(F.size("embedding"), F.lit(0)) == dim
    held.write(stored.filter(size), "bodies", batch, "page_id")

    fresh = bodies.select(*keys, "chunk_id", F.lit(batch).cast("long").alias("body_batch"), "embedding")
    applied = apply_chunk_diff(manifest, diff, fresh, dim).drop("embedding")
    held.write(applied, "manifest", batch, "page_id")
    now = work.select("page_id", "page_hash", F.lit("crawled").alias("crawl_status"))
    held.write(known.join(now, "page_id", "left_anti").unionByName(now), "pages", batch, "page_id")
    held.commit(batch, STATES, touched)
    held.expire(STATES)
    return seen.select("page_id", "outcome")


def compact(spark: SparkSession, sink: str, batch: int) -> int:
    """Rewrite the bodies that the manifest names under a new batch and drop all others.

    Gives the number of folders that were deleted. To be run between batches, with the
    next free batch number, when enough texts have been replaced.
    """
    held = Sink(spark, sink, before=batch)
    live = durable(current_chunks(spark, sink))
    columns = [f.split()[0] for f in _BODY.split(", ")]
    held.write(live.select(*columns), "bodies", batch, "page_id")
    named = live.select("page_id", "content_hash", "chunk_index", "chunk_id", F.lit(batch).cast("long").alias("body_batch"), "rank_weight")
    held.write(named, "manifest", batch, "page_id")
    held.commit(batch, ["manifest"], sorted(held.versions.get("manifest", {})))
    return held.expire(STATES, keep=1) + held.drop_before("bodies", batch)


def ingest_stream(pages: DataFrame, sink: str, checkpoint: str, **options) -> None:
    """Run a page stream into the sink up to the data that is there now."""

    def save(df: DataFrame, number: int) -> None:
        ingest_batch(df, number, sink, **options)

    query = (
        pages.writeStream.foreachBatch(save)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
