"""Append-only events, exported documents and single files."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from urllib.parse import quote
from zlib import crc32

import pandas as pd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpus_engine import schema
from corpus_engine.functions.text import or_else
from corpus_engine.runtime import top_per_group


def append_events(events: DataFrame, path: str) -> None:
    """Append valid usage events, by date; an empty payload becomes ``{}``."""
    valid, _ = schema.split_valid(events, {"event_type": "usage_event"})
    (
        valid.withColumn("payload", F.coalesce("payload", F.lit("{}")))
        .withColumn("date", F.to_date("created_at"))
        .write.mode("append")
        .partitionBy("date")
        .parquet(path)
    )


def stream_events(events: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> list[StreamingQuery]:
    """Append a stream of usage events to ``path/events`` by date, and rejects to ``path/rejects``.

    Both are file sinks with a log of finished batches: readers see each batch once,
    also after a restart from the checkpoint. Rejects keep the names of the columns
    that were not allowed.
    """
    valid, rejects = schema.split_valid(events, {"event_type": "usage_event"})
    valid = valid.withColumn("payload", F.coalesce("payload", F.lit("{}"))).withColumn("date", F.to_date("created_at"))
    started = []
    for name, rows, parts in (("events", valid, ["date"]), ("rejects", rejects, [])):
        writer = rows.writeStream.format("parquet").option("checkpointLocation", f"{checkpoint}/{name}")
        writer = writer.option("path", f"{path}/{name}").partitionBy(*parts).outputMode("append")
        started.append((writer.trigger(availableNow=True) if available_now else writer).start())
    if available_now:
        for query in started:
            query.awaitTermination()
    return started


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{schema.USAGE_EVENTS}, date date").parquet(path)


def export_documents(pages: DataFrame, limit: int | None, order: list[Column] | None = None) -> DataFrame:
    """``(agent_id, name, content)``: the pages of each site, or its first ``limit``, as Markdown files."""
    full = pages.filter((F.col("crawl_status") == "crawled") & F.col("clean_markdown").isNotNull())
    top = full if limit is None else top_per_group(full, ["agent_id"], order or [F.col("url")], limit)
    encoded = F.replace(F.url_encode("url"), F.lit("+"), F.lit("%20"))
    return top.select(
        "agent_id",
        F.concat(F.lit("agent-"), "agent_id", F.lit("-"), F.left(encoded, F.lit(100)), F.lit(".md")).alias("name"),
        F.concat(
            F.lit("# "), or_else(F.col("title"), F.col("url")), F.lit("\nSource: "), F.col("url"), F.lit("\n\n"), F.col("clean_markdown")
        ).alias("content"),
    )


def write_documents(documents: DataFrame, path: str) -> None:
    """One text record per document, by site."""
    documents.select("agent_id", F.col("content").alias("value")).write.mode("overwrite").partitionBy(
        "agent_id"
    ).option("lineSep", "\x00").text(path)


def write_files(rows: DataFrame, key: str, content: str, folders: list[str]) -> int:
    """One file for each row, and the number of rows written; a hash of its name picks a file's folder.

    Files are named ``KEY=value.TASK-COPY``, so a task that runs again writes the same
    files again. Spark's own writers make a folder or a commit for each file, which
    takes longer than the file.
    """
    system, _ = fs.FileSystem.from_uri(folders[0])
    for folder in folders:
        system.create_dir(fs.FileSystem.from_uri(folder)[1], recursive=True)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        places = [fs.FileSystem.from_uri(folder) for folder in folders]
        task, copies = TaskContext.get().partitionId(), Counter()
        for batch in batches:
            for value, data in zip(batch["key"], batch["content"]):
                value = "" if value is None else quote(value, safe="")
                name = f"{key}={value}.{task}-{copies[value]}"
                copies[value] += 1
                system, root = places[crc32(name.encode()) % len(places)]
                with system.open_output_stream(f"{root}/{name}") as out:
                    out.write(data)
            yield pd.DataFrame({"n": [len(batch)]})

    named = rows.select(F.col(key).cast("string").alias("key"), F.col(content).alias("content"))
    return named.mapInPandas(run, "n long").agg(F.sum("n")).first()[0] or 0
