"""Streams over files that come one by one."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from corpus_engine.runtime import scratch_path
from corpus_engine.sources.site_tables import SiteTable
from corpus_engine.streaming import progress, runner, state

T0 = datetime(2024, 1, 1)


def at(hours):
    return T0 + timedelta(hours=hours)


def files(spark, batches, schema):
    """A folder to which each batch is added as a file of its own, in order."""
    folder = scratch_path(spark, "files")
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    return folder


def stream(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_windows_close_and_late_rows_go(spark):
    schema = "ts timestamp, event_type string"
    batches = [
        [(at(1), "a"), (at(2), "a"), (at(2), "b")],
        [(at(40), "a")],  # moves the watermark to hour 16, by which rows are judged from the batch after next
        [(at(41), "b")],
        [(at(3), "a"), (at(30), "a")],  # hour 3 is late, its windows are closed; hour 30 is not
        [(at(80), "z")],
    ]
    events = stream(spark, files(spark, batches, schema), schema)
    counts = progress.events_per_window(events, "2 hours", "1 hour", late="1 day")
    rows = {(r.window_start, r.event_type): r.events for r in runner.run_append(counts, "t-closed").collect()}
    want = {}
    for hour, kind in ((1, "a"), (2, "a"), (2, "b"), (40, "a"), (30, "a"), (41, "b")):
        for start in (hour - 1, hour):
            want[at(start), kind] = want.get((at(start), kind), 0) + 1
    assert rows == want  # the windows of hour 80 are still open, the row of hour 3 is lost


def test_once_per_key_in_a_stream(spark):
    schema = "ts timestamp, id long"
    batches = [[(at(0), 1), (at(0), 1), (at(1), 2)], [(at(2), 1), (at(90), 3)], [(at(90), 3)], [(at(91), 1), (at(2), 9)]]
    rows = runner.run_append(state.once_per_key(stream(spark, files(spark, batches, schema), schema), ["id"]), "t-once").collect()
    # key 1 comes again after its state has expired; id 9 is older than the watermark
    assert sorted((r.id, r.ts) for r in rows) == [(1, at(0)), (1, at(91)), (2, at(1)), (3, at(90))]


JOB = "job_id long, event_id long, event string, ts timestamp, pages_crawled long"


def test_jobs_time_out_and_survive_a_restart(spark):
    first = [
        [(1, 1, "crawl.started", at(0), None), (2, 2, "crawl.started", at(0), None), (None, 3, "crawl.started", at(0), None)],
        [(1, 5, "crawl.progress", at(3), 7), (1, 4, "crawl.progress", at(2), 5), (3, 6, "noise", at(3), 1)],
    ]
    second = [
        [(1, 7, "crawl.completed", at(4), 9), (4, 8, "crawl.started", at(5), None)],
        [(5, 9, "crawl.started", at(60), None)],  # the watermark passes job 2 and job 4
    ]
    folder, out, checkpoint = files(spark, first, JOB), scratch_path(spark, "t-jobs"), scratch_path(spark, "t-jobs-checkpoint")

    def run():
        def save(batch, number):
            batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/part={number}")

        jobs = state.track_jobs(stream(spark, folder, JOB), 6 * 3_600_000)
        writer = jobs.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).outputMode("update")
        writer.trigger(availableNow=True).start().awaitTermination()
        rows = spark.read.parquet(out).groupBy("job_id").agg(F.max_by(F.struct("status", "total_urls_crawled"), "_batch").alias("r"))
        return {r.job_id: tuple(r.r) for r in rows.collect()}

    assert run() == {1: ("running", 7), 2: ("running", None)}
    for rows in second:
        spark.createDataFrame(rows, JOB).coalesce(1).write.mode("append").parquet(folder)
    assert run() == {1: ("completed", 9), 2: ("timed_out", None), 4: ("timed_out", None), 5: ("running", None)}


def test_site_table_rewrites_only_its_buckets(spark):
    schema = "agent_id string, url string, clean_markdown string, previous_markdown string, crawl_status string, last_crawled_at long"
    rows = [(f"s{i % 30}", f"u{i}", f"text {i}", None, "pending", 0) for i in range(300)]
    table = SiteTable(spark, scratch_path(spark, "t-sites"), buckets=16)
    table.create(spark.createDataFrame(rows, schema))

    def held():
        f = spark.read.parquet(table.path).select("bucket", "_metadata.file_path", "_metadata.file_modification_time").distinct()
        return {tuple(r) for r in f.collect()}

    before = held()
    change = [("s1", "u1", "new text", None, "crawled", 5), ("s1", "u999", "a new page", None, "crawled", 5)]
    touched = table.upsert(spark.createDataFrame(change, schema))
    assert len(touched) == 1
    assert {f for f in before if f[0] not in touched} == {f for f in held() if f[0] not in touched}
    got = {(r.agent_id, r.url): (r.clean_markdown, r.previous_markdown) for r in table.read().collect()}
    assert len(got) == 301 and got["s1", "u1"] == ("new text", "text 1") and got["s1", "u999"] == ("a new page", None)
    # all sites of a bucket go: its folder goes as well
    gone = table.read(touched).select("agent_id").distinct()
    n = table.read(touched).count()
    assert table.drop_sites(gone) == touched
    assert table.read(touched).count() == 0 and table.read().count() == 301 - n
    assert table.upsert(spark.createDataFrame([], schema)) == []
