import random

import pytest

from pyspark.sql import functions as F

from corpus_engine.operators import timeline as W
from corpus_engine.runtime import scratch_path
from corpus_engine.streaming import ingest, progress, runner
from corpus_engine.streaming.buckets import Sink

SECOND = 1_000_000


def events(spark, n=600, keys=4, span=900):
    rng = random.Random(11)
    # one key has a third of all rows; some times repeat
    rows = [
        (i, 0 if rng.random() < 0.34 else rng.randrange(1, keys), rng.randrange(span), rng.random() < 0.3) for i in range(n)
    ]
    df = spark.createDataFrame(rows, "event_id bigint, key bigint, sec bigint, ok boolean")
    return rows, df.withColumn("ts", F.timestamp_seconds("sec")).drop("sec")


def test_over_limit_and_openings(spark):
    rows, df = events(spark)
    got = {r.event_id: r.allowed for r in W.over_limit(df, 5, 60 * SECOND).collect()}
    assert got == {i: sum(k == key and 0 <= sec - s < 60 for _, k, s, _ in rows) <= 5 for i, key, sec, _ in rows}
    opened = {r.event_id for r in W.openings(df, 3, size_us=40 * SECOND).collect()}
    runs, want = {}, set()
    for i, key, sec, ok in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        runs[key] = 0 if ok else runs.get(key, 0) + 1
        if runs[key] == 3:
            want.add(i)
    assert opened == want


def test_repeats_across_slices(spark):
    rows, df = events(spark)
    got = {}
    for r in W.repeats_within(df, 9 * SECOND, ["key"], size_us=25 * SECOND).collect():
        got[r.key] = got.get(r.key, 0) + r.hit
    want = {}
    for key in {r[1] for r in rows}:
        times = sorted(r[2] for r in rows if r[1] == key)
        want[key] = sum(b - a < 9 for a, b in zip(times, times[1:]))
    assert got == want


def test_stream_equals_batch(spark, tmp_path):
    rows, df = events(spark, 200)
    # two files in time order, one per micro-batch
    folder = tmp_path / "events.parquet"
    df.filter("unix_timestamp(ts) < 450").coalesce(1).write.parquet(str(folder))
    df.filter("unix_timestamp(ts) >= 450").coalesce(1).write.mode("append").parquet(str(folder))
    stream = runner.read_stream(spark, str(tmp_path), "events", 1)
    counts = progress.keys_per_window(stream, "1 minute", failed=~F.col("ok"))
    got = {(r.window_start.timestamp(), r.key): (r.events, r.failures) for r in runner.run_update(counts, "t", ["window_start", "key"]).collect()}
    want = {}
    for _, key, sec, ok in rows:
        n, bad = want.get((sec // 60 * 60, key), (0, 0))
        want[sec // 60 * 60, key] = (n + 1, bad + (not ok))
    assert got == want


def test_failure_streaks_across_slices(spark):
    rows, df = events(spark)
    got = {r.event_id: r.streak for r in W.failure_streaks(df, 3, size_us=40 * SECOND).collect()}
    want, runs = {}, {}
    for i, key, sec, ok in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        runs[key] = 0 if ok else runs.get(key, 0) + 1
        if not ok:
            want[i] = runs[key]
    assert got == want


def test_sliding_counts_edges(spark):
    rows, df = events(spark)
    got = {r.event_id: r.in_window for r in W.sliding_counts(df, 60 * SECOND).collect()}
    want = {i: sum(k == key and 0 <= sec - s < 60 for _, k, s, _ in rows) for i, key, sec, _ in rows}
    assert got == want


def test_previous_version_across_slices(spark):
    df = spark.createDataFrame([(1, "u", s, f"t{s}") for s in (1, 2, 50, 200)] + [(1, "v", 3, "x")], "a int, u string, sec int, t string")
    df = df.withColumn("ts", F.timestamp_seconds("sec"))
    got = W.previous_version(df, ["a", "u"], "ts", "t", "before", 10 * SECOND).collect()
    assert {(r.u, r.sec): r.before for r in got} == {("u", 1): None, ("u", 2): "t1", ("u", 50): "t2", ("u", 200): "t50", ("v", 3): None}


def test_ingest_keeps_unchanged_chunks(spark):
    sink = scratch_path(spark, "t-ingest")
    long = "Words that make this piece long enough to stay as a chunk, number {} of the page in question here."

    def page(*parts):
        return "\n".join(f"## H{i}\n{long.format(p)}" for i, p in enumerate(parts))

    def batch(rows, n):
        ingest.ingest_batch(spark.createDataFrame(rows, "page_id bigint, title string, text string"), n, sink)

    batch([(1, "T", page(1, 2)), (2, "T", page(9))], 0)
    batch([(1, "T", page(1, 3)), (2, "T", "gone")], 1)
    batch([(1, "T", page(1, 3)), (2, "T", "gone")], 1)  # the batch is repeated after a failure
    rows = ingest.current_chunks(spark, sink).orderBy("page_id", "chunk_index").collect()
    assert [(r.page_id, r.chunk_index, "number 3" in r.content) for r in rows] == [(1, 0, False), (1, 1, True)]
    assert spark.read.parquet(f"{sink}/bodies/batch=1").count() == 1


def test_batches_read_their_own_buckets(spark):
    sink = scratch_path(spark, "t-buckets")
    text = "A page number {} whose text is long enough to be kept as one chunk in version {} of its life."

    def batch(ids, n):
        rows = [(i, "", text.format(i, n)) for i in ids]
        ingest.ingest_batch(spark.createDataFrame(rows, "page_id bigint, title string, text string"), n, sink)

    batch(range(300), 0)
    files = []
    for n in range(1, 7):
        batch([1, 2, 3], n)
        held = Sink(spark, sink)
        touched = held.touched(spark.createDataFrame([(1,), (2,), (3,)], "page_id bigint"), "page_id")
        state = held.read("manifest", ingest._MANIFEST, touched)
        files.append((state.count(), len(held.versions["manifest"])))
        assert len(touched) <= 3 and {r.v for r in state.selectExpr("max(body_batch) as v").collect()} == {n}
    # neither rows nor state folders grow with the number of batches
    assert len(set(files)) == 1
    fs = [p for p in spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{sink}/manifest").select("path").collect()]
    kept = {p.path.split("/manifest/")[1].split("/part-")[0] for p in fs if "/part-" in p.path}
    assert len(kept) <= held.buckets + 3 * 2
    before = {(r.page_id, r.content) for r in ingest.current_chunks(spark, sink).collect()}
    assert len(before) == 300 and ingest.compact(spark, sink, 7) > 0
    assert {(r.page_id, r.content) for r in ingest.current_chunks(spark, sink).collect()} == before
    assert spark.read.parquet(f"{sink}/bodies").count() == 300
    batch([1], 8)
    assert ingest.current_chunks(spark, sink).filter("chunk_id like '8-%'").count() == 1


def test_failed_batch_leaves_no_trace(spark):
    sink = scratch_path(spark, "t-failed")
    rows = [(i, "", f"Page {i} with words enough to make a chunk of at least eighty characters, as this one has.") for i in range(9)]
    pages = spark.createDataFrame(rows, "page_id bigint, title string, text string")
    ingest.ingest_batch(pages.filter("page_id < 5"), 0, sink)
    # all is written but the snapshot
    commit, Sink.commit = Sink.commit, lambda *a: (_ for _ in ()).throw(OSError("lost"))
    try:
        with pytest.raises(OSError):
            ingest.ingest_batch(pages.withColumn("text", F.upper("text")), 1, sink)
    finally:
        Sink.commit = commit
    assert ingest.current_chunks(spark, sink).count() == 5
    ingest.ingest_batch(pages.withColumn("text", F.upper("text")), 1, sink)
    got = ingest.current_chunks(spark, sink).collect()
    assert len(got) == 9 and all(r.content.isupper() for r in got)


def test_chunks_without_a_vector_are_not_stored(spark):
    sink = scratch_path(spark, "t-vectors")
    words = "enough words to be a chunk of its own, which has to be eighty characters long or more than that, "

    def embedder(texts):
        return [None if "bad" in t else [1.0, 2.0] for t in texts]

    rows = [(1, "", words + "good"), (2, "", words + "bad")]
    out = ingest.ingest_batch(spark.createDataFrame(rows, "page_id bigint, title string, text string"), 0, sink, embedder, 2)
    assert {r.outcome for r in out.collect()} == {"new"}
    assert [r.page_id for r in ingest.current_chunks(spark, sink).collect()] == [1]
    assert ingest.current_pages(spark, sink).count() == 2
