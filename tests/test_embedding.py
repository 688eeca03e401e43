import numpy as np
import pandas as pd
import pytest

from corpus_engine.functions.vectors import norm
from corpus_engine.operators import embedding as B


def test_failed_texts_are_tried_once_more():
    calls = []

    def flaky(texts):
        calls.append(list(texts))
        return [None if t == "bad" or (t == "late" and len(calls) == 1) else [3.0, 4.0] for t in texts]

    assert B._embed_all(["a", "b", "late", "bad", "c"], flaky)[2:4] == [([3.0, 4.0], None), (None, "no vector")]
    assert calls[1:] == [["late"], ["bad"]]
    calls.clear()
    assert B._embed_all(["bad", "a"], flaky)[0][0] is None and len(calls) == 1


def test_embed(spark):
    df = spark.createDataFrame([(1, "a b b"), (2, "  "), (3, None)], "i int, t string")
    out = B.embed(df, "t", B.hashed_words(8), batch=2)
    rows = {r.i: r for r in out.withColumn("n", norm(out["embedding"])).collect()}
    assert np.isclose(rows[1].n, 1) and rows[2].embedding is None
    assert sorted(r.i for r in B.failures(out, 8).collect()) == [2, 3]


def test_errors_are_told(spark):
    def dead(texts):
        raise ValueError("no service")

    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, content string")
    rows = B.embed(df, "content", dead)
    assert {(r.embedding, r.error) for r in rows.collect()} == {(None, "ValueError: no service")}
    with pytest.raises(RuntimeError, match="no service"):
        B.require_embedded(rows)
    good = B.embed(df.filter("id = 1"), "content", B.hashed_words(8))
    assert B.require_embedded(good, ["id"]).first().error is None


def test_calls_share_a_frame():
    pages = [page for page in range(300) for _ in range(page % 3 + 1)]
    rows = pd.DataFrame({"page_id": pages, "_block": 0})
    frames = list(B._calls(iter([rows.iloc[:250], rows.iloc[250:251], rows.iloc[251:]]), ["page_id", "_block"]))
    assert len(frames) <= 4
    calls = [list(f["page_id"][b:e]) for f, starts in frames for b, e in zip(starts, [*starts[1:], len(f)])]
    assert calls == [[page] * (page % 3 + 1) for page in range(300)]


def test_vectors_must_fit_their_call(spark):
    df = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "c")], "page_id int, chunk_index int, content string")
    with pytest.raises(Exception, match="1 vectors for 2 texts"):
        B.embed_pages(df, "content", lambda texts: [[1.0]]).collect()


def test_calls_follow_pages(spark):
    calls = spark.sparkContext.accumulator(0)

    def picky(texts):
        calls.add(1)
        if "bad" in texts:
            raise ValueError("bad text")
        return [[float(len(t)), 1.0] if t else None for t in texts]

    rows = [(1, i, "good") for i in range(250)] + [(1, 250, "bad"), (2, 0, "bad"), (2, 1, "good"), (3, 0, ""), (3, 1, "x"), (3, 2, "y")]
    want = {}
    for page, index, text in rows:
        # page 1 loses 51 of 251 texts with their call and gets them back but one; page 2 loses all
        want[page, index] = text not in ("bad", "") and page != 2
    for parts in (1, 7):
        df = spark.createDataFrame(rows, "page_id int, chunk_index int, content string").repartition(parts)
        got = B.embed_pages(df, "content", picky).collect()
        assert {(r.page_id, r.chunk_index): r.embedding is not None for r in got} == want
        assert len(got) == len(rows) and all((r.embedding is None) == (r.error is not None) for r in got)
    assert calls.value == 2 * (3 + 1 + 1 + 51 + 1)
    empty = B.embed_pages(df.limit(0), "content", picky)
    assert empty.collect() == []
