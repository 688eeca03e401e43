"""Pluggable text embedding in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpus_engine.functions.vectors import normalize_vector, valid_embedding
from corpus_engine.runtime import bound_batches, durable

Embedder = Callable[[list[str]], list]

# Texts per call, and the share of failures that stops a retry.
BATCH = 100
RETRY_BELOW = 0.5


def hashed_words(dim: int) -> Embedder:
    """Deterministic bag of hashed words, for tests and dry runs."""

    def embed_texts(texts: list[str]) -> list:
        out = []
        for text in texts:
            places = [crc32(w.encode()) % dim for w in text.lower().split()]
            out.append(np.bincount(places, minlength=dim).astype("float32") if places else None)
        return out

    return embed_texts


def word_shapes(dim: int) -> Embedder:
    """Deterministic counts of words by length and first letter; a text whose length is a multiple of 97 fails its call."""

    def embed_texts(texts: list[str]) -> list:
        if any(len(t) % 97 == 0 for t in texts):
            raise ValueError("a text of a forbidden length")
        places = [[(31 * len(w) + ord(w[0])) % dim for w in t.split()] for t in texts]
        return [np.bincount(p, minlength=dim).astype("float32") if p else None for p in places]

    return embed_texts


def _embed_all(texts: list, fn: Embedder) -> list[tuple]:
    """(vector, error) of the texts of one call; a vector is None where its text failed twice."""

    def attempt(some: list) -> list[tuple]:
        try:
            return [(v, None if v is not None else "no vector") for v in fn(some)]
        except Exception as e:  # a failed call fails its texts, and says why
            return [(None, f"{type(e).__name__}: {e}")] * len(some)

    found = attempt(texts)
    failed = [i for i, (v, _) in enumerate(found) if v is None]
    if failed and len(failed) < len(texts) * RETRY_BELOW:
        for i in failed:
            found[i] = attempt([texts[i]])[0]
    return found


def embed(df: DataFrame, text_col: str, fn: Embedder, batch: int = BATCH) -> DataFrame:
    """``df`` with ``embedding``, unit vectors, and ``error`` where the text failed.

    A failed text never gets a zero vector, which would match everything.
    """

    @F.pandas_udf("v array<float>, e string")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for series in batches:
            texts = series.fillna("").tolist()
            found = []
            for start in range(0, len(texts), batch):
                found += _embed_all(texts[start : start + batch], fn)
            yield pd.DataFrame({"v": pd.Series([v for v, _ in found], dtype=object), "e": pd.Series([e for _, e in found], dtype=object)})

    # not to be repeated for each field that is read
    raw = df.withColumn("_raw", vectors.asNondeterministic()(F.col(text_col)))
    return raw.withColumns({"embedding": normalize_vector(F.col("_raw.v")), "error": F.col("_raw.e")}).drop("_raw")


def _call(fn: Embedder, texts: list[str]) -> tuple[list, list]:
    """Vectors and errors of one call; a call that fails, fails its texts and says why."""
    try:
        found = list(fn(texts))
        return found, [None if v is not None else "no vector" for v in found]
    except Exception as e:
        return [None] * len(texts), [f"{type(e).__name__}: {e}"] * len(texts)


def _calls(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[pd.DataFrame, list[int]]]:
    """Frames of whole calls, and where each call starts; rows of equal ``keys`` follow each other."""
    held = None
    for rows in batches:
        rows = rows if held is None else pd.concat([held, rows], ignore_index=True)
        values = rows[keys]
        starts = (values != values.shift()).any(axis=1).to_numpy().nonzero()[0].tolist()
        if len(starts) > 1:
            yield rows.iloc[: starts[-1]], starts[:-1]
        held = rows.iloc[starts[-1] :] if starts else None
    if held is not None and len(held):
        yield held, [0]


def embed_pages(
    df: DataFrame, text_col: str, fn: Embedder, page: str = "page_id", index: str = "chunk_index", batch: int = BATCH
) -> DataFrame:
    """``df`` with ``embedding``, unit vectors, and ``error``; calls and retries follow the pages.

    A call takes the texts of one page whose ``index`` lies in the same hundred, so the
    result does not depend on partitions or Arrow batches. The first pass is written;
    of pages that lost less than half of their texts in it, the lost ones are tried
    again, one by one. Every column of ``df`` passes through.
    """
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    schema = f"{fields}, _block bigint, _raw array<float>, error string"

    def run(calls):
        def embedded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            # a frame holds many calls, for a small frame costs more than its texts
            for rows, starts in calls(batches):
                texts, vectors, errors = rows[text_col].fillna("").tolist(), [], []
                for begin, end in zip(starts, [*starts[1:], len(texts)]):
                    found = _call(fn, texts[begin:end])
                    if len(found[0]) != end - begin:
                        raise ValueError(f"{len(found[0])} vectors for {end - begin} texts")
                    vectors += found[0]
                    errors += found[1]
                yield rows.assign(_raw=pd.Series(vectors, index=rows.index, dtype=object), error=pd.Series(errors, index=rows.index, dtype=object))

        return embedded

    def one_by_one(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, list[int]]]:
        for rows in batches:
            if len(rows):
                yield rows, list(range(len(rows)))

    bound_batches(df.sparkSession)
    blocks = df.withColumn("_block", F.floor(F.col(index) / batch)).repartition(page, "_block")
    first = durable(blocks.sortWithinPartitions(page, "_block", index).mapInPandas(run(lambda batches: _calls(batches, [page, "_block"])), schema))
    lost = F.avg(F.col("error").isNotNull().cast("int"))
    retried = first.groupBy(page).agg(lost.alias("_lost")).filter((F.col("_lost") > 0) & (F.col("_lost") < RETRY_BELOW)).select(page)
    failed = F.col("error").isNotNull()
    again = first.filter(failed).join(retried, page, "left_semi")
    second = again.drop("_raw", "error").repartition(page, index).select(*df.columns, "_block").mapInPandas(run(one_by_one), schema)
    rest = first.filter(~failed).unionByName(first.filter(failed).join(retried, page, "left_anti"))
    both = rest.unionByName(second)
    return both.withColumn("embedding", normalize_vector(F.col("_raw"))).select(*df.columns, "embedding", "error")


def require_embedded(embedded: DataFrame, keys: list[str] | None = None, most: float = 0.5) -> DataFrame:
    """The rows, when in every group of ``keys`` (or over the job) at most that share has failed."""
    share = F.avg(F.col("error").isNotNull().cast("int")).alias("share")
    worst = embedded.groupBy(*(keys or [])).agg(share, F.first("error", ignorenulls=True).alias("error"))
    row = worst.orderBy(F.desc("share")).first()
    if row and row["share"] is not None and row["share"] > most:
        raise RuntimeError(f"{row['share']:.0%} of the texts have no vector, for example: {row['error']}")
    return embedded


def failures(embedded: DataFrame, dim: int) -> DataFrame:
    """Rows without a usable vector."""
    return embedded.filter(~valid_embedding(F.col("embedding"), dim))
