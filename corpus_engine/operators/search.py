"""Vector, keyword and hybrid top-k retrieval for many queries at once.

Vectors are packed into matrix blocks inside the map tasks; query blocks meet
chunk blocks of the same site, and each pair of blocks gives its best rows only.
So no pair of a query and a chunk becomes a row, and a site of any size is spread
over its blocks. Query blocks are written first, so that Spark knows their bytes:
it broadcasts them or shuffles both sides, and splits a site that is skewed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpus_engine.operators.keyword import KeywordIndex, keyword_top
from corpus_engine.runtime import durable, top_per_group

QUERY_BLOCK = 512
CHUNK_BLOCK = 4096

# Result counts of the retrieval presets.
PRESETS = {"chat": 15, "fallback": 8, "data": 8, "knowledge": 10}


def _packed(df: DataFrame, id_col: str, site_col: str, vec_col: str, rows: int) -> DataFrame:
    """Blocks of unit vectors per site, built from the rows of each Arrow batch."""
    fields = {f.name: f.dataType.simpleString() for f in df.schema.fields}

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = pdf[pdf["vec"].map(lambda v: v is not None and len(v) > 0)]
            dims = pdf["vec"].map(len)
            for (site, dim), part in pdf.groupby(["site", dims.rename("dim")], sort=False):
                for start in range(0, len(part), rows):
                    block = part.iloc[start : start + rows]
                    m = np.stack(block["vec"].to_numpy()).astype(np.float64)
                    size = np.linalg.norm(m, axis=1)
                    some = size > 0  # a zero vector has no direction
                    if some.any():
                        m = m[some] / size[some, None]
                        ids = list(block["id"].to_numpy()[some])
                        yield pd.DataFrame(
                            {"site": [site], "dim": [dim], "ids": [ids], "vectors": [m.tobytes()]}
                        )

    return df.select(
        F.col(site_col).alias("site"), F.col(id_col).alias("id"), F.col(vec_col).alias("vec")
    ).mapInPandas(
        pack, f"site {fields[site_col]}, dim int, ids array<{fields[id_col]}>, vectors binary"
    )


def vector_search(
    queries: DataFrame,
    chunks: DataFrame,
    threshold: float = 0.5,
    k: int = 5,
    query_id: str = "query_id",
    chunk_id: str = "chunk_id",
    site: str = "agent_id",
    vector: str = "embedding",
) -> DataFrame:
    """Per query its ``k`` most similar chunks of the same site above ``threshold``."""
    q_type = queries.schema[query_id].dataType.simpleString()
    c_type = chunks.schema[chunk_id].dataType.simpleString()
    q = _packed(queries, query_id, site, vector, QUERY_BLOCK)
    c = _packed(chunks, chunk_id, site, vector, CHUNK_BLOCK)
    q = q.withColumnsRenamed({"ids": "query_ids", "vectors": "query_vectors"})
    pairs = c.join(durable(q), ["site", "dim"])

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                a = np.frombuffer(row.query_vectors).reshape(-1, row.dim)
                b = np.frombuffer(row.vectors).reshape(-1, row.dim)
                sims = a @ b.T
                if k < sims.shape[1]:
                    # the k-th best value; rows that tie with it stay in
                    floor = -np.partition(-sims, k - 1, axis=1)[:, k - 1 : k]
                    keep = (sims > threshold) & (sims >= floor)
                else:
                    keep = sims > threshold
                qi, ci = np.nonzero(keep)
                yield pd.DataFrame(
                    {
                        query_id: np.asarray(row.query_ids)[qi],
                        chunk_id: np.asarray(row.ids)[ci],
                        "similarity": sims[qi, ci],
                    }
                )

    hits = pairs.mapInPandas(score, f"{query_id} {q_type}, {chunk_id} {c_type}, similarity double")
    return top_per_group(
        hits, [query_id], [F.col("similarity").desc(), F.col(chunk_id)], k, "rank"
    )


def _sketch(m: np.ndarray, bits: int, seed: int) -> np.ndarray:
    """Signs on random planes, packed into 64-bit words."""
    planes = np.random.default_rng([seed, m.shape[1]]).standard_normal((m.shape[1], bits))
    return np.packbits(m @ planes > 0, axis=1).view(np.uint64)


def ann_hits(
    queries: DataFrame,
    chunks: DataFrame,
    k: int = 5,
    bits: int = 512,
    share: float = 0.1,
    seed: int = 7,
    query_id: str = "query_id",
    chunk_id: str = "chunk_id",
    site: str = "agent_id",
    vector: str = "embedding",
) -> DataFrame:
    """The best ``k`` of each query in each block: ``(ids, similarity, block, compared)``.

    Sketches of ``bits`` signs are compared first; only the nearest ``share`` of a
    block, ``4 k`` at least, is compared exactly. ``compared`` counts those.
    """
    q_type = queries.schema[query_id].dataType.simpleString()
    c_type = chunks.schema[chunk_id].dataType.simpleString()
    q = _packed(queries, query_id, site, vector, QUERY_BLOCK)
    c = _packed(chunks, chunk_id, site, vector, CHUNK_BLOCK)
    pairs = c.join(durable(q.withColumnsRenamed({"ids": "query_ids", "vectors": "query_vectors"})), ["site", "dim"])

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                a = np.frombuffer(row.query_vectors).reshape(-1, row.dim)
                b = np.frombuffer(row.vectors).reshape(-1, row.dim)
                near = min(len(b), max(4 * k, math.ceil(len(b) * share)))
                far, own = _sketch(b, bits, seed), _sketch(a, bits, seed)
                for i in range(len(a)):
                    apart = np.bitwise_count(far ^ own[i]).sum(1, dtype=np.int32)
                    few = np.argpartition(apart, near - 1)[:near] if near < len(b) else np.arange(len(b))
                    sims = b[few] @ a[i]
                    best = np.argsort(-sims, kind="stable")[:k]
                    yield pd.DataFrame(
                        {
                            query_id: [row.query_ids[i]] * len(best),
                            chunk_id: np.asarray(row.ids)[few[best]],
                            "similarity": sims[best],
                            "block": str(row.ids[0]),
                            "compared": near,
                        }
                    )

    return pairs.mapInPandas(
        score, f"{query_id} {q_type}, {chunk_id} {c_type}, similarity double, block string, compared bigint"
    )


def ann_search(
    queries: DataFrame, chunks: DataFrame, k: int = 5, threshold: float = 0.5, **options
) -> DataFrame:
    """Approximate form of :func:`vector_search`: sketches choose what is compared."""
    query_id, chunk_id = options.get("query_id", "query_id"), options.get("chunk_id", "chunk_id")
    hits = ann_hits(queries, chunks, k, **options).drop("block", "compared")
    return top_per_group(
        hits.filter(F.col("similarity") > threshold), [query_id], [F.col("similarity").desc(), F.col(chunk_id)], k, "rank"
    )


def hybrid_join(semantic: DataFrame, keyword: DataFrame, keys: list[str]) -> DataFrame:
    """Semantic hits with their keyword rank, zero where there is none."""
    return semantic.join(keyword, keys, "left").withColumn(
        "keyword_rank", F.coalesce("keyword_rank", F.lit(0.0))
    )


def combined_score(
    similarity: Column, rank: Column, weight: Column, semantic: float = 0.7, keyword: float = 0.3
) -> Column:
    return (similarity * semantic + rank * keyword) * F.coalesce(weight, F.lit(1.0))


def hybrid_search(
    queries: DataFrame,
    chunks: DataFrame,
    index: KeywordIndex,
    k: int = 8,
    threshold: float = 0.5,
    keyword_weight: float = 0.3,
    semantic_weight: float = 0.7,
    stop_words: bool = True,
) -> DataFrame:
    """Semantic top ``2k`` rescored with the keyword top ``2k``; best ``k`` per query.

    ``queries`` has ``query_id, agent_id, embedding, query_text``; ``chunks`` has
    ``chunk_id, agent_id, embedding, rank_weight``; ``index`` is the stored keyword
    index. Hits found by keywords alone do not appear.
    """
    semantic = vector_search(queries, chunks, threshold, 2 * k).drop("rank")
    keyword = keyword_top(queries, index, 2 * k, stop_words).drop("ranked")
    scored = (
        hybrid_join(semantic, keyword, ["query_id", "chunk_id"])
        .join(chunks.select("chunk_id", "rank_weight"), "chunk_id")
        .withColumn(
            "combined_score",
            combined_score(
                F.col("similarity"), F.col("keyword_rank"), F.col("rank_weight"), semantic_weight, keyword_weight
            ),
        )
        .drop("rank_weight")
    )
    return top_per_group(
        scored,
        ["query_id"],
        [F.col("combined_score").desc(), F.col("chunk_id")],
        k,
        "rank"
    )
