"""Benchmark decontamination with a broadcast set of test n-grams.

Only DataFrame expressions: each text becomes the hashes of its word windows, the
hashes probe the broadcast benchmark windows, and every hit is verified word by word.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpus_engine.llm.common import ascii_lower, field

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 13
BROADCAST_BYTES = 64 << 20


def words(text: Column) -> Column:
    """Words after lower-casing A-Z; none for null."""
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def benchmark_windows(benchmark: DataFrame, item_id: str, text: str, window: int) -> DataFrame:
    """``hash, window, len, items``: each distinct window with the items that hold it."""
    item = F.coalesce(field(item_id).cast("string"), F.lit("")).alias("item")
    items = benchmark.select(item, words(field(text)).alias("w")).filter(F.size("w") > 0)
    length = F.least(F.size("w"), F.lit(window))
    starts = F.sequence(F.lit(1), F.size("w") - length + 1)
    each = items.select("item", F.explode_outer(F.transform(starts, lambda i: F.slice("w", i, length))).alias("window"))
    return (
        each.groupBy("window")
        .agg(F.collect_set("item").alias("items"))
        .select(F.xxhash64("window").alias("hash"), "window", F.size("window").alias("len"), "items")
    )


def window_hits(
    documents: DataFrame,
    benchmark: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """``doc_id, text_hash, copies, n_words, hits, items`` per distinct (id, text).

    ``hits`` are the verified windows as sorted (start, len), ``items`` the sorted ids
    of the benchmark items they come from. The benchmark's windows are counted first:
    up to ``broadcast_bytes`` they are broadcast at once, beyond that in that many
    blocks of hash values, each of which is broadcast and scanned for in turn.
    """
    windows = benchmark_windows(benchmark, item_id, item_text, window)
    size = F.sum(F.octet_length(F.concat_ws(" ", "window")) + F.octet_length(F.concat_ws(" ", "items")) + 64)
    total, lengths = windows.agg(F.coalesce(size, F.lit(0)), F.collect_set("len")).first()
    blocks = max(1, math.ceil(total / broadcast_bytes))

    base = documents.select(
        field(doc_id).alias("doc_id"),
        F.xxhash64(field(text)).alias("text_hash"),
        words(field(text)).alias("w"),
    )

    def hashes(n: int) -> Column:
        starts = F.when(F.size("w") >= n, F.sequence(F.lit(1), F.size("w") - (n - 1)))
        made = F.transform(
            starts,
            lambda i: F.struct(i.alias("start"), F.lit(n).alias("n"), F.xxhash64(F.slice("w", i, n)).alias("h")),
        )
        return F.coalesce(made, F.array().cast("array<struct<start:int,n:int,h:bigint>>"))

    # one marker per row, then the row's windows
    marker = F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("n"), F.lit(None).cast("long").alias("h")))
    probes = base.withColumn("probes", F.concat(marker, *(hashes(n) for n in sorted(lengths))))
    # the outer form: otherwise the optimizer filters on, and so repeats, the whole expression
    probes = probes.select("doc_id", "text_hash", "w", F.explode_outer("probes").alias("p")).select(
        "doc_id", "text_hash", "w", "p.start", "p.n", "p.h"
    )
    parts = []
    for block in range(blocks):
        own = windows.filter(F.pmod(F.col("hash"), F.lit(blocks)) == block)
        joined = probes.join(F.broadcast(own), probes.h == own.hash, "left")
        same = F.col("window").isNotNull() & (F.slice("w", F.col("start"), F.col("n")) == F.col("window"))
        is_marker = F.col("n") == 0
        found = joined.filter(is_marker & F.lit(block == 0) | (F.col("n") > 0) & same)
        parts.append(
            found.select(
                "doc_id",
                "text_hash",
                F.when(is_marker, F.size("w")).alias("n_words"),
                F.when(~is_marker, F.struct("start", F.col("n").alias("len"))).alias("hit"),
                "items",
            )
        )
    return (
        reduce(DataFrame.unionByName, parts)
        .groupBy("doc_id", "text_hash")
        .agg(
            F.count("n_words").alias("copies"),
            F.max("n_words").alias("n_words"),
            F.array_sort(F.collect_set("hit")).alias("hits"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
        )
    )


def covered(hits: Column) -> Column:
    """Words inside any of the sorted (start, len) windows."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))

    def add(state, hit):
        end = F.greatest(state["end"], hit["start"] + hit["len"])
        return F.struct((state["n"] + end - F.greatest(state["end"], hit["start"])).alias("n"), end.alias("end"))

    return F.aggregate(hits, start, add, lambda state: state["n"]).cast("long")


def decontaminate(
    documents: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **options
) -> DataFrame:
    """``doc_id, text_hash, n_words, n_hit, hits, items, contaminated``, one row per input row.

    A null text has no words. Rows of one id are told apart by their text; repeated
    rows are all returned. A null item id is written as empty text, items of one id
    are one item, and an empty benchmark hits nothing. Other columns are left out, so
    their names can't clash.
    """
    hits = window_hits(documents, benchmark, doc_id, text, **options)
    judged = hits.withColumn("n_hit", covered(F.col("hits"))).withColumn("n_words", F.col("n_words").cast("long"))
    judged = judged.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
    judged = judged.withColumn("copies", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return judged.select(
        F.col("doc_id").alias(doc_id), "text_hash", "n_words", "n_hit", "hits", "items", "contaminated"
    )


ORACLE = r"""
WITH doc AS (
  SELECT doc_id, row_number() OVER () AS r,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bench AS (
  SELECT item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
test AS (
  SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM (
    SELECT item_id, w, least(len(w), 13) AS k, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i
    FROM bench WHERE len(w) > 0)),
train AS (
  SELECT r, k, i, array_to_string(w[i:i + k - 1], ' ') AS g FROM (
    SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i
    FROM doc, (SELECT DISTINCT k FROM test) WHERE len(w) >= k)),
hit AS (SELECT r, item_id, i, t.k FROM train t JOIN test USING (k, g)),
word AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT DISTINCT r, unnest(range(i, i + k)) AS p FROM hit) GROUP BY r),
item AS (
  SELECT r, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT r, coalesce(item_id::VARCHAR, '') AS id FROM hit) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(word.n, 0)::BIGINT AS n_hit,
       coalesce(item.n, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(word.n, 0) > 0 AND 20 * coalesce(word.n, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN word USING (r) LEFT JOIN item USING (r)
"""
