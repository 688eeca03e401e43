"""Ranked lexical search over a length-stratified index.

Documents of one length normaliser form a stratum, and a stratum of many documents is
kept in pieces. The stored index has a row per (piece, term, tf) with the places of the
documents, so the impact of a tf is computed once per stratum. A stratum's highest tf
of each term bounds what any of its documents can score. Queries first visit the
strata with the highest bounds, until those hold k matching documents; their k-th
score then rules out every stratum whose bound is lower, and the rest is visited.
All arithmetic is on integers.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpus_engine.llm.common import ascii_lower, bound_batches, field
from corpus_engine.runtime import durable, scratch_path, top_per_group

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
# Fixed values of the score.
SCALE, UNIT, WEIGHT = 1_000_000_000, 1000, 12
BASE, SHARE = 100, 25
K = 20

#: documents and different terms of a piece, items scored together, and entries of
#: their weight matrix: these bound what a task holds, and change no result
PIECE_DOCS = 1024
PIECE_TERMS = 2_000_000
BLOCK_ITEMS = 256
BLOCK_WEIGHTS = 4_000_000
#: rows of a small table up to which it is broadcast
BROADCAST_ROWS = 1_000_000
# below this, sums of products are exact in doubles
EXACT = 1 << 53

_LOWER = {i: i + 32 for i in range(65, 91)}
_FIND = re.compile(TERM).findall


def impact(tf, m):
    """What an occurrence count is worth in a stratum, for integers and arrays of them."""
    return (SCALE * tf) // (UNIT * tf + WEIGHT * m)


@dataclass(frozen=True)
class LexicalIndex:
    """Folders ``postings`` and ``pieces``, and the totals of the documents that have a term."""

    postings: DataFrame  # m, piece, term, tf, places: positions in the piece's doc_ids
    pieces: DataFrame  # m, piece, doc_ids
    n_documents: int
    n_terms: int


def _count_terms(texts: pd.Series) -> pd.DataFrame:
    out = []
    for text in texts:
        found = _FIND(text.translate(_LOWER)) if text else []
        counts: dict[str, int] = {}
        for term in found:
            counts[term] = counts.get(term, 0) + 1
        out.append((len(found), list(counts), list(counts.values())))
    return pd.DataFrame(out, columns=["n", "terms", "counts"])


POSTINGS = pa.schema(
    [("m", pa.int64()), ("piece", pa.int64()), ("term", pa.string()), ("tf", pa.int32()), ("places", pa.list_(pa.int32()))]
)


def _postings(key: tuple, terms: list[pa.Array], counts: list[np.ndarray]) -> pa.RecordBatch:
    """The documents of a piece, in the order of their places, as rows by term and tf."""
    words = pa.concat_arrays(terms).dictionary_encode()
    term, tf = words.indices.to_numpy(), np.concatenate(counts)
    place = np.repeat(np.arange(len(terms), dtype=np.int32), [len(t) for t in terms])
    order = np.lexsort((place, tf, term))
    term, tf, place = term[order], tf[order], place[order]
    new = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (tf[1:] != tf[:-1])])
    columns = [
        pa.array(np.full(len(new), key[0], dtype=np.int64)),
        pa.array(np.full(len(new), key[1], dtype=np.int64)),
        words.dictionary.take(pa.array(term[new])),
        pa.array(tf[new], pa.int32()),
        pa.ListArray.from_arrays(pa.array(np.r_[new, len(place)], pa.int32()), pa.array(place)),
    ]
    return pa.RecordBatch.from_arrays(columns, schema=POSTINGS)


def _invert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, terms, counts = None, [], []
    for batch in batches:
        own_terms, own_counts = batch["terms"], batch["counts"]
        for i, now in enumerate(zip(batch["m"].to_pylist(), batch["piece"].to_pylist())):
            if now != key:
                if key:
                    yield _postings(key, terms, counts)
                key, terms, counts = now, [], []
            terms.append(own_terms[i].values)
            counts.append(own_counts[i].values.to_numpy())
    if key:
        yield _postings(key, terms, counts)


def build_index(
    documents: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    piece_docs: int = PIECE_DOCS,
    piece_terms: int = PIECE_TERMS,
) -> LexicalIndex:
    """Index every row by its whole text.

    Documents without a term, null and empty texts included, are in no stratum. Rows
    with one id, or with none, are documents of their own. Other columns are not read,
    and an empty table gives an empty index. The tables lie in the shared folder.
    """
    spark = documents.sparkSession
    bound_batches(spark)
    count = F.pandas_udf(_count_terms, "n long, terms array<string>, counts array<int>").asNondeterministic()
    counted = documents.select(field(doc_id).alias("doc_id"), count(field(text)).alias("c"))
    forward = durable(counted.select("doc_id", "c.*").filter("n > 0"))
    n_documents, n_terms = forward.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    m = F.expr(f"{BASE - SHARE}L + ({SHARE}L * n * {n_documents}L) div {max(n_terms, 1)}L")
    forward = forward.withColumn("m", m)
    most = F.greatest(F.count("*") / piece_docs, F.sum(F.size("terms")) / piece_terms)
    strata = durable(forward.groupBy("m").agg(F.ceil(most).alias("pieces")))
    placed = forward.join(F.broadcast(strata) if strata.count() <= BROADCAST_ROWS else strata, "m")
    # dealt out evenly, however many rows are equal; which piece a row is in changes no result
    placed = placed.withColumn("piece", F.pmod(F.monotonically_increasing_id(), F.col("pieces"))).drop("pieces", "n")
    order = ["m", "piece", F.asc_nulls_last("doc_id")]
    sorted_rows = placed.repartition("m", "piece").sortWithinPartitions(*order)
    schema = "m long, piece long, term string, tf int, places array<int>"
    folder = scratch_path(spark, "lexical")
    sorted_rows.select("m", "piece", "terms", "counts").mapInArrow(_invert, schema).write.parquet(f"{folder}/postings")
    # the same order as above; rows of one id are alike here
    ids = F.sort_array(F.collect_list(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")))
    ids = F.transform(ids, lambda d: d["doc_id"]).alias("doc_ids")
    placed.groupBy("m", "piece").agg(ids).write.parquet(f"{folder}/pieces")
    read = spark.read.parquet
    return LexicalIndex(read(f"{folder}/postings"), read(f"{folder}/pieces"), n_documents, n_terms)


@dataclass(frozen=True)
class Weights:
    """The query side of a block of items: a row per item, a column per term."""

    terms: dict[str, int]
    matrix: np.ndarray

    def exact(self) -> bool:
        """Whether sums of weighted impacts are whole numbers that doubles hold."""
        return self.matrix.sum(axis=1).max(initial=0) * (SCALE // UNIT) < EXACT


def _bounds(weights):
    """Per stratum: what a document can score at most, and how many match at least."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = weights.value
        for batch in batches:
            batch = batch[batch["term"].isin(own.terms)]
            for m, rows in batch.groupby("m"):
                at = rows["term"].map(own.terms).to_numpy()
                part = own.matrix[:, at]
                bound = part @ impact(rows["tf"].to_numpy(np.int64), m).astype(np.float64)
                docs = np.where(part > 0, rows["docs"].to_numpy(np.int64), 0).max(axis=1)
                item = np.flatnonzero(bound > 0)
                yield pd.DataFrame({"item": item, "m": m, "bound": bound[item], "docs": docs[item]})

    return run


def _score(weights, floors, k: int):
    """The best documents of each item in every piece whose bound reaches the item's floor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, floor = weights.value, floors.value.astype(np.float64)
        schema = pa.schema(
            [("item", pa.int32()), ("m", pa.int64()), ("piece", pa.int64()), ("place", pa.int32()), ("score", pa.int64())]
        )
        best = np.zeros((len(floor), k))
        exact = own.exact()

        def scored(key, parts: list[pa.RecordBatch]) -> pa.RecordBatch | None:
            nonlocal best, floor
            whole = pa.Table.from_batches(parts)
            at = np.array([own.terms.get(t, -1) for t in whole["term"].to_pylist()])
            tf = whole["tf"].to_numpy().astype(np.int64)
            lists = whole["places"].combine_chunks()
            places, sizes = lists.flatten().to_numpy(), lists.value_lengths().to_numpy()
            used, row = np.unique(at, return_inverse=True)
            worth = impact(tf, key[0])
            # bound of this piece from the highest tf of each term
            top = np.zeros(len(used), dtype=np.int64)
            np.maximum.at(top, row, worth)
            top[used < 0] = 0
            part = own.matrix[:, used]
            items = np.flatnonzero(part @ top.astype(np.float64) >= np.maximum(floor, 1))
            if not len(items):
                return None
            kind = np.float64 if exact else np.int64
            values = np.zeros((len(used), places.max() + 1), dtype=kind)
            values[np.repeat(row, sizes), places] = np.repeat(worth, sizes)
            values[used < 0] = 0
            total = part[items].astype(kind) @ values
            # places follow doc_id, so a stable order settles ties
            order = np.argsort(-total, axis=1, kind="stable")[:, :k]
            found = np.take_along_axis(total, order, axis=1)
            good = found >= np.maximum(floor[items], 1)[:, None]
            merged = np.concatenate([best[items], found], axis=1)
            best[items] = -np.sort(-merged, axis=1)[:, :k]
            floor = np.maximum(floor, best[:, k - 1])
            i, j = np.nonzero(good)
            columns = [
                pa.array(items[i], pa.int32()),
                pa.array(np.full(len(i), key[0], dtype=np.int64)),
                pa.array(np.full(len(i), key[1], dtype=np.int64)),
                pa.array(order[i, j], pa.int32()),
                pa.array(found[i, j].astype(np.int64)),
            ]
            return pa.RecordBatch.from_arrays(columns, schema=schema)

        key, held = None, []
        for batch in batches:
            m, piece = batch["m"].to_numpy(), batch["piece"].to_numpy()
            cuts = np.flatnonzero((m[1:] != m[:-1]) | (piece[1:] != piece[:-1])) + 1
            for begin, end in zip([0, *cuts], [*cuts, len(m)]):
                if begin == end:
                    continue
                now = (int(m[begin]), int(piece[begin]))
                if now != key:
                    if key and (out := scored(key, held)):
                        yield out
                    key, held = now, []
                held.append(batch.slice(begin, end - begin))
        if key and (out := scored(key, held)):
            yield out

    return run


def query_terms(queries: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """``item_id, term, q``: the terms of each item with their repeats."""
    found = F.regexp_extract_all(ascii_lower(F.coalesce(field(text), F.lit(""))), F.lit(TERM), F.lit(0))
    each = queries.select(field(item_id).alias("item_id"), F.explode(found).alias("term"))
    return each.groupBy("item_id", "term").agg(F.count("*").alias("q"))


def search(
    index: LexicalIndex, queries: DataFrame, item_id: str = "item_id", text: str = "text", k: int = K
) -> DataFrame:
    """``item_id, rank, doc_id, score``: the k best documents of each item, exact.

    Equal scores go by ascending doc_id, null last; only scores above 0 count. Rows of
    one item id, or of none, are one item. Items without a term, null texts included,
    and an empty index give no rows; other columns are not read.

    Items are scored in blocks whose weights are broadcast. The bounds of a block are
    a row per (item, stratum), never per document.
    """
    spark = queries.sparkSession
    terms = durable(query_terms(queries, item_id, text))
    id_type = terms.schema["item_id"].dataType.simpleString()
    doc_type = index.pieces.select(F.explode("doc_ids").alias("d")).schema["d"].dataType.simpleString()
    wanted = terms.select("term").distinct()
    n_wanted = wanted.count()
    hits = index.postings.join(F.broadcast(wanted) if n_wanted <= BROADCAST_ROWS else wanted, "term", "left_semi")
    summary = durable(
        hits.groupBy("m", "term").agg(F.max("tf").alias("tf"), F.sum(F.size("places")).cast("long").alias("docs"))
    )
    frequency = summary.groupBy("term").agg(F.sum("docs").alias("df"))
    rarity = F.floor(1000 * F.log((2 * F.lit(index.n_documents) + 2) / (2 * F.col("df") + 1)))
    weighted = terms.join(frequency, "term").select("item_id", "term", (rarity * F.col("q")).cast("long").alias("w"))
    weighted = weighted.filter("w > 0")
    n_items = terms.select("item_id").distinct().count()
    blocks = max(1, math.ceil(n_items / BLOCK_ITEMS), math.ceil(n_items * n_wanted / BLOCK_WEIGHTS))
    weighted = durable(weighted.withColumn("block", F.pmod(F.xxhash64(F.col("item_id").cast("string")), F.lit(blocks))))
    parts = [_search_block(index, hits, summary, weighted.filter(F.col("block") == b), k, id_type) for b in range(blocks)]
    parts = [p for p in parts if p is not None]
    if not parts:
        return spark.createDataFrame([], f"item_id {id_type}, rank int, doc_id {doc_type}, score long").withColumnRenamed(
            "item_id", item_id
        )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumnRenamed("item_id", item_id)


def _search_block(index, hits, summary, weighted: DataFrame, k: int, id_type: str) -> DataFrame | None:
    spark = hits.sparkSession
    rows = weighted.select("item_id", "term", "w").collect()  # BLOCK_WEIGHTS bounds these
    if not rows:
        return None
    ids = list({r.item_id: None for r in rows})
    item_of = {v: i for i, v in enumerate(ids)}
    term_of = {t: i for i, t in enumerate(sorted({r.term for r in rows}))}
    matrix = np.zeros((len(ids), len(term_of)))
    for r in rows:
        matrix[item_of[r.item_id], term_of[r.term]] = r.w
    weights = spark.sparkContext.broadcast(Weights(term_of, matrix))

    def scores(strata: DataFrame, floors: np.ndarray) -> DataFrame:
        chosen = hits.join(strata, "m", "left_semi").select("m", "piece", "term", "tf", "places")
        ordered = chosen.repartition("m", "piece").sortWithinPartitions("m", "piece")
        best = ordered.mapInArrow(
            _score(weights, spark.sparkContext.broadcast(floors), k),
            "item int, m long, piece long, place int, score long",
        )
        return durable(best)

    bounds = summary.repartition("m").sortWithinPartitions("m").mapInPandas(
        _whole_strata(_bounds(weights)), "item int, m long, bound double, docs long"
    )
    bounds = durable(bounds)
    # the strata of the highest bounds, until those before hold k documents of the item
    order = Window.partitionBy("item").orderBy(F.desc("bound"), "m")
    before = F.sum("docs").over(order) - F.col("docs")
    seeds = durable(bounds.withColumn("before", before).filter(F.col("before") < k).select("m").distinct())
    first = scores(seeds, np.zeros(len(ids), dtype=np.int64))
    ranked = top_per_group(first, ["item"], [F.desc("score")], k)
    floors = np.zeros(len(ids), dtype=np.int64)
    for r in ranked.filter(F.col("rn") == k).select("item", "score").collect():  # a row per item of the block
        floors[r.item] = r.score
    known = spark.createDataFrame([(i, int(f)) for i, f in enumerate(floors)], "item int, floor long")
    reaching = bounds.join(F.broadcast(known), "item").filter(F.col("bound") >= F.col("floor"))
    rest = reaching.join(seeds, "m", "left_anti").select("m").distinct()
    found = first.unionByName(scores(rest, floors))
    # an item's k-th score over all strata leaves few places to look up
    ranked = top_per_group(found, ["item"], [F.desc("score")], k)
    least = ranked.filter(F.col("rn") == k).select("item", F.col("score").alias("least"))
    found = found.join(F.broadcast(least), "item", "left").filter("least is null or score >= least").drop("least")
    names = spark.createDataFrame(list(enumerate(ids)), f"item int, item_id {id_type}")
    placed = found.join(index.pieces, ["m", "piece"]).select(
        "item", F.element_at("doc_ids", F.col("place") + 1).alias("doc_id"), "score"
    )
    best = top_per_group(placed, ["item"], [F.desc("score"), F.asc_nulls_last("doc_id")], k, "rank")
    return best.join(F.broadcast(names), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def _whole_strata(fn):
    """Apply ``fn`` to frames that hold only whole strata; the input is sorted by m."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def whole() -> Iterator[pd.DataFrame]:
            held = None
            for batch in batches:
                held = batch if held is None else pd.concat([held, batch])
                last = held["m"].iloc[-1]
                yield held[held["m"] != last]
                held = held[held["m"] == last]
            if held is not None:
                yield held

        yield from fn(frame for frame in whole() if len(frame))

    return run


ORACLE = r"""
WITH doc AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents WHERE text IS NOT NULL),
total AS (SELECT count(*)::BIGINT AS n, sum(len(w))::BIGINT AS l FROM doc WHERE len(w) > 0),
tf AS (SELECT doc_id, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, unnest(w) AS term FROM doc) GROUP BY ALL),
weight AS (
  SELECT term, floor(1000 * ln((2 * n + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w
  FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), total),
length AS (SELECT doc_id, 75 + (25 * len(w) * n) // l AS m FROM doc, total WHERE len(w) > 0),
item AS (
  SELECT item_id, term, count(*)::BIGINT AS q FROM (
    SELECT item_id, unnest(regexp_extract_all(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
scored AS (
  SELECT item_id, doc_id, sum(q * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
  FROM item JOIN weight USING (term) JOIN tf USING (term) JOIN length USING (doc_id) GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM scored WHERE score > 0
QUALIFY rank <= 20
"""
