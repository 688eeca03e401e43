"""Near copies: a Jaccard join on word n-grams by MinHash banding.

Texts with one n-gram set are one node. Bands of MinHash rows send similar nodes to
one bucket; bucket mates are verified on their full n-gram sets. Buckets of many
nodes are not paired row by row: they merge into clusters, whose members are
compared block against block, each block pair in a task of its own.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpus_engine.llm.common import bound_batches, field, per_row, tidy
from corpus_engine.llm.components import components
from corpus_engine.runtime import durable

TOKEN = re.compile(r"\w+")
SIMILARITY, WORDS, RECALL = 0.8, 5, 0.999
#: Larger buckets are compared in blocks; not a cap, only another way to the same links.
BUCKET_PAIRS = 32
BLOCK_NODES, BLOCK_GRAMS = 256, 200_000


def bands_for(similarity: float, recall: float, most: int = 128) -> tuple[int, int]:
    """(bands, rows): the most rows whose bands reach the recall at that similarity within ``most`` hashes.

    Raises ValueError if no banding does.
    """
    best = None
    for rows in range(1, 17):
        bands = math.ceil(math.log(1 - recall) / math.log1p(-(similarity**rows)))
        if bands * rows <= most:
            best = (bands, rows)
    if best is None:
        raise ValueError(f"no banding of {most} hashes finds similarity {similarity} with recall {recall}")
    return best


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; products wrap around."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Grams:
    """Sorted distinct 64-bit hashes of a text's word n-grams."""

    def __init__(self, n: int, remember: int = 100_000):
        self.n, self.remember, self.known = n, remember, {}
        self.weights = _mix(np.arange(1, n + 1, dtype=np.uint64)) | np.uint64(1)

    def of(self, text: str | None) -> np.ndarray:
        """One n-gram of all words where there are fewer than n; none without a word."""
        words = TOKEN.findall((text or "").lower())
        ids = list(map(self.known.get, words))
        if None in ids:
            if len(self.known) > self.remember:
                self.known = {}
            for i, word in enumerate(words):
                if ids[i] is None:
                    ids[i] = self.known[word] = xxhash.xxh3_64_intdigest(word)
        h = np.array(ids, dtype=np.uint64)
        count = max(1, len(h) - self.n + 1) if len(h) else 0
        total = np.zeros(count, dtype=np.uint64)
        for j in range(min(self.n, len(h))):
            total += h[j : j + count] * self.weights[j]
        return np.unique(_mix(total + np.uint64(min(self.n, len(h)))))


def signature(grams: np.ndarray, seeds: np.ndarray, bands: int, block: int = 50_000) -> np.ndarray:
    """One hash per band of the row minima."""
    low = np.full(len(seeds), np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(grams), block):
        part = grams[at : at + block]
        low = np.minimum(low, np.array([((part ^ s) * (s | np.uint64(1))).min() for s in seeds]))
    rows = low.reshape(bands, -1)
    weights = _mix(np.arange(1, rows.shape[1] + 1, dtype=np.uint64)) | np.uint64(1)
    return _mix((rows * weights).sum(1, dtype=np.uint64) + np.arange(bands, dtype=np.uint64)).astype(np.int64)


def sketches(documents: DataFrame, doc_id: str, text: str, n: int, bands: int, rows: int) -> DataFrame:
    """``doc_id, text_hash, node, n, bands``; the node is a 128-bit hash of the n-gram set, null without one."""

    def make():
        grams, seeds = Grams(n), _mix(np.arange(1, bands * rows + 1, dtype=np.uint64) * np.uint64(7919))

        def run(texts):
            out = []
            for t in texts:
                g = grams.of(t)
                out.append((xxhash.xxh3_128_digest(g.tobytes()), len(g), signature(g, seeds, bands)) if len(g) else (None, 0, None))
            return pd.DataFrame(out, columns=["node", "n", "bands"])

        return run

    made = per_row(make, "node binary, n long, bands array<long>", field(text))
    return documents.select(
        field(doc_id).alias("doc_id"), F.xxhash64(field(text)).alias("text_hash"), made.alias("s")
    ).select("doc_id", "text_hash", "s.*")


def gram_sets(documents: DataFrame, text: str, wanted: DataFrame, n: int) -> DataFrame:
    """``node, grams`` of the nodes in ``wanted`` (``node, text_hash``)."""
    texts = documents.select(F.xxhash64(field(text)).alias("text_hash"), field(text).alias("t"))
    texts = texts.filter(F.col("t").isNotNull()).join(wanted.select("text_hash"), "text_hash", "left_semi")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grams = Grams(n)
        for batch in batches:
            sets = [grams.of(t) for t in batch["t"]]
            nodes = [xxhash.xxh3_128_digest(g.tobytes()) for g in sets]
            frame = pd.DataFrame({"node": nodes, "grams": [g.astype(np.int64) for g in sets]})
            yield frame.drop_duplicates("node")

    bound_batches(documents.sparkSession)
    found = texts.mapInPandas(tidy(run), "node binary, grams array<long>")
    # copies of a text are equal, so any one will do
    return found.groupBy("node").agg(F.min("grams").alias("grams"))


def _overlaps(left: list[np.ndarray], right: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Sizes of all intersections, from products of 0/1 matrices a few thousand n-grams wide."""
    grams = np.concatenate([*left, *right])
    owner = np.repeat(np.arange(len(left) + len(right)), [len(x) for x in (*left, *right)])
    values, inverse, counts = np.unique(grams, return_inverse=True, return_counts=True)
    shared = counts > 1
    number = np.cumsum(shared) - 1
    keep = shared[inverse]
    column, owner = number[inverse][keep], owner[keep]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    total = np.zeros((len(left), len(right)), dtype=np.float32)
    for at in range(0, int(shared.sum()), columns):
        lo, hi = np.searchsorted(column, [at, at + columns])
        m = np.zeros((len(left) + len(right), columns), dtype=np.float32)
        m[owner[lo:hi], column[lo:hi] - at] = 1
        total += m[: len(left)] @ m[len(left) :].T
    return total


def _local_labels(links: np.ndarray, same: bool) -> np.ndarray:
    """Smallest index reachable in a block pair; indices run over the left, then the right block."""
    a, b = links.shape
    label = np.arange(a if same else a + b)
    left, right = np.nonzero(links)
    right = right if same else right + a
    while True:
        new = label.copy()
        np.minimum.at(new, left, label[right])
        np.minimum.at(new, right, label[left])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def block_links(similarity: float):
    """Links within one block pair: weighted counts, and a label that joins linked nodes."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        same = frame["i"].iloc[0] == frame["j"].iloc[0]
        frame = frame.sort_values("node", kind="stable")
        left = frame[frame["own"] == frame["i"]]
        right = left if same else frame[frame["own"] == frame["j"]]
        if left.empty or right.empty:
            return pd.DataFrame([], columns=["node", "mate", "links"])
        a = [np.asarray(g, dtype=np.int64) for g in left["grams"]]
        b = a if same else [np.asarray(g, dtype=np.int64) for g in right["grams"]]
        shared = _overlaps(a, b)
        sizes = np.array([len(x) for x in a])[:, None] + np.array([len(x) for x in b])[None, :]
        linked = shared >= similarity * (sizes - shared) - 1e-6
        if same:
            np.fill_diagonal(linked, False)
        nodes = [*left["node"], *([] if same else right["node"])]
        counts = [linked @ right["copies"].to_numpy()]
        if not same:
            counts.append(linked.T @ left["copies"].to_numpy())
        label = _local_labels(linked, same)
        out = pd.DataFrame({"node": nodes, "mate": [nodes[k] for k in label], "links": np.concatenate(counts)})
        return out[out["links"] > 0]

    return run


def _hot_links(hot: DataFrame, nodes: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """``node, mate, links`` among the nodes of each cluster (``node, cluster``), block against block."""
    rows = hot.join(nodes.select("node", "copies", "n"), "node")
    blocks = rows.groupBy("cluster").agg(
        F.ceil(F.greatest(F.count("*") / BLOCK_NODES, F.sum("n") / BLOCK_GRAMS)).cast("int").alias("blocks")
    )
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    rows = rows.join(blocks, "cluster").withColumn("own", own).join(sets, "node")
    others = F.sequence(F.lit(0), F.col("blocks") - 1)
    pairs = rows.withColumn("other", F.explode(others)).select(
        "cluster", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "copies", "grams"
    )
    return pairs.groupBy("cluster", "i", "j").applyInPandas(block_links(similarity), "node binary, mate binary, links long")


def near_copies(
    documents: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    n: int = WORDS,
    similarity: float = SIMILARITY,
    recall: float = RECALL,
) -> DataFrame:
    """``doc_id, text_hash, class_key, class_id, n_links``, one row per input row.

    Two texts are linked when the Jaccard similarity of their sets of ``n`` successive
    words (lower case, ``\\w+``) is at least ``similarity``; a text of fewer words has
    one n-gram of them all. ``n_links`` counts the other rows that a row is linked to,
    copies included. A class is what links connect, and its id its smallest doc_id;
    ``class_key`` tells classes apart that have no id.

    Null texts and texts without a word have no n-gram: no links, and a class of their
    own. Null ids are members but never a class id where another id exists. Repeated
    rows are copies. Other columns are left out.
    """
    bands, rows = bands_for(similarity, recall)
    thin = durable(sketches(documents, doc_id, text, n, bands, rows))
    nodes = durable(
        thin.filter(F.col("node").isNotNull())
        .groupBy("node")
        .agg(
            F.count("*").alias("copies"),
            F.min("doc_id").alias("first_id"),
            F.min("text_hash").alias("text_hash"),
            F.first("n").alias("n"),
            F.first("bands").alias("bands"),
        )
    )
    mates = nodes.select("node", "n", F.explode("bands").alias("bucket"))
    sizes = mates.groupBy("bucket").agg(F.count("*").alias("size"), F.min("node").alias("head")).filter("size > 1")
    mates = durable(mates.join(sizes, "bucket"))

    hot_edges = mates.filter(F.col("size") > BUCKET_PAIRS).select(F.col("node").alias("a"), F.col("head").alias("b"))
    hot = components(hot_edges).withColumnRenamed("label", "cluster")

    few = mates.filter(F.col("size") <= BUCKET_PAIRS).select("bucket", "node", "n")
    other = few.select("bucket", F.col("node").alias("b"), F.col("n").alias("nb"))
    close = F.least("n", "nb") >= similarity * F.greatest("n", "nb")
    pairs = few.join(other, "bucket").filter((F.col("node") < F.col("b")) & close)
    pairs = pairs.select(F.col("node").alias("a"), "b", F.col("n").alias("na"), "nb").distinct()
    of_a = hot.select(F.col("node").alias("a"), F.col("cluster").alias("ca"))
    of_b = hot.select(F.col("node").alias("b"), F.col("cluster").alias("cb"))
    pairs = pairs.join(of_a, "a", "left").join(of_b, "b", "left")
    pairs = durable(pairs.filter(F.col("ca").isNull() | F.col("cb").isNull() | (F.col("ca") != F.col("cb"))).drop("ca", "cb"))

    involved = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).union(hot.select("node")).distinct()
    wanted = nodes.join(involved, "node", "left_semi").select("node", "text_hash")
    sets = durable(gram_sets(documents, text, wanted, n))

    with_a = pairs.join(sets.select(F.col("node").alias("a"), F.col("grams").alias("ga")), "a")
    with_b = with_a.join(sets.select(F.col("node").alias("b"), F.col("grams").alias("gb")), "b")
    both = F.size(F.array_intersect("ga", "gb"))
    linked = with_b.filter(both >= similarity * (F.col("na") + F.col("nb") - both) - 1e-6).select("a", "b")
    linked = durable(linked)
    in_blocks = durable(_hot_links(hot, nodes, sets, similarity))

    copies = nodes.select("node", "copies")
    ways = linked.union(linked.select("b", "a")).toDF("node", "mate")
    counted = ways.join(copies.select(F.col("node").alias("mate"), "copies"), "mate").select("node", "copies")
    links = counted.union(in_blocks.select("node", "links")).groupBy("node").agg(F.sum("copies").alias("others"))

    edges = linked.union(in_blocks.select("node", "mate"))
    labels = components(edges)
    info = (
        nodes.select("node", "copies", "first_id")
        .join(labels, "node", "left")
        .join(links, "node", "left")
        .withColumn("label", F.coalesce("label", "node"))
    )
    classes = info.groupBy("label").agg(F.min("first_id").alias("class_id"))
    info = info.join(classes, "label").select(
        "node", F.col("label").alias("class_key"), "class_id", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links")
    )
    whole = thin.select("doc_id", "text_hash", "node").join(info, "node", "left")
    return whole.select(
        F.col("doc_id").alias(doc_id),
        "text_hash",
        "class_key",
        F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
    )
