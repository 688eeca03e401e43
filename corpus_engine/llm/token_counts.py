"""Token counts by overlap resynchronisation.

A text of ordinary length is encoded in one call. A huge one is cut into windows
that overlap, each window is a row of its own and is encoded with offsets
wherever Spark puts it, and neighbours are spliced inside their overlap.

The splice is proven, not guessed: byte-pair merges only ever build pieces of the
vocabulary, so nothing merges across two adjacent characters that stand side by
side in no piece. Such a place is stable whatever surrounds it. An overlap without
a stable place is widened until it has one, at worst to the end of the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpus_engine.llm.common import field, fresh, per_row

SPACE = "▁"
CANDIDATES = 32


class PieceEncoder:
    """A piece model and its stable places."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = (self.model.id_to_piece(i) for i in range(self.model.get_piece_size()))
        self.joined = {p[i : i + 2] for p in pieces for i in range(len(p) - 1)}

    def counts(self, texts: list[str]) -> list[int]:
        return [len(ids) for ids in self.model.encode(texts, num_threads=1)]

    def stable(self, text: str, lo: int, hi: int) -> list[int]:
        """The first stable places p with lo < p < hi: no piece joins text[p-1] and text[p]."""
        found = []
        for p in range(lo + 1, hi):
            pair = text[p - 1 : p + 1].replace(" ", SPACE)
            if pair not in self.joined:
                found.append(p)
                if len(found) == CANDIDATES:
                    break
        return found

    def windows(self, text: str, size: int, overlap: int) -> Iterator[tuple[int, int, list[int]]]:
        """(begin, end, stable places shared with the window before)."""
        begin, shared = 0, []
        while True:
            end, width = min(begin + size, len(text)), overlap
            while end < len(text):
                lo = max(end - width, begin + 1)
                places = self.stable(text, lo, end)
                if places:
                    break
                # alignment would fail here: look further back, then further ahead
                if lo > begin + size // 2:
                    width *= 2
                else:
                    end = min(end + size, len(text))
                    width = end - begin - size // 2
            yield begin, end, shared
            if end == len(text):
                return
            begin, shared = lo, places

    def before(self, text: str, places: list[int]) -> list[tuple[int, int]]:
        """(place, tokens before it) of the places that are token boundaries; then (len, all)."""
        pieces = self.model.encode(text, return_type="proto").pieces
        begins = np.array([p.begin for p in pieces], dtype=np.int64)
        ends = np.array([p.end for p in pieces], dtype=np.int64)
        out, at, offset = [], 0, 0
        for place in places:
            offset += len(text[at:place].encode())
            at = place
            n = int(np.searchsorted(begins, offset))
            if n == 0 or ends[n - 1] <= offset:
                out.append((place, n))
        return [*out, (len(text), len(pieces))]


def _cut(model, size: int, overlap: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = PieceEncoder(model.value)
        for batch in batches:
            for key, text in zip(batch["key"], batch["text"]):
                rows, held = [], None
                for begin, end, shared in encoder.windows(text, size, overlap):
                    if held:
                        held["tail"] = shared
                        rows.append(held)
                    held = {"key": key, "k": begin, "text": text[begin:end], "head": shared, "tail": []}
                    if len(rows) == 64:
                        yield pd.DataFrame(rows)
                        rows = []
                yield pd.DataFrame([*rows, held])

    return run


def _encode(model):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = PieceEncoder(model.value)
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                places = sorted({p - row.k for p in (*row.head, *row.tail)})
                *found, (_, n) = encoder.before(row.text, places)
                before = {p + row.k: b for p, b in found}
                out.append(
                    {
                        "key": row.key,
                        "k": row.k,
                        "n": n,
                        "head": {p: before[p] for p in row.head if p in before},
                        "tail": {p: before[p] for p in row.tail if p in before},
                    }
                )
            yield pd.DataFrame(out, columns=["key", "k", "n", "head", "tail"])

    return run


def huge_counts(texts: DataFrame, model, size: int, overlap: int) -> DataFrame:
    """``key, n_tokens`` of distinct huge texts (``key, text``), window by window."""
    places = "array<long>"
    windows = texts.mapInPandas(
        _cut(model, size, overlap), f"key string, k long, text string, head {places}, tail {places}"
    )
    parts = texts.sparkSession.conf.get("spark.sql.shuffle.partitions")
    encoded = windows.repartition(int(parts), "key", "k").mapInPandas(
        _encode(model), "key string, k long, n long, head map<long,long>, tail map<long,long>"
    )
    order = Window.partitionBy("key").orderBy("k")
    common = F.array_min(F.array_intersect(F.map_keys("tail"), F.map_keys("next_head")))
    spliced = (
        encoded.withColumn("next_head", F.lead("head").over(order))
        .withColumn("place", common)
        .withColumn(
            "upto",
            F.when(F.col("next_head").isNull(), F.col("n"))
            .when(F.col("place").isNotNull(), F.element_at("tail", F.col("place")))
            .otherwise(F.raise_error(F.lit("two windows share no token boundary at a stable place")).cast("long")),
        )
        .withColumn("from", F.coalesce(F.element_at("next_head", F.col("place")), F.lit(0)))
    )
    return spliced.groupBy("key").agg(F.sum(F.col("upto") - F.col("from")).alias("n_tokens"))


def count_tokens(
    df: DataFrame,
    model_path: str,
    text: str = "text",
    n_bytes: str = "n_bytes",
    n_tokens: str = "n_tokens",
    window_chars: int = 65_536,
    overlap_chars: int = 256,
) -> DataFrame:
    """Add the UTF-8 length and the token count of every whole text.

    A null text counts as empty; empty texts have no tokens; repeated rows stay and
    get the same counts; other columns pass through, but a column named like a
    result is replaced. Texts longer than ``window_chars`` take the windowed path;
    equal huge texts are encoded once.
    """
    spark = df.sparkSession
    with open(model_path, "rb") as file:  # a fixed public vocabulary, half a megabyte
        model = spark.sparkContext.broadcast(file.read())

    def make():
        encoder = PieceEncoder(model.value)

        def run(texts):
            return pd.DataFrame({"n": encoder.counts([t or "" for t in texts])})

        return run

    bytes_of = F.octet_length(F.coalesce(field(text), F.lit(""))).cast("long")
    length = F.length(F.coalesce(field(text), F.lit("")))
    made, key = fresh(df, "made"), fresh(df, "text_key")
    keep = [c for c in df.columns if c not in (n_bytes, n_tokens)]
    out = [*[field(c) for c in keep], bytes_of.alias(n_bytes)] if text in keep else None
    if out is None:
        raise ValueError("a result column would replace the text")

    short = df.filter(length <= window_chars).withColumn(made, per_row(make, "n long", field(text)))
    short = short.select(*out, field(made)["n"].alias(n_tokens))

    long = df.filter(length > window_chars).withColumn(key, F.sha2(field(text), 256))
    texts = long.select(field(key).alias("key"), field(text).alias("text")).dropDuplicates(["key"])
    counts = huge_counts(texts, model, window_chars, overlap_chars)
    counts = counts.select(F.col("key").alias(key), F.col("n_tokens").alias(made))
    long = long.join(counts, key).select(*out, field(made).alias(n_tokens))
    return short.unionByName(long)
