"""Removal of every byte that an earlier 100-byte string already holds.

Matches are found in shards. Windows of 100 bytes that share their smallest hashed
substring of ``k`` bytes lie in one group, so equal windows always meet. Runs of
windows with equal bytes are collapsed to their first place before and after the
shuffle; groups that still hold different runs are split once more by a longer
substring and then decided by the suffix arrays of their shard.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpus_engine.llm.common import bound_batches, field, fresh, per_row, tidy
from corpus_engine.llm.suffix_array import repeated_windows
from corpus_engine.runtime import durable

LENGTH = 100
COARSE, FINE = 32, 80
RUN = 255
SLICE = 1 << 20
SHARD = 1 << 19
#: Groups of more runs are split by whole windows, which needs no suffix array.
GROUP = 2_000
NO_ID = -(1 << 63)
PLACE = ["doc", "tie", "start"]

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """64-bit hashes of all substrings of a buffer from one prefix sum; products wrap around."""

    letters = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def __init__(self):
        self.powers = self.backs = np.ones(1, dtype=np.uint64)

    def prefix(self, data: np.ndarray) -> np.ndarray:
        if len(self.powers) <= len(data):
            n = len(data) + 1
            self.powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _BASE)]))
            self.backs = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _BACK)]))
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(self.letters[data] * self.powers[: len(data)], out=sums[1:])
        return sums

    def all_of(self, sums: np.ndarray, k: int) -> np.ndarray:
        """Hashes of the substrings of ``k`` bytes at every start."""
        n = len(sums) - k
        return _mix((sums[k:] - sums[:n]) * self.backs[:n])

    def some(self, sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return _mix((sums[ends] - sums[starts]) * self.backs[starts] + (ends - starts).astype(np.uint64))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        x, size = np.minimum(x[:-size], x[size:]), size * 2
    return x if size == width else np.minimum(x[: len(x) - (width - size)], x[width - size :])


def _repeating(rolling: Rolling, sums, hashes, key, start, count, length: int) -> np.ndarray:
    """Whether two windows of a run are equal.

    Equal windows hold their smallest substring at one offset, so it stands in such
    a run twice, without another window's smallest substring in between. Only runs
    over such places are compared window by window.
    """
    wide = len(hashes) - len(key) + 1
    # a substring is some window's smallest if it is the largest key around
    around = np.concatenate([np.zeros(wide - 1, np.uint64), key, np.zeros(wide - 1, np.uint64)])
    smallest = np.flatnonzero(~sliding_min(~around, wide) == hashes)
    twice = np.zeros(len(hashes) + 1, dtype=np.int64)
    twice[smallest[:-1][hashes[smallest[1:]] == hashes[smallest[:-1]]] + 1] = 1
    twice = np.cumsum(twice)
    near = np.flatnonzero((count > 1) & (twice[start + count + wide - 1] > twice[start]))
    inner = np.zeros(len(start), dtype=bool)
    if len(near):
        n = count[near]
        run = np.repeat(near, n)
        at = start[run] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        window = _mix((sums[at + length] - sums[at]) * rolling.backs[at])
        order = np.lexsort((window, run))
        run, window = run[order], window[order]
        inner[run[1:][(run[1:] == run[:-1]) & (window[1:] == window[:-1])]] = True
    return inner


def runs(rolling: Rolling, data: np.ndarray, inside: np.ndarray, k: int, length: int):
    """Runs of windows with one key: (start, windows, key, hash of the run's bytes, repeats within).

    A window's key is its smallest hash of ``k`` bytes. ``inside`` tells the starts
    of the windows that count.
    """
    sums = rolling.prefix(data)
    hashes = rolling.all_of(sums, k)
    key = sliding_min(hashes, length - k + 1)
    at = np.flatnonzero(inside[: len(key)])
    if not len(at):
        return at, at, key[:0], key[:0], inside[:0]
    new = np.concatenate([[True], (np.diff(at) != 1) | (key[at[1:]] != key[at[:-1]])])
    began = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
    new |= (np.arange(len(at)) - began) % RUN == 0
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(at)))
    start = at[first]
    inner = _repeating(rolling, sums, hashes, key, start, count, length)
    return start, count, key[start], rolling.some(sums, start, start + count + length - 1), inner


def _blocks(items: Iterator[tuple[int, int, bytes]], length: int):
    """Lay (owner, offset, bytes) end to end in blocks; gives owners, offsets, begins and data."""
    held, size = [], 0
    for item in items:
        held.append(item)
        size += len(item[2])
        if size >= SLICE:
            yield held
            held, size = [], 0
    if held:
        yield held


def _laid(items: list[tuple[int, int, bytes]], length: int):
    data = np.frombuffer(b"".join(x for _, _, x in items), dtype=np.uint8)
    sizes = np.array([len(x) for _, _, x in items])
    begins = np.cumsum(sizes) - sizes
    edge = np.zeros(len(data) + 1, dtype=np.int32)
    usable = sizes >= length
    edge[begins[usable]] += 1
    edge[(begins + sizes - length + 1)[usable]] -= 1
    return data, begins, np.cumsum(edge[:-1]) > 0


def _slices(owner: int, text: bytes, length: int) -> Iterator[tuple[int, int, bytes]]:
    for at in range(0, max(1, len(text) - length + 1), SLICE):
        yield owner, at, text[at : at + SLICE + length - 1]


_SCHEMA = "doc long, tie long, start long, n long, key long, body long, done boolean, inner boolean"


def coarse_runs(length: int, k: int):
    """Rows of a batch's runs; a run whose bytes an earlier run of the batch holds is done."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rolling = Rolling()
        for batch in batches:
            batch = batch.sort_values(["doc", "tie"], kind="stable").drop_duplicates(["doc", "tie"])
            texts = [t.encode() for t in batch["t"]]
            items = (piece for i, t in enumerate(texts) if len(t) >= length for piece in _slices(i, t, length))
            parts = []
            for block in _blocks(items, length):
                data, begins, inside = _laid(block, length)
                start, count, key, body, inner = runs(rolling, data, inside, k, length)
                owner = np.searchsorted(begins, start, side="right") - 1
                own = np.array([o for o, _, _ in block])[owner]
                offset = np.array([a for _, a, _ in block])[owner]
                parts.append((own, start - begins[owner] + offset, count, key, body, inner))
            if not parts:
                continue
            own, start, count, key, body, inner = (np.concatenate(x) for x in zip(*parts))
            _, first, inverse = np.unique(key ^ body * _BASE, return_index=True, return_inverse=True)
            first = first[inverse]
            done = (first < np.arange(len(key))) & (key[first] == key) & (body[first] == body)
            # neighbouring runs that are done become one
            follows = done[1:] & done[:-1] & (own[1:] == own[:-1]) & (start[1:] == start[:-1] + count[:-1])
            head = np.flatnonzero(np.concatenate([[True], ~follows]))
            total = np.add.reduceat(count, head)
            own, start, done, key, body, inner = (x[head] for x in (own, start, done, key, body, inner))
            place = _mix(own.astype(np.uint64) * _BASE + start.astype(np.uint64))
            yield pd.DataFrame(
                {
                    "doc": batch["doc"].to_numpy()[own],
                    "tie": batch["tie"].to_numpy()[own],
                    "start": start,
                    "n": total,
                    "key": np.where(done, place, key).astype(np.int64),
                    "body": body.astype(np.int64),
                    "done": done,
                    "inner": inner,
                }
            )

    return run


def settle(rows: DataFrame, *more: str) -> DataFrame:
    """Compare the runs of each key.

    Adds ``state``: done (an earlier run has its bytes), open (the key has other
    bytes too, or the run repeats itself), or null (nothing to compare with); and
    ``size``, the runs of the key.
    """
    by_key, by_body = Window.partitionBy("key"), Window.partitionBy("key", "body")
    # the wider window first: its shuffle serves both
    rows = rows.withColumn("mixed", F.min("body").over(by_key) < F.max("body").over(by_key))
    rows = rows.withColumn("size", F.count("*").over(by_key))
    # a row read twice is at one place, so it doesn't repeat itself
    rows = rows.withColumn("again", F.struct(*PLACE) > F.min(F.struct(*PLACE)).over(by_body))
    state = F.when(F.col("done") | F.col("again"), "done").when(F.col("mixed") | F.col("inner"), "open")
    return rows.select(*PLACE, "n", "key", *more, "size", state.alias("state")).filter("state is not null")


def fine_runs(length: int, k: int):
    """Runs by a longer substring, with their bytes, of the places in ``at`` of each text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rolling = Rolling()
        for batch in batches:
            items, docs, ties = [], batch["doc"].to_numpy(), batch["tie"].to_numpy()
            for i, (text, places) in enumerate(zip(batch["t"], batch["at"])):
                text = text.encode() if isinstance(text, str) else bytes(text)
                spans = sorted((p["start"], p["start"] + p["n"]) for p in places)
                joined: list[list[int]] = []
                for lo, hi in spans:
                    if joined and joined[-1][1] == lo:
                        joined[-1][1] = hi
                    else:
                        joined.append([lo, hi])
                for lo, hi in joined:
                    for _, at, piece in _slices(i, text[lo : hi + length - 1], length):
                        items.append((i, lo + at, piece))
            for block in _blocks(iter(items), length):
                data, begins, inside = _laid(block, length)
                start, count, key, body, inner = runs(rolling, data, inside, k, length)
                if not len(start):
                    continue
                owner = np.searchsorted(begins, start, side="right") - 1
                own = np.array([o for o, _, _ in block])[owner]
                offset = np.array([a for _, a, _ in block])[owner]
                raw = data.tobytes()
                yield pd.DataFrame(
                    {
                        "doc": docs[own],
                        "tie": ties[own],
                        "start": start - begins[owner] + offset,
                        "n": count,
                        "key": key.astype(np.int64),
                        "body": body.astype(np.int64),
                        "done": False,
                        "inner": inner,
                        "raw": [raw[a : a + c + length - 1] for a, c in zip(start.tolist(), count.tolist())],
                    }
                )

    return run


def shard_repeats(length: int):
    """Decide the windows of runs that arrive key after key, a shard of whole keys at a time."""

    def decide(shard: list[pd.DataFrame]) -> pd.DataFrame:
        rows = pd.concat(shard, ignore_index=True).sort_values(PLACE, kind="stable")
        n = rows["n"].to_numpy()
        index = np.repeat(np.arange(len(rows)), n)
        offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        start = rows["start"].to_numpy()[index] + offset
        order = np.lexsort((start, rows["tie"].to_numpy()[index], rows["doc"].to_numpy()[index]))
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order))
        found = np.concatenate(repeated_windows([bytes(r) for r in rows["raw"]], rank, length))
        index, start = index[found], start[found]
        return pd.DataFrame(
            {"doc": rows["doc"].to_numpy()[index], "tie": rows["tie"].to_numpy()[index], "start": start, "n": 1}
        )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for batch in batches:
            sizes = batch["raw"].map(len).to_numpy()
            keys = batch["key"].to_numpy()
            new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            for lo, hi in zip(new, np.append(new[1:], len(batch))):
                part = batch.iloc[lo:hi]
                if size > SHARD and held and held[-1]["key"].iloc[-1] != keys[lo]:
                    yield decide(held)
                    held, size = [], 0
                held.append(part)
                size += int(sizes[lo:hi].sum())
        if held:
            yield decide(held)

    return run


def repeated_spans(documents: DataFrame, doc_id: str, text: str, tie: str, length: int = LENGTH) -> DataFrame:
    """``doc, tie, start, n``: runs of window starts whose windows start earlier elsewhere."""
    spark = documents.sparkSession
    bound_batches(spark)
    texts = documents.filter(field(text).isNotNull()).select(
        F.coalesce(field(doc_id).cast("long"), F.lit(NO_ID)).alias("doc"), field(tie).alias("tie"), field(text).alias("t")
    )
    coarse = durable(settle(texts.mapInPandas(tidy(coarse_runs(length, COARSE)), _SCHEMA)).drop("key", "size"))
    done = coarse.filter("state = 'done'").select(*PLACE, "n")

    places = coarse.filter("state = 'open'").groupBy("doc", "tie").agg(F.collect_set(F.struct("start", "n")).alias("at"))
    fine = places.join(texts, ["doc", "tie"]).select("doc", "tie", "t", "at").dropDuplicates(["doc", "tie"])
    fine = settle(fine.mapInPandas(tidy(fine_runs(length, FINE)), f"{_SCHEMA}, raw binary"), "raw")
    fine = durable(fine)

    left = fine.filter("state = 'open'")
    shards = left.filter(F.col("size") <= GROUP).select(*PLACE, "n", "key", "raw")
    shards = shards.repartition("key").sortWithinPartitions("key")
    found = shards.mapInPandas(tidy(shard_repeats(length)), "doc long, tie long, start long, n long")

    windows = left.filter(F.col("size") > GROUP).select(
        "doc", "tie", "start", "raw", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("i")
    )
    windows = windows.select(
        F.struct("doc", "tie", (F.col("start") + F.col("i")).alias("start")).alias("place"),
        F.substring("raw", F.col("i").cast("int") + 1, F.lit(length)).alias("window"),
    )
    firsts = windows.groupBy("window").agg(F.min("place").alias("first"), F.count("*").alias("c")).filter("c > 1")
    large = windows.join(firsts, "window").filter("place > first").select("place.*", F.lit(1).cast("long").alias("n"))

    done_fine = fine.filter("state = 'done'").select(*PLACE, "n")
    return done.unionByName(done_fine).unionByName(found).unionByName(large)


def _cut(length: int):
    def make():
        def run(texts, starts, counts):
            out = []
            for text, start, count in zip(texts, starts, counts):
                if text is None or start is None:
                    out.append((None, None, None))
                    continue
                data = np.frombuffer(text.encode(), dtype=np.uint8)
                start, count = np.asarray(start), np.asarray(count)
                edge = np.zeros(len(data) + 1, dtype=np.int64)
                np.add.at(edge, start, 1)
                np.add.at(edge, start + count + length - 1, -1)
                gone = np.concatenate([[False], np.cumsum(edge[:-1]) > 0, [False]]).astype(np.int8)
                begins, ends = np.flatnonzero(np.diff(gone) == 1), np.flatnonzero(np.diff(gone) == -1)
                out.append((data[gone[1:-1] == 0].tobytes(), begins, ends))
            return pd.DataFrame(out, columns=["kept", "begins", "ends"])

        return run

    return make


def remove_repeats(
    documents: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    length: int = LENGTH,
    kept: str = "kept",
    removed: str = "removed",
) -> DataFrame:
    """Add the bytes that stay and the removed spans (array of ``begin, end``, in bytes of the input).

    A byte goes if it lies in a string of ``length`` bytes that also starts earlier:
    in a smaller doc_id, or earlier in the same document; overlaps count. Matches
    never cross documents. A null text stays empty. A null id comes before all
    others. Rows of one id are ordered by a hash of their text; repeated rows (same id
    and text) are one document and get one result. Other columns pass through; one
    named like a result is replaced.
    """
    doc, tie, spans, made = (fresh(documents, c) for c in ("doc", "tie", "spans", "made"))
    twice = documents.groupBy(field(doc_id).alias("id")).count().filter("count > 1")
    order = F.lit(0).cast("long") if twice.isEmpty() else F.xxhash64(field(text))
    marked = documents.withColumn(tie, order).withColumn(doc, F.coalesce(field(doc_id).cast("long"), F.lit(NO_ID)))

    found = repeated_spans(marked, doc_id, text, tie, length)
    found = found.groupBy(F.col("doc").alias(doc), F.col("tie").alias(tie)).agg(
        F.collect_list(F.struct("start", "n")).alias(spans)
    )
    joined = marked.join(found, [doc, tie], "left")
    touched = F.when(field(spans).isNotNull(), field(text))
    cut = per_row(
        _cut(length), "kept binary, begins array<long>, ends array<long>", touched, field(spans)["start"], field(spans)["n"]
    )
    keep = [field(c) for c in documents.columns if c not in (kept, removed)]
    whole = F.coalesce(field(text), F.lit("")).cast("binary")
    pairs = F.arrays_zip(field(made)["begins"].alias("begin"), field(made)["ends"].alias("end"))
    none = F.array().cast("array<struct<begin:bigint,end:bigint>>")
    return joined.withColumn(made, cut).select(
        *keep,
        F.coalesce(field(made)["kept"], whole).alias(kept),
        F.coalesce(pairs, none).alias(removed),
    )
