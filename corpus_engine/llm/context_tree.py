"""Language-model scoring by context-tree weighting.

Bytes are decomposed into eight binary decisions. Each decision has a tree of
contexts, the bytes before it from none to ``DEPTH``. A node's counts give a
Krichevsky-Trofimov estimate; a node's weight against its deeper nodes follows from
how well either explains the training bytes, so all depths are mixed.

All counts stay a table. Contexts that end in the same three bytes lie in one part of
the tree; the depths above all parts have at most 2**16 contexts each. So each part is
built, and asked for the symbols to score, in one task.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpus_engine.llm.common import bound_batches, field, fresh, per_row, text_blocks
from corpus_engine.runtime import durable

DEPTH = 6
END = b"\n"
WHITE = re.compile("[ \t\n\x0b\x0c\r]")
#: What makes up at least this share of the training tokens or bytes is broadcast, at
#: most 2**24 entries; all else is joined. The scores are the same.
SHARE = 1 << 24
#: Depths above all parts of the tree, and rows of whole parts that are built at once.
TOP = 3
PART_ROWS = 200_000
#: Characters or bytes that are split or coded at once, also of a single text.
PIECE = 1_000_000
#: Counts whose log-gamma values are tabulated.
TABLE = 4096


def word_pieces(text: str | None) -> Iterator[list[bytes]]:
    """Words between ASCII white space, with A-Z lower-cased, of pieces cut at white space."""
    text, start = text or "", 0
    while start < len(text):
        cut = WHITE.search(text, start + PIECE)
        end = cut.start() if cut else len(text)
        yield text[start:end].encode().lower().split()
        start = end


def tokens(text: str | None) -> list[bytes]:
    """All words of a text."""
    return [word for piece in word_pieces(text) for word in piece]


def coded(text: str | None, words: Counter) -> bytes:
    """The bytes that are coded: words joined by single spaces, then the end. Adds the words to ``words``."""
    parts = []
    for piece in word_pieces(text):
        words.update(piece)
        if piece:
            parts.append(b" ".join(piece))
    return b" ".join(parts) + END


def code_blocks(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Codes of DEPTH context bytes and a symbol for each byte, with the number of its text, block by block.

    Every text starts after END, whatever text stands before it.
    """
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    begins, n = np.cumsum(lengths) - lengths, int(lengths.sum())
    data = np.frombuffer(END * DEPTH + b"".join(texts), dtype=np.uint8)
    ends = int.from_bytes(END * (DEPTH + 1), "big")
    for lo in range(0, n, PIECE):
        hi = min(n, lo + PIECE)
        codes = np.zeros(hi - lo, dtype=np.uint64)
        for k in range(DEPTH + 1):
            codes <<= np.uint64(8)
            codes |= data[lo + k : hi + k]
        inside = np.searchsorted(begins, lo, side="right") - 1
        first, last = np.searchsorted(begins, [lo - DEPTH + 1, hi])
        for offset in range(DEPTH):
            at = begins[first:last][lengths[first:last] > offset] + offset - lo
            at = at[(at >= 0) & (at < hi - lo)]
            own = (1 << (8 * (offset + 1))) - 1
            codes[at] = (codes[at] & np.uint64(own)) | np.uint64(ends & ~own)
        own = np.minimum(begins[inside:last] + lengths[inside:last], hi) - np.maximum(begins[inside:last], lo)
        yield codes, np.repeat(np.arange(inside, last), own)


def word_hash(word: bytes) -> int:
    h = xxhash.xxh3_64_intdigest(word)
    return h - (1 << 64) if h >> 63 else h


def corpus_counts(texts: DataFrame) -> DataFrame:
    """``kind, code, count`` of a column ``t``: 0 byte contexts, 1 token hashes, 2 documents.

    Counts are gathered within a task and handed on whenever they fill a bounded table.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def grams_out(parts):
            code = np.concatenate([c for c, _ in parts])
            count = np.concatenate([n for _, n in parts])
            order = np.argsort(code)
            code, count = code[order], count[order]
            new = run_starts(code)
            return code[new], np.add.reduceat(count, new)

        def frame(kind, code, count):
            return pd.DataFrame({"kind": kind, "code": np.asarray(code, dtype=np.int64), "count": count})

        words, codes, grams, documents = Counter(), [], [], 0
        for batch in batches:
            for _, block in text_blocks(batch["t"].tolist(), PIECE):
                documents += len(block)
                for own, _ in code_blocks([coded(t, words) for t in block]):
                    codes.append(own)
                    if sum(map(len, codes)) >= 6 * PIECE:
                        grams.append(np.unique(np.concatenate(codes), return_counts=True))
                        codes = []
                    if sum(len(c) for c, _ in grams) > 3_000_000:
                        yield frame(0, *grams_out(grams))
                        grams = []
                if len(words) > 400_000:
                    yield frame(1, [word_hash(w) for w in words], list(words.values()))
                    words = Counter()
        if codes:
            grams.append(np.unique(np.concatenate(codes), return_counts=True))
        if grams:
            yield frame(0, *grams_out(grams))
        if words:
            yield frame(1, [word_hash(w) for w in words], list(words.values()))
        yield frame(2, [0], [documents])

    bound_batches(texts.sparkSession)
    # tasks hand on what they have combined: to combine again before the shuffle gains nothing
    counted = texts.mapInPandas(run, "kind int, code long, count long").repartition("kind", "code")
    return counted.groupBy("kind", "code").agg(F.sum("count").alias("count"))


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after shifting the argument up."""
    shift = np.zeros_like(x)
    y = x.copy()
    for _ in range(8):
        small = y < 8
        shift = np.where(small, shift + np.log(np.where(small, y, 1)), shift)
        y = np.where(small, y + 1, y)
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


HALF, WHOLE = (log_gamma(np.arange(TABLE) + shift) for shift in (0.5, 1.0))


def _gamma_of(counts: np.ndarray, table: np.ndarray, shift: float) -> np.ndarray:
    """``log_gamma(counts + shift)``, from the table where it reaches."""
    small = counts < TABLE
    value = table[np.where(small, counts, 0).astype(np.int64)]
    if not small.all():
        value[~small] = log_gamma(counts[~small] + shift)
    return value


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log probability that a Krichevsky-Trofimov estimator gives to such counts."""
    return _gamma_of(zeros, HALF, 0.5) + _gamma_of(ones, HALF, 0.5) - _gamma_of(zeros + ones, WHOLE, 1.0) - 2 * HALF[0]


def run_starts(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.zeros(0, dtype=np.int64)


@dataclass
class ContextTree:
    """Per depth: sorted node keys (context, decision), estimates of a one, and weights of stopping there."""

    keys: list[np.ndarray]
    ones: list[np.ndarray]
    stop: list[np.ndarray]

    @staticmethod
    def nodes(context: np.ndarray, symbol: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted keys of the decisions of such entries, with their zeros and ones.

        Entries of one context stand together, their symbols in order.
        """
        keys, zero, one = [], [], []
        for bit in range(8 if len(context) else 0):
            key = context * 256 + ((np.int64(1) << bit) | (symbol >> (8 - bit)))
            new = run_starts(key)
            ones = np.add.reduceat(np.where((symbol >> (7 - bit)) & 1, count, 0), new)
            keys.append(key[new])
            one.append(ones.astype(float))
            zero.append((np.add.reduceat(count, new) - ones).astype(float))
        if not keys:
            return np.zeros(0, dtype=np.int64), np.zeros(0), np.zeros(0)
        key = np.concatenate(keys)
        order = np.argsort(key, kind="stable")
        return key[order], np.concatenate(zero)[order], np.concatenate(one)[order]

    @staticmethod
    def above(key: np.ndarray, depth: int, *values: np.ndarray) -> tuple[np.ndarray, ...]:
        """Sums of the nodes' values for each node of ``depth``, one above theirs."""
        parent = ((key >> 8) & ((1 << (8 * depth)) - 1)) * 256 + (key & 255)
        parent, inverse = np.unique(parent, return_inverse=True)
        return parent, *(np.bincount(inverse, v, len(parent)) for v in values)

    @classmethod
    def part(cls, codes: np.ndarray, counts: np.ndarray) -> tuple[ContextTree, tuple[np.ndarray, ...]]:
        """The depths from TOP of whole parts, and what the depth above needs: key, weight, zeros, ones."""
        key, zero, one = cls.nodes(codes >> 8, codes & 255, counts)
        own = log_kt(zero, one)
        tree = cls([key], [(one + 0.5) / (zero + one + 1)], [np.ones(len(key))])
        sums = cls.above(key, DEPTH - 1, own, zero, one)
        for d in reversed(range(TOP, DEPTH)):
            sums = tree.cover(sums, d)
        return tree, sums

    def cover(self, sums: tuple[np.ndarray, ...], depth: int) -> tuple[np.ndarray, ...]:
        """Put ``depth`` on top, given its deeper nodes' sums; gives the sums for the depth above."""
        key, deeper, zero, one = sums
        own = log_kt(zero, one)
        weighted = np.logaddexp(own, deeper) + np.log(0.5)
        self.keys.insert(0, key)
        self.ones.insert(0, (one + 0.5) / (zero + one + 1))
        self.stop.insert(0, np.exp(np.minimum(own + np.log(0.5) - weighted, 0)))
        return self.above(key, depth - 1, weighted, zero, one) if depth else sums

    def log_probability(self, codes: np.ndarray) -> np.ndarray:
        """Natural log probability of each code's symbol after its context.

        Codes that share a decision and stand together are looked up once.
        """
        total = np.zeros(len(codes))
        for bit in range(8):
            decision = codes >> (8 - bit) if bit else codes >> 8
            new = run_starts(decision)
            p = self.estimate(codes[new], bit)
            p = np.repeat(p, np.diff(np.append(new, len(codes))))
            total += np.log(np.where((codes >> (7 - bit)) & 1, p, 1 - p))
        return total

    def estimate(self, codes: np.ndarray, bit: int) -> np.ndarray:
        """Probability that this bit of each code's symbol is a one, mixed over the depths."""
        node = (1 << bit) | ((codes & 255) >> (8 - bit))
        estimate, alive = np.full(len(codes), 0.5), np.ones(len(codes), dtype=bool)
        ahead, mixed = np.ones(len(codes)), np.zeros(len(codes))
        for d, keys in enumerate(self.keys):
            if not len(keys):
                break
            key = ((codes >> 8) & ((1 << (8 * d)) - 1)) * 256 + node
            at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            alive &= keys[at] == key
            # beyond the last known depth the last estimate stands
            stop = np.where(alive, self.stop[d][at], 0.0)
            estimate = np.where(alive, self.ones[d][at], estimate)
            mixed += ahead * stop * estimate
            ahead *= 1 - stop
        return mixed + ahead * estimate


def fetched(rows: DataFrame) -> list[np.ndarray]:
    """The columns of a small table, in the order of the first; they come as Arrow batches, never as row objects."""
    table = rows.toArrow()
    columns = [c.to_numpy() for c in table.columns]
    order = np.argsort(columns[0])
    return [c[order] for c in columns]


def tree_top(grams: DataFrame) -> ContextTree:
    """Depths 0 to TOP - 1 of the tree of ``code, count``: at most 2**16 contexts of 255 nodes a depth."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in whole_parts(batches):
            _, sums = ContextTree.part(rows["code"].to_numpy(), rows["count"].to_numpy())
            yield pd.DataFrame(dict(zip(("node", "weight", "zero", "one"), sums)))

    sums = by_part(grams).mapInPandas(run, "node long, weight double, zero double, one double")
    sums = sums.groupBy("node").agg(*(F.sum(c).alias(c) for c in ("weight", "zero", "one")))
    tree, left = ContextTree([], [], []), tuple(fetched(sums))
    for d in reversed(range(TOP)):
        left = tree.cover(left, d)
    return tree


def by_part(rows: DataFrame) -> DataFrame:
    """Rows with a ``code``, part after part of the tree."""
    part = F.shiftright("code", 8).bitwiseAND((1 << (8 * TOP)) - 1)
    return rows.withColumn("part", part).repartition("part").sortWithinPartitions("part", "code")


def whole_parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Join batches and cut them between parts; a part is never cut."""
    held, size = [], 0
    for batch in batches:
        part = batch["part"].to_numpy()
        new = np.flatnonzero(part[1:] != part[:-1]) + 1
        for lo, hi in zip(np.insert(new, 0, 0), np.append(new, len(part))):
            if size >= PART_ROWS and held[-1]["part"].iloc[-1] != part[lo]:
                yield pd.concat(held, ignore_index=True)
                held, size = [], 0
            if hi > lo:
                held.append(batch.iloc[lo:hi])
                size += hi - lo
    if held:
        yield pd.concat(held, ignore_index=True)


def symbol_scores(grams: DataFrame, wanted: DataFrame, top: Broadcast) -> DataFrame:
    """``code, value``: natural log probability of each code in ``wanted`` under the tree of ``grams``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in whole_parts(batches):
            codes, counts = rows["code"].to_numpy(), rows["count"].to_numpy()
            deep, _ = ContextTree.part(codes[counts > 0], counts[counts > 0])
            over = top.value
            tree = ContextTree(over.keys + deep.keys, over.ones + deep.ones, over.stop + deep.stop)
            asked = codes[counts == 0]
            yield pd.DataFrame({"code": asked, "value": tree.log_probability(asked)})

    rows = grams.select("code", "count").unionByName(wanted.select("code", F.lit(0).cast("long").alias("count")))
    return by_part(rows).mapInPandas(run, "code long, value double")


class TreeScorer:
    """Symbol values from a sorted table; a direct-mapped table remembers where they stand."""

    def __init__(self, codes: np.ndarray, values: np.ndarray, bits: int = 21):
        self.known, self.found, self.shift = codes, values, np.uint64(64 - bits)
        # a code stands beside its value; no code is this large
        self.seen = np.empty((1 << bits, 2))
        self.seen[:, 0].view(np.uint64)[:] = 2**64 - 1

    def _slot(self, codes: np.ndarray) -> np.ndarray:
        return (codes * np.uint64(0x9E3779B97F4A7C15)) >> self.shift

    def values_of(self, codes: np.ndarray) -> np.ndarray:
        """Values of the codes, NaN where the table has none."""
        seen = self.seen.take(self._slot(codes), axis=0)
        value = seen[:, 1].copy()
        missing = seen[:, 0].view(np.uint64) != codes
        if missing.any():
            new, inverse = np.unique(codes[missing], return_inverse=True)
            at = np.minimum(np.searchsorted(self.known, new), max(len(self.known) - 1, 0))
            fresh_values = np.full(len(new), np.nan)
            if len(self.known):
                fresh_values = np.where(self.known[at] == new, self.found[at], np.nan)
            value[missing] = fresh_values[inverse]
            slot = self._slot(new)
            self.seen[slot] = np.stack([new.view(float), fresh_values], axis=1)
        return value

    def scores(self, texts: list[bytes]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
        """Natural log probabilities of the known symbols of each text; its other codes, and how often they stand."""
        total, rest = np.zeros(len(texts)), []
        for codes, owner in code_blocks(texts):
            value = self.values_of(codes)
            other = np.flatnonzero(np.isnan(value))
            value[other] = 0
            total += np.bincount(owner, value, len(texts))
            code, own = codes[other].view(np.int64), owner[other]
            order = np.lexsort((code, own))
            code, own = code[order], own[order]
            new = np.union1d(run_starts(code), run_starts(own))
            rest.append((own[new], code[new], np.diff(np.append(new, len(code)))))
        own, code, times = (np.concatenate(x) for x in zip(*rest))
        cuts = np.searchsorted(own, np.arange(1, len(texts)))
        return total, np.split(code, cuts), np.split(times, cuts)


@dataclass
class LanguageModel:
    """Tables of all counts of byte contexts and of the rarer tokens; what is frequent or small stands in memory.

    ``codes`` are the frequent symbols in their contexts, ``values`` their log probabilities.
    """

    grams: DataFrame
    top: Broadcast
    codes: np.ndarray
    values: np.ndarray
    hashes: np.ndarray
    counts: np.ndarray
    total: int
    distinct: int
    rare: DataFrame | None = None


def fit(documents: DataFrame, usable: Column, text: str = "text") -> LanguageModel:
    """Count all usable texts; null texts are empty ones.

    Counts of byte contexts and of tokens come from every training byte, and all of
    them count. Symbols and tokens more frequent than a share of 2**-24 are kept in
    memory, at most that many, and the others stay a table.
    """
    texts = documents.filter(usable).select(F.coalesce(field(text), F.lit("")).alias("t"))
    counted = durable(corpus_counts(texts))
    grams, words = counted.filter("kind = 0"), counted.filter("kind = 1")
    size = grams.agg(F.sum("count")).first()[0] or 0
    known = words.agg(F.sum("count"), F.count("*")).first()
    ends = counted.filter("kind = 2").agg(F.sum("count")).first()[0] or 0
    total, distinct = (known[0] or 0) + ends, known[1] + (ends > 0)

    grams = grams.select("code", "count")
    top = documents.sparkSession.sparkContext.broadcast(tree_top(grams))
    codes, values = fetched(symbol_scores(grams, grams.filter(F.col("count") * SHARE >= size), top))
    codes = codes.astype(np.uint64)
    hashes, counts = fetched(words.filter(F.col("count") * SHARE >= total).select("code", "count"))
    rare = words.filter(F.col("count") * SHARE < total).select(F.col("code").alias("word"), F.col("count").alias("c"))
    end_hash = np.int64(word_hash(END))
    at = np.searchsorted(hashes, end_hash)
    hashes, counts = np.insert(hashes, at, end_hash), np.insert(counts, at, ends)
    return LanguageModel(grams, top, codes, values, hashes, counts, total, distinct, rare)


def _score_batch(codes, values, hashes, counts):
    def make():
        scorer = TreeScorer(codes.value, values.value)
        frequent = dict(zip(hashes.value.tolist(), counts.value.tolist()))
        seen: dict[bytes, tuple[int, int, float]] = {}

        def run(texts):
            nonlocal seen
            out = []
            for _, block in text_blocks(texts, PIECE):
                if len(seen) > 200_000:
                    seen = {}
                words = [Counter() for _ in block]
                data = [coded(*pair) for pair in zip(block, words)]
                for size, found, score, grams, gram_times in zip(map(len, data), words, *scorer.scores(data)):
                    found[END] = 1
                    known, base, other, times = 0, 0.0, [], []
                    for word, n in found.items():
                        entry = seen.get(word)
                        if entry is None:
                            h = word_hash(word)
                            c = frequent.get(h, -1)
                            entry = seen[word] = (h, c, math.log10(c + 1) if c > 0 else 0.0)
                        if entry[1] < 0:
                            other.append(entry[0])
                            times.append(n)
                        elif entry[1] > 0:
                            known += n
                            base += n * entry[2]
                    out.append((sum(found.values()), size, known, base, score, other, times, grams, gram_times))
            columns = ["n_tokens", "size", "known", "base", "score", "words", "times", "grams", "gram_times"]
            return pd.DataFrame(out, columns=columns)

        return run

    return make


def score_texts(df: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """Replace the text by n_tokens, n_known, train_tokens, base_score, score and bits_per_byte.

    A null text is empty: one token, its end. The model scores the lower-cased tokens
    joined by single spaces, then the end; bits_per_byte is per byte coded so. Repeated rows stay; other columns pass
    through, and one named like a result is replaced. The text is left out because
    the rows are written once before the values of rare symbols and tokens are joined.
    """
    context = df.sparkSession.sparkContext
    results = ("n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")
    made, row, mine, rare = (fresh(df, c) for c in ("made", "row", "mine", "rare"))
    keep = [field(c) for c in df.columns if c not in (*results, text)]
    # bounded by SHARE, whatever the corpus
    shared = [context.broadcast(x) for x in (model.codes, model.values, model.hashes, model.counts)]
    schema = "n_tokens long, size long, known long, base double, score double, words array<long>, times array<long>"
    schema += ", grams array<long>, gram_times array<long>"
    scored = df.withColumn(made, per_row(_score_batch(*shared), schema, field(text)))
    scored = durable(scored.select(*keep, field(made), F.monotonically_increasing_id().alias(row)))

    own, rest = field(made), field(mine)
    zipped = F.arrays_zip(own["words"].alias("word"), own["times"].alias("times"))
    pairs = scored.select(field(row).alias("row"), F.explode(zipped).alias("p")).select("row", "p.word", "p.times")
    sums = (
        pairs.join(model.rare, "word")
        .groupBy("row")
        .agg(F.sum("times").alias("known"), F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("base"))
    )
    sums = sums.select(F.col("row").alias(row), F.struct("known", "base").alias(mine))

    zipped = F.arrays_zip(own["grams"].alias("code"), own["gram_times"].alias("times"))
    pairs = scored.select(field(row).alias("row"), F.explode(zipped).alias("p")).select("row", "p.code", "p.times")
    found = symbol_scores(model.grams, pairs.select("code").distinct(), model.top)
    logs = pairs.join(found, "code").groupBy("row").agg(F.sum(F.col("times") * F.col("value")).alias("value"))
    logs = logs.select(F.col("row").alias(row), F.col("value").alias(rare))

    score = (own["score"] + F.coalesce(field(rare), F.lit(0.0))) / F.log(F.lit(10.0))
    per_token = F.log10(F.lit(float(model.total + model.distinct + 1)))
    return scored.join(sums, row, "left").join(logs, row, "left").select(
        *keep,
        own["n_tokens"].alias("n_tokens"),
        (own["known"] + F.coalesce(rest["known"], F.lit(0))).alias("n_known"),
        F.lit(model.total).cast("long").alias("train_tokens"),
        (own["base"] + F.coalesce(rest["base"], F.lit(0.0)) - own["n_tokens"] * per_token).alias("base_score"),
        score.alias("score"),
        (-score / F.log10(F.lit(2.0)) / own["size"]).alias("bits_per_byte"),
    )
