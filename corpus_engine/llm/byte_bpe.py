"""Byte-level byte-pair encoding and decoding.

Two tiers: a minimal perfect hash over the vocabulary resolves every pre-token
that is itself a vocabulary entry; the others are merged with a heap of ranked
pairs over a linked list of bytes.
"""

from __future__ import annotations

import base64
import heapq
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpus_engine.llm.common import field, fresh, per_row

_MIX, _MASK = 0x9E3779B97F4A7C15, (1 << 64) - 1


def read_ranks(path: str) -> dict[bytes, int]:
    """``base64 rank`` lines of a fixed public vocabulary."""
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}


def _slot(key: int, shift: int, n: int) -> int:
    x = (key ^ (shift * _MIX & _MASK)) * _MIX & _MASK
    x ^= x >> 29
    return ((x * _MIX & _MASK) >> 16) % n


def _slots(keys: np.ndarray, shifts: np.ndarray, n: int) -> np.ndarray:
    """As :func:`_slot`, for arrays; unsigned products wrap around."""
    mix = np.uint64(_MIX)
    x = (keys ^ (shifts.astype(np.uint64) * mix)) * mix
    x ^= x >> np.uint64(29)
    return (x * mix >> np.uint64(16)).astype(np.int64) % n


class PerfectHash:
    """A minimal perfect hash: n keys, n slots, one small number per bucket.

    A key's 64-bit hash picks a bucket. Buckets of several keys, the fullest first,
    search a displacement that sends all their keys to free slots; a bucket of one
    key then names one of the slots that are left.
    """

    def __init__(self, keys: list[bytes], values: list[int]):
        n = self.n = len(keys)
        self.buckets = max(1, 2 * n // 3)
        hashes = [xxhash.xxh3_64_intdigest(k) for k in keys]
        members: list[list[int]] = [[] for _ in range(self.buckets)]
        for i, h in enumerate(hashes):
            members[h % self.buckets].append(i)
        self.shift = np.zeros(self.buckets, dtype=np.int64)
        slots, taken, single = [0] * n, bytearray(n), []
        for b in sorted(range(self.buckets), key=lambda b: -len(members[b])):
            if len(members[b]) < 2:
                single += [b] * len(members[b])
                continue
            shift = 0
            while True:
                at = {_slot(hashes[i], shift, n): i for i in members[b]}
                if len(at) == len(members[b]) and not any(map(taken.__getitem__, at)):
                    break
                shift += 1
            for slot, i in at.items():
                taken[slot], slots[i] = 1, slot
            self.shift[b] = shift
        free = (slot for slot in range(n) if not taken[slot])
        for b, slot in zip(single, free):
            slots[members[b][0]], self.shift[b] = slot, -1 - slot
        self.keys: list[bytes] = [b""] * n
        self.values = np.zeros(n, dtype=np.int64)
        for i, slot in enumerate(slots):
            self.keys[slot], self.values[slot] = keys[i], values[i]

    def lookup(self, words: list[bytes]) -> np.ndarray:
        """The value of each word, -1 where it isn't a key."""
        if not words or not self.n:
            return np.full(len(words), -1, dtype=np.int64)
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
        shift = self.shift[(hashes % np.uint64(self.buckets)).astype(np.int64)]
        slots = np.where(shift < 0, -1 - shift, _slots(hashes, shift, self.n))
        keys, found = self.keys, self.values[slots]
        same = np.fromiter((keys[s] == w for s, w in zip(slots.tolist(), words)), dtype=bool, count=len(words))
        return np.where(same, found, -1)


def merge_bytes(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Merge the lowest-ranked adjacent pair, the leftmost on ties, until none is left.

    Every live symbol is an interval of ``word`` in a doubly linked list; a heap
    holds the pairs, and entries made stale by a merge are skipped.
    """
    n, rank = len(word), ranks.get
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    pop, push = heapq.heappop, heapq.heappush
    while heap:
        _, i, end = pop(heap)
        j = after[i]
        if not 0 < j < n or after[j] != end:
            continue
        after[j] = 0  # no longer the start of a symbol
        after[i] = end
        if end < n:
            before[end] = i
            if (r := rank(word[i : after[end]])) is not None:
                push(heap, (r, i, after[end]))
        if (h := before[i]) >= 0 and (r := rank(word[h:end])) is not None:
            push(heap, (r, h, end))
    return [ranks[word[i:j]] for i, j in enumerate(after) if j]


class ByteBpe:
    """Encoder and decoder of one vocabulary; remembers a bounded number of words.

    Half of them are words that came again. New words wait in two sets, of which the
    older is dropped when the younger is full, so words that come once push out no others.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str, whole: PerfectHash, remember: int = 300_000):
        self.ranks, self.find, self.whole = ranks, regex.compile(pattern), whole
        self.remember, self.known, self.young, self.old = remember, {}, {}, {}
        self.bytes_of = np.full(max(ranks.values(), default=-1) + 1, None, dtype=object)
        for word, i in ranks.items():
            self.bytes_of[i] = word

    def pieces(self, text: str, block: int = 1_000_000) -> Iterator[list[str]]:
        """The pattern's matches, a bounded number of characters at a time.

        A long text is cut before a single space between two characters that are no
        white space, where every match of the pattern ends; without such a place the
        block grows.
        """
        at = 0
        while at < len(text):
            end = at + block
            while end < len(text) and not (
                text[end] == " " and not text[end - 1].isspace() and not text[end + 1 : end + 2].isspace()
            ):
                end += 1
            yield self.find.findall(text[at:end])
            at = end

    def _learn(self, words: set[str]) -> dict[str, bytes]:
        """Ids of words that are not known yet; those that wait become known."""
        again = {w: waiting.pop(w) for waiting in (self.young, self.old) for w in words & waiting.keys()}
        names = list(words - again.keys())
        raw, new = [w.encode() for w in names], {}
        for name, word, found in zip(names, raw, self.whole.lookup(raw).tolist()):
            ids = [found] if found >= 0 else merge_bytes(word, self.ranks)
            new[name] = struct.pack(f"<{len(ids)}I", *ids)
        if len(self.known) + len(again) > self.remember // 2:
            self.known = {}
        if len(self.young) + len(new) > self.remember // 4:
            self.young, self.old = {}, self.young
        self.known |= again
        self.young |= new
        return again | new

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        out = []
        for pieces in self.pieces(text):
            ids = list(map(self.known.get, pieces))
            if None in ids:
                learned = self._learn({p for p, i in zip(pieces, ids) if i is None})
                ids = [learned[p] if i is None else i for p, i in zip(pieces, ids)]
            out.append(b"".join(ids))
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(self.bytes_of[np.frombuffer(ids, dtype="<u4")].tolist())


def unpack_ids(packed: Column) -> Column:
    """Packed ids as an array of integers."""
    digits = F.hex(packed)
    count = F.length(digits) / 8

    def one(i):
        part = F.substring(digits, i * 8 + 1, F.lit(8))
        return F.conv(
            F.concat(part.substr(7, 2), part.substr(5, 2), part.substr(3, 2), part.substr(1, 2)), 16, 10
        ).cast("int")

    return F.when(count > 0, F.transform(F.sequence(F.lit(0), count.cast("int") - 1), one)).otherwise(
        F.array().cast("array<int>")
    )


def _coder(df: DataFrame, path: str, pattern: str):
    ranks = read_ranks(path)
    # a fixed public vocabulary of a few megabytes
    shared = df.sparkSession.sparkContext.broadcast((ranks, PerfectHash(list(ranks), list(ranks.values()))))
    return lambda: ByteBpe(shared.value[0], pattern, shared.value[1])


def encode_texts(
    df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "token_ids", n_tokens: str = "n_tokens"
) -> DataFrame:
    """Add the packed ids (see :func:`unpack_ids`) and the token count of every whole text.

    A null text is encoded as the empty text, which has no ids. Repeated rows stay.
    Other columns pass through; one named like a result is replaced.
    """
    coder, made = _coder(df, path, pattern), fresh(df, "made")

    def make():
        bpe = coder()

        def run(texts):
            return pd.DataFrame({"ids": [bpe.encode(t or "") for t in texts]}, columns=["ids"])

        return run

    keep = [field(c) for c in df.columns if c not in (ids, n_tokens)]
    packed = field(made)["ids"]
    out = df.withColumn(made, per_row(make, "ids binary", field(text)))
    return out.select(*keep, packed.alias(ids), (F.octet_length(packed) / 4).cast("long").alias(n_tokens))


def decode_ids(
    df: DataFrame, path: str, pattern: str, ids: str = "token_ids", decoded: str = "decoded"
) -> DataFrame:
    """Add the bytes that packed ids stand for; null ids give no bytes."""
    coder, made = _coder(df, path, pattern), fresh(df, "made")

    def make():
        bpe = coder()

        def run(packed):
            return pd.DataFrame({"b": [bpe.decode(bytes(p or b"")) for p in packed]}, columns=["b"])

        return run

    keep = [field(c) for c in df.columns if c != decoded]
    return df.withColumn(made, per_row(make, "b binary", field(ids))).select(*keep, field(made)["b"].alias(decoded))
