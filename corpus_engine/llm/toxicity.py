"""Toxicity by a convolutional text classifier.

Each word is a sum of hashed embeddings (the word and its prefixes). Filters of
several widths slide over the words, the maximum of each filter over the text feeds
a logistic output. The network starts from a fit on a bounded, balanced sample and then
learns from every labelled row: learners go through a part of the rows each, and what
they changed is averaged. A threshold per language, guessed from the text alone, makes
0.5 the decision border; profiles and thresholds are counted over all rows too.
"""

from __future__ import annotations

import copy
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field as dataclass_field

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpus_engine.llm.common import bound_batches, field, fresh, give_back_driver, per_row, text_blocks, tidy
from corpus_engine.runtime import durable

EDGES = re.compile(r"^\W+|\W+$")
#: Texts of each class that a language's own threshold needs.
CALIBRATED = 20


@dataclass(frozen=True)
class Settings:
    """Sizes of the network, bounds of the sample it starts from, and rows of a learner."""

    slots: int = 1 << 17
    dims: int = 16
    widths: tuple[int, ...] = (1, 2, 3)
    filters: int = 8
    prefixes: tuple[int, ...] = (4, 5, 6, 7)
    rows_per_class: int = 3_000
    row_chars: int = 20_000
    epochs: int = 8
    batch: int = 32
    rate: float = 0.15
    language_slots: int = 1 << 14
    seed: int = 7
    learner_rows: int = 4_000
    learners: int = 64


class Words:
    """Ids of words, as they are first seen, and their hashed features."""

    def __init__(self, settings: Settings):
        self.s, self.ids, self.rows = settings, {}, []
        # a prefix of n characters is hashed as "n:prefix"; a checksum goes on from that of "n:"
        self.begun = [(n, zlib.crc32(f"{n}:".encode())) for n in settings.prefixes]

    def features(self, word: str) -> list[int]:
        word, slots, crc = word.lower(), self.s.slots, zlib.crc32
        if not (word[:1].isalnum() and word[-1:].isalnum()):
            word = EDGES.sub("", word)
        raw, size = word.encode(), len(word)
        row = [crc(raw) % slots]
        for n, begun in self.begun:
            if n <= size:
                row.append(crc(raw[:n] if len(raw) == size else word[:n].encode(), begun) % slots)
        return row + [slots] * (1 + len(self.begun) - len(row))

    def of(self, text: str) -> np.ndarray:
        """Word ids of a whole text; id 0 is the empty word, which pads short texts."""
        if not self.ids:
            self._add([""])
        words = text.split()
        ids = list(map(self.ids.get, words))
        if None in ids:
            self._add(dict.fromkeys(w for w, i in zip(words, ids) if i is None))
            ids = list(map(self.ids.__getitem__, words))
        pad = max(self.s.widths) - 1
        return np.array([*ids, *([0] * (pad + (not ids)))], dtype=np.int32)

    def _add(self, words) -> None:
        for word in words:
            self.ids[word] = len(self.ids)
            self.rows.append(self.features(word))

    def thin(self, met: np.ndarray, most: int) -> np.ndarray:
        """Keep the empty word and at most ``most`` words that were met again, the commonest first.

        ``met`` counts the occurrences of each id. Gives the old ids in the order of the new.
        """
        again = np.flatnonzero(met > 1)
        again = again[np.argsort(-met[again], kind="stable")[:most]]
        stay, names = np.union1d([0], again), list(self.ids)
        self.ids = {names[i]: k for k, i in enumerate(stay.tolist())}
        return stay


@dataclass
class Network:
    """Weights; the last embedding row stays zero and stands for a missing feature."""

    settings: Settings
    embed: np.ndarray
    kernels: list[np.ndarray]  # per width: (width, dims, filters)
    shift: np.ndarray
    out: np.ndarray
    bias: float
    languages: list[str | None] = dataclass_field(default_factory=list)  # None: all that are rare in the sample
    profile: np.ndarray | None = None  # (language_slots, languages), log probabilities
    thresholds: dict[str, float] = dataclass_field(default_factory=dict)
    threshold: float = 0.5
    seen: list[np.ndarray] | None = None  # squared gradients so far, while it is trained

    @classmethod
    def fresh(cls, s: Settings) -> Network:
        rng = np.random.default_rng(s.seed)
        embed = rng.normal(0, 0.05, (s.slots + 1, s.dims)).astype(np.float32)
        embed[-1] = 0
        kernels = [
            rng.normal(0, 1 / np.sqrt(w * s.dims), (w, s.dims, s.filters)).astype(np.float32) for w in s.widths
        ]
        n = len(s.widths) * s.filters
        return cls(s, embed, kernels, np.zeros(n, np.float32), rng.normal(0, 0.3, n).astype(np.float32), 0.0)

    def vectors(self, rows: np.ndarray) -> np.ndarray:
        """Word vectors of feature rows."""
        total = self.embed[rows[:, 0]]
        for column in rows.T[1:]:
            total = total + self.embed[column]
        return total

    def convolve(self, x: np.ndarray) -> np.ndarray:
        """Filter outputs at every word but the padding at the very end."""
        n, parts = len(x) - max(self.settings.widths) + 1, []
        for kernel in self.kernels:
            parts.append(sum(x[j : n + j] @ kernel[j] for j in range(len(kernel))))
        return np.concatenate(parts, axis=1)

    def logit(self, pooled: np.ndarray) -> np.ndarray:
        return np.maximum(pooled + self.shift, 0) @ self.out + self.bias


class Trainer:
    """Adagrad on log loss; only the words at each filter's maximum get a gradient."""

    def __init__(self, net: Network):
        self.net = net
        if net.seen is None:
            net.seen = [np.full(a.shape, 1e-3, np.float32) for a in (net.embed, *net.kernels, net.shift, net.out)]
            net.seen.append(np.full(1, 1e-3))

    def _move(self, weights: np.ndarray, seen: np.ndarray, gradient: np.ndarray) -> None:
        seen += gradient * gradient
        weights -= self.net.settings.rate * gradient / np.sqrt(seen)

    def step(self, docs: list[np.ndarray], rows: np.ndarray, labels: np.ndarray, weight=1.0) -> None:
        """One batch of texts as word ids; ``rows`` are the features of each id."""
        net, s = self.net, self.net.settings
        pad = max(s.widths) - 1
        ids = np.concatenate(docs)
        lengths = np.array([len(d) for d in docs])
        starts = np.cumsum(lengths) - lengths
        x = net.vectors(rows[ids])
        y = net.convolve(x)
        best = np.stack([a + y[a : a + n - pad].argmax(0) for a, n in zip(starts, lengths)])
        pooled = np.take_along_axis(y, best, 0)
        hidden = np.maximum(pooled + net.shift, 0)
        p = 1 / (1 + np.exp(-(hidden @ net.out + net.bias)))
        error = ((p - labels) * weight / len(docs)).astype(np.float32)
        back = error[:, None] * net.out * (hidden > 0)
        grad_out, grad_shift, grad_bias = error @ hidden, back.sum(0), float(error.sum())
        words, pulls = [], []
        for k, kernel in enumerate(net.kernels):
            own = slice(k * s.filters, (k + 1) * s.filters)
            b, pull = best[:, own], back[:, own]
            grad = np.empty_like(kernel)
            for j in range(len(kernel)):
                near = b + j
                grad[j] = np.einsum("bfd,bf->df", x[near], pull)
                words.append(ids[near].ravel())
                pulls.append((pull[:, :, None] * kernel[j].T).reshape(-1, s.dims))
            self._move(kernel, net.seen[1 + k], grad)
        self._move(net.out, net.seen[-2], grad_out)
        self._move(net.shift, net.seen[-3], grad_shift)
        net.seen[-1] += grad_bias**2
        net.bias -= s.rate * grad_bias / float(net.seen[-1][0]) ** 0.5
        pull, slots = np.concatenate(pulls), rows[np.concatenate(words)]
        live = np.abs(pull).sum(1) > 0
        pull, slots = pull[live], slots[live]
        touched, inverse = np.unique(slots, return_inverse=True)
        grad = np.zeros((len(touched), s.dims), np.float32)
        inverse = inverse.reshape(slots.shape)
        for column in inverse.T:
            np.add.at(grad, column, pull)
        grad[touched == s.slots] = 0
        seen = net.seen[0][touched] + grad * grad
        net.seen[0][touched] = seen
        net.embed[touched] -= s.rate * grad / np.sqrt(seen)


def fit_network(docs: list[np.ndarray], rows: np.ndarray, labels: np.ndarray, s: Settings) -> Network:
    """Several epochs over texts that fit in memory."""
    net, rng = Network.fresh(s), np.random.default_rng(s.seed)
    trainer = Trainer(net)
    for _ in range(s.epochs):
        order = rng.permutation(len(docs))
        for at in range(0, len(order), s.batch):
            chosen = order[at : at + s.batch]
            trainer.step([docs[i] for i in chosen], rows, labels[chosen])
    return net


def _pool(net: Network, x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Maxima of the filters over each text of a block laid end to end, padding included."""
    y, pad, bounds = net.convolve(x), max(net.settings.widths) - 1, np.cumsum(lengths)
    if not pad:
        return np.maximum.reduceat(y, bounds - lengths, axis=0)
    edges = np.stack([bounds - lengths, bounds - pad], axis=1).ravel()
    return np.maximum.reduceat(y, edges[:-1], axis=0)[::2]


class Scorer:
    """Scores batches of whole texts; remembers a bounded number of words."""

    def __init__(self, net: Network, remember: int = 100_000):
        self.net, self.remember = net, remember
        self.words = Words(net.settings)
        self.table = np.zeros((0, net.settings.dims), np.float32)
        self.profile = np.zeros((0, len(net.languages)), np.float32)
        self.met = np.zeros(0, np.int64)

    def _forget(self) -> None:
        stay = self.words.thin(self.met, self.remember // 2)
        self.table, self.profile, self.met = self.table[stay], self.profile[stay], self.met[stay] // 2

    def _block(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        net = self.net
        if len(self.words.ids) > self.remember:
            self._forget()
        docs = [self.words.of(t) for t in texts]
        if self.words.rows:
            rows, self.words.rows = np.array(self.words.rows), []  # as lists they take several times the table
            self.table = np.concatenate([self.table, net.vectors(rows)])
            self.profile = np.concatenate([self.profile, net.profile[rows[:, 0] % net.settings.language_slots]])
        ids, lengths = np.concatenate(docs), np.array([len(d) for d in docs])
        met = np.bincount(ids, minlength=len(self.table))
        met[: len(self.met)] += self.met
        self.met = met
        logits = net.logit(_pool(net, self.table[ids], lengths))
        starts = np.cumsum(lengths) - lengths
        return logits, np.add.reduceat(self.profile[ids], starts, axis=0)

    def logits(self, texts: list[str | None]) -> tuple[np.ndarray, list[str | None]]:
        """Raw outputs and guessed languages."""
        out, guesses = [np.zeros(0)], []
        for _, block in text_blocks(texts, 400_000):
            logits, likely = self._block(block)
            out.append(logits)
            names = self.net.languages
            guesses += [names[i] for i in likely.argmax(1)] if names else [None] * len(block)
        return np.concatenate(out), guesses

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Probabilities moved so that each language's threshold becomes one half."""
        logits, guesses = self.logits(texts)
        border = np.array([self.net.thresholds.get(g, self.net.threshold) for g in guesses])
        return 1 / (1 + np.exp(-np.clip(logits - np.log(border / (1 - border)), -60, 60)))


def _profiles(net: Network, rows: np.ndarray, docs, langs) -> None:
    """Smoothed word frequencies per language, for guessing a language from the text.

    A language with too few sampled texts for a threshold shares a profile with all
    such languages, and takes the threshold of all texts. So the bound of the sample
    bounds the profiles.
    """
    known = pd.Series([x for x in langs if x is not None], dtype=object).value_counts()
    often = known.index[known >= 2 * CALIBRATED]
    net.languages = sorted(often) + [None] * (len(often) < len(known))
    column = {x: net.languages.index(x if x in often else None) for x in known.index}
    counts = np.full((net.settings.language_slots, len(net.languages)), 0.1)
    first = rows[:, 0] % net.settings.language_slots
    for doc, lang in zip(docs, langs):
        if lang is not None:
            np.add.at(counts[:, column[lang]], first[doc], 1)
    net.profile = np.log(counts / counts.sum(0)).astype(np.float32) if net.languages else counts.astype(np.float32)


def best_threshold(p: np.ndarray, label: np.ndarray, weight: np.ndarray) -> float:
    """The border of least weighted error, in the middle of the widest equal stretch."""
    order = np.argsort(p, kind="stable")
    p, label, weight = p[order], label[order], weight[order]
    missed = np.concatenate([[0], np.cumsum(weight * label)])
    alarms = np.concatenate([np.cumsum((weight * (1 - label))[::-1])[::-1], [0]])
    errors = missed + alarms
    edges = np.concatenate([[0.0], p, [1.0]])
    gaps = np.diff(edges)
    k = max(np.flatnonzero(errors <= errors.min() + 1e-12), key=lambda i: gaps[i])
    return float(np.clip((edges[k] + edges[k + 1]) / 2, 1e-4, 1 - 1e-4))


def _word_ids(texts: list[str], s: Settings, most: int = 10_000) -> tuple[list[np.ndarray], np.ndarray]:
    """Word ids of each text and the features of each id; only about ``most`` words at a time are kept as lists."""
    words, docs, parts = Words(s), [], []
    for text in texts:
        docs.append(words.of(text))
        if len(words.rows) >= most:
            parts.append(np.array(words.rows, np.int32))
            words.rows = []
    if words.rows:
        parts.append(np.array(words.rows, np.int32))
    return docs, np.concatenate(parts)


def train(texts: list[str], labels: np.ndarray, langs: list, prior: float, settings: Settings) -> Network:
    """Fit on four fifths of the sample, calibrate the thresholds on the rest.

    ``prior`` is the share of label 1 among all usable labelled rows, which the balanced
    sample no longer shows.
    """
    docs, rows = _word_ids(texts, settings)
    held = np.arange(len(docs)) % 5 == 4
    fit = np.flatnonzero(~held)
    net = fit_network([docs[i] for i in fit], rows, labels[fit], settings)
    _profiles(net, rows, docs, langs)
    scorer = Scorer(net)
    logits, guesses = scorer.logits([texts[i] for i in np.flatnonzero(held)])
    p, y = 1 / (1 + np.exp(-np.clip(logits, -60, 60))), labels[held]
    share = y.mean() if len(y) else 0.5
    weight = np.where(y == 1, prior / max(share, 1e-9), (1 - prior) / max(1 - share, 1e-9))
    if 0 < share < 1:
        net.threshold = best_threshold(p, y, weight)
    guesses = np.array(guesses, dtype=object)
    for lang in net.languages:
        own = guesses == lang
        if lang is not None and min((y[own] == 1).sum(), (y[own] == 0).sum()) >= CALIBRATED:
            net.thresholds[lang] = best_threshold(p[own], y[own], weight[own])
    return net


def sample(
    documents: DataFrame, labels: DataFrame, usable: Column, doc_id: str, text: str, lang: str, label: str, s: Settings
) -> tuple[pd.DataFrame, float]:
    """At most ``rows_per_class`` labelled rows of each class, and the share of class 1 among all usable ones.

    Rows are taken in the order of a hash of their id, among texts of up to
    ``row_chars`` characters; together the bounds keep the sample small.
    """
    marked = labels.filter(field(label).isin(0, 1) & field(doc_id).isNotNull()).select(
        field(doc_id).alias("id"), field(label).cast("int").alias("y")
    )
    marked = marked.groupBy("id").agg(F.max("y").alias("y"))
    docs = documents.filter(usable & (F.length(field(text)) <= s.row_chars)).select(
        field(doc_id).alias("id"), field(lang).alias("lang"), field(text).alias("t")
    )
    usable_ids = documents.filter(usable).select(field(doc_id).alias("id"))
    counts = {r.y: r["count"] for r in marked.join(usable_ids, "id", "left_semi").groupBy("y").count().collect()}
    total = sum(counts.values())
    order = F.xxhash64("id")
    # ids first: a bounded list of ids is joined with the texts, not the other way round
    ids = docs.select("id").join(marked, "id").dropDuplicates(["id"])
    chosen = [ids.filter(F.col("y") == y).orderBy(order, "id").limit(s.rows_per_class) for y in (0, 1)]
    picked = docs.join(F.broadcast(chosen[0].unionByName(chosen[1])), "id").dropDuplicates(["id"])
    frame = picked.toPandas()
    frame = frame.iloc[np.argsort(pd.util.hash_array(frame["id"].to_numpy()), kind="stable")]
    return frame, counts.get(1, 0) / total if total else 0.0


def labelled(
    documents: DataFrame, labels: DataFrame, usable: Column, doc_id: str, text: str, lang: str, label: str
) -> DataFrame:
    """``(id, y, lang, t, held)`` of every usable row that has a label and a text; a fifth of the ids is held."""
    marked = labels.filter(field(label).isin(0, 1) & field(doc_id).isNotNull()).select(
        field(doc_id).alias("id"), field(label).cast("int").alias("y")
    )
    # written first, so that Spark knows the size of the labels before it moves a text
    marked = durable(marked.groupBy("id").agg(F.max("y").alias("y")))
    docs = documents.filter(usable & field(text).isNotNull()).select(
        field(doc_id).alias("id"), field(lang).cast("string").alias("lang"), field(text).alias("t")
    )
    # one way to join at every size: each text moves once and is not sorted
    return docs.join(marked.hint("shuffle_hash"), "id").withColumn("held", _held(F.col("id")))


def _held(doc_id: Column) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(5)) == 4


#: Slots of an embedding block that travels as one row.
SLOT_BLOCK = 1 << 13
_PARTS = "kind string, name string, block int, learner int, value binary, touched binary"


def _rest(net: Network) -> np.ndarray:
    """All weights but the embedding in one array."""
    return np.concatenate([*(k.ravel() for k in net.kernels), net.shift, net.out, [net.bias]]).astype(np.float64)


def _learn(shared, often: list[str], weight: list[float], remember: int = 100_000):
    """The function of one learner: rows of ``(t, y, lang, held)`` to what it changed and counted."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        start: Network = shared.value
        s = start.settings
        net = copy.deepcopy(start)
        trainer, names = Trainer(net), set(often)
        counts: dict[str | None, np.ndarray] = {}
        words, rows, steps = Words(s), np.zeros((0, 1 + len(s.prefixes)), np.int64), 0
        met = np.zeros(0, np.int64)

        def flush(batch: list) -> None:
            nonlocal rows, steps, met
            if words.rows:
                rows, words.rows = np.concatenate([rows, np.array(words.rows)]), []
                met = np.append(met, np.zeros(len(rows) - len(met), np.int64))
            if batch:
                met += np.bincount(np.concatenate([doc for doc, *_ in batch]), minlength=len(met))
            for doc, _, lang, _ in batch:
                if isinstance(lang, str):
                    own = counts.setdefault(lang if lang in names else None, np.zeros(s.language_slots, np.int64))
                    np.add.at(own, rows[doc, 0] % s.language_slots, 1)
            fit = [(doc, y) for doc, y, _, held in batch if not held]
            if fit:
                y = np.array([y for _, y in fit], dtype=np.float32)
                trainer.step([doc for doc, _ in fit], rows, y, np.array(weight, np.float32)[y.astype(int)])
                steps += 1
            if len(words.ids) > remember:
                stay = words.thin(met, remember // 2)
                rows, met = rows[stay], met[stay] // 2

        for frame in batches:
            batch, fits, size = [], 0, 0
            for text, y, lang, held in zip(frame["t"], frame["y"], frame["lang"], frame["held"]):
                doc = words.of(text)
                batch.append((doc, y, lang, held))
                fits, size = fits + (not held), size + len(doc)
                if fits == s.batch or size > 100_000:
                    flush(batch)
                    batch, fits, size = [], 0, 0
            flush(batch)
        me = TaskContext.get().partitionId()
        for name, own in counts.items():
            yield _part("profile", name, 0, me, own)
        if steps:
            yield _part("rest", None, 0, me, _rest(net) - _rest(start))
            moved, touched = net.embed - start.embed, (net.seen[0] > start.seen[0]).any(1)
            for at in range(0, len(moved), SLOT_BLOCK):
                mine = slice(at, at + SLOT_BLOCK)
                if touched[mine].any():
                    yield _part("embed", None, at, me, moved[mine], touched[mine].astype(np.int32))

    return run


def _part(kind, name, block, learner, value: np.ndarray, touched: np.ndarray | None = None) -> pd.DataFrame:
    row = (kind, name, block, learner, value.tobytes(), b"" if touched is None else touched.tobytes())
    return pd.DataFrame([row], columns=["kind", "name", "block", "learner", "value", "touched"])


def _add_parts(parts: pd.DataFrame) -> pd.DataFrame:
    """Sums of the learners' counts and means of what they changed, always in the same order."""
    parts = parts.sort_values("learner")
    kind, name, block = parts["kind"].iloc[0], parts["name"].iloc[0], parts["block"].iloc[0]
    stored = {"profile": np.int64, "rest": np.float64, "embed": np.float32}[kind]
    value = sum(np.frombuffer(v, stored).astype(np.int64 if kind == "profile" else np.float64) for v in parts["value"])
    if kind == "rest":
        value = value / len(parts)
    if kind == "embed":
        # of a slot only the learners count that met it
        times = np.maximum(sum(np.frombuffer(v, np.int32) for v in parts["touched"]), 1)
        value = (value.reshape(len(times), -1) / times[:, None]).astype(np.float32)
    return _part(kind, name if isinstance(name, str) else None, block, 0, value)


def learn_all(net: Network, rows: DataFrame) -> Network:
    """One pass over every row of :func:`labelled` from the weights of ``net``; profiles from all of them.

    A weight becomes the mean of the learners that changed it. Learners, their rows and
    the order of these depend on the rows alone, so the result does not depend on the
    cluster. What reaches the driver is one network and the profiles.
    """
    spark, s = rows.sparkSession, net.settings
    sizes = {(r.held, r.y): r["count"] for r in rows.groupBy("held", "y").count().collect()}
    fit = [sizes.get((False, y), 0) for y in (0, 1)]
    known = rows.filter("lang is not null").groupBy("lang").count()
    often = sorted(r.lang for r in known.filter(F.col("count") >= 2 * CALIBRATED).select("lang").collect())
    Trainer(net)
    # classes weigh the same, as in the sample
    weight = [sum(fit) / (2 * n) if n else 0.0 for n in fit]
    learners = min(max(-(-sum(fit) // s.learner_rows), 1), s.learners)
    dealt = rows.select("t", "y", "lang", "held", F.xxhash64("id").alias("order"), F.xxhash64("t").alias("same"))
    dealt = dealt.repartition(learners, "order").sortWithinPartitions("order", "same").select("t", "y", "lang", "held")
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(net)  # fixed size
    parts = dealt.mapInPandas(tidy(_learn(shared, often, weight)), _PARTS)
    found = parts.groupBy("kind", "name", "block").applyInPandas(_add_parts, _PARTS).collect()
    shared.destroy()

    counts = {r.name: np.frombuffer(r.value, np.int64) for r in found if r.kind == "profile"}
    net.languages = often + [None] * (None in counts)
    profile = np.full((s.language_slots, len(net.languages)), 0.1)
    for i, name in enumerate(net.languages):
        profile[:, i] += counts.get(name, 0)
    net.profile = np.log(profile / profile.sum(0)).astype(np.float32) if net.languages else profile.astype(np.float32)
    for r in found:
        if r.kind == "rest":
            flat, at = _rest(net) + np.frombuffer(r.value, np.float64), 0
            for weights in (*net.kernels, net.shift, net.out):
                weights[...] = flat[at : at + weights.size].reshape(weights.shape)
                at += weights.size
            net.bias = float(flat[-1])
        if r.kind == "embed":
            moved = np.frombuffer(r.value, np.float32).reshape(-1, s.dims)
            net.embed[r.block : r.block + len(moved)] += moved
    net.seen = None
    return net


def calibrate(net: Network, held: DataFrame) -> Network:
    """Thresholds from the scores of all held rows, counted in steps of a ten-thousandth."""
    shared = held.sparkSession.sparkContext.broadcast(net)  # fixed size

    def make():
        scorer = Scorer(shared.value)

        def run(texts):
            logits, guesses = scorer.logits(texts)
            p = 1 / (1 + np.exp(-np.clip(logits, -60, 60)))
            return pd.DataFrame({"p": np.round(p, 4), "guess": pd.Series(guesses, dtype=object)})

        return run

    scored = held.select("y", per_row(make, "p double, guess string", F.col("t")).alias("s"))
    rows = scored.groupBy("s.guess", "s.p", "y").count().orderBy("guess", "p", "y").collect()  # steps, not texts
    shared.destroy()
    p, y, n = (np.array([r[c] for r in rows], dtype=float) for c in ("p", "y", "count"))
    guesses = np.array([r.guess for r in rows], dtype=object)
    net.threshold, net.thresholds = 0.5, {}
    if 0 < (y * n).sum() < n.sum():
        net.threshold = best_threshold(p, y, n)
    for lang in net.languages:
        own = guesses == lang
        if lang is not None and min((y * n)[own].sum(), ((1 - y) * n)[own].sum()) >= CALIBRATED:
            net.thresholds[lang] = best_threshold(p[own], y[own], n[own])
    return net


def fit(
    documents: DataFrame,
    labels: DataFrame,
    usable: Column,
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    label: str = "toxic",
    settings: Settings = Settings(),
) -> Network | None:
    """Train on all labelled rows for which ``usable`` holds; None without both classes.

    Four fifths of the ids train the network, a sample of them gives the weights it
    starts from, and the held fifth sets the thresholds. Labels other than 0 and 1 and
    null ids are passed over; an id labelled twice is toxic if any label says so. Null
    texts teach nothing.
    """
    # written once, as several passes read them
    rows = durable(labelled(documents, labels, usable, doc_id, text, lang, label))
    if len(rows.select("y").distinct().collect()) < 2:
        return None
    start = _start(*sample(documents, labels, usable & ~_held(field(doc_id)), doc_id, text, lang, label, settings), settings)
    give_back_driver(documents.sparkSession)
    return calibrate(learn_all(start, rows), rows.filter("held"))


def _start(first: pd.DataFrame, prior: float, settings: Settings) -> Network:
    """The network that the sample gives; a fresh one where the sample lacks a class."""
    y = first["y"].to_numpy(dtype=np.float32)
    if len(set(y.tolist())) < 2:
        return Network.fresh(settings)
    return train(first["t"].tolist(), y, [x if isinstance(x, str) else None for x in first["lang"]], prior, settings)


def score_texts(
    df: DataFrame, network: Network | None, text: str = "text", score: str = "score", predicted: str = "predicted"
) -> DataFrame:
    """Add the score (0 to 1) and the prediction (1 from one half) of every whole text.

    Null and empty texts are scored as a text without words. Without a network
    (no labels of both classes) every score is 0. Other columns pass through; one
    named like a result is replaced.
    """
    shared, made = df.sparkSession.sparkContext.broadcast(network), fresh(df, "made")  # fixed size

    def make():
        scorer = Scorer(shared.value) if shared.value is not None else None

        def run(texts):
            values = scorer.scores(texts) if scorer else np.zeros(len(texts))
            return pd.DataFrame({"s": values})

        return run

    keep = [field(c) for c in df.columns if c not in (score, predicted)]
    value = field(made)["s"]
    return df.withColumn(made, per_row(make, "s double", field(text))).select(
        *keep, value.alias(score), (value >= 0.5).cast("int").alias(predicted)
    )
