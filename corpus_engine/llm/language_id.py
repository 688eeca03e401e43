"""Language identification by segmentation-marginalised unigrams.

Every language has probabilities of the pieces of one fixed public vocabulary. The
score of a word is the sum over all ways to cut it into pieces (a forward pass), and
the probabilities are fitted by expectation-maximisation over the same sums.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpus_engine.llm.common import field, fresh, per_row, text_blocks

LETTERS = regex.compile(r"\p{L}+")
SPACE = "▁"
UNKNOWN = -14.0
NO_LANGUAGE = "und"


def read_pieces(path: str) -> list[str]:
    """Normal pieces of a piece vocabulary, lower-cased, each once."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names = (
        model.id_to_piece(i).lower()
        for i in range(model.get_piece_size())
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))
    )
    return list(dict.fromkeys(names))


OPEN = -1


def with_prefixes(pieces: dict[str, int]) -> dict[str, int]:
    """The pieces, and their beginnings that are no pieces as ``OPEN``."""
    starts = {p[:k]: OPEN for p in pieces for k in range(1, len(p))}
    return starts | pieces


class Lattice:
    """All segmentations of a batch of words, as edges sorted by end, then word.

    ``known`` maps pieces to numbers and beginnings of pieces to ``OPEN``, so that a
    search ends at the first substring that begins no piece.
    """

    def __init__(self, words: list[str], known: dict[str, int], unknown: int):
        self.n = len(words)
        word, start, end, piece = [], [], [], []
        get = known.get
        for k, text in enumerate(words):
            size, before = len(text), len(piece)
            for i in range(size):
                j = i + 1
                p = get(text[i:j])
                if p is None or p == OPEN:  # a character outside the vocabulary
                    start.append(i), end.append(j), piece.append(unknown)
                while p is not None:
                    if p != OPEN:
                        start.append(i), end.append(j), piece.append(p)
                    j += 1
                    if j > size:
                        break
                    p = get(text[i:j])
            word += [k] * (len(piece) - before)
        self.size = np.array([len(w) for w in words])
        arrays = [np.array(x, dtype=np.int64) for x in (word, start, end, piece)]
        order = np.lexsort((arrays[0], arrays[2]))
        self.word, self.start, self.end, self.piece = (x[order] for x in arrays)

    def forward(self, logp: np.ndarray) -> np.ndarray:
        """Log sums over the segmentations of each prefix: (word, position, language)."""
        alpha = np.full((self.n, self.size.max() + 1, logp.shape[1]), -np.inf)
        alpha[:, 0] = 0
        self._sweep(alpha, logp, self.end, self.word, self.start, range(1, self.size.max() + 1))
        return alpha

    def backward(self, logp: np.ndarray) -> np.ndarray:
        """The same for suffixes."""
        beta = np.full((self.n, self.size.max() + 1, logp.shape[1]), -np.inf)
        beta[np.arange(self.n), self.size] = 0
        order = np.lexsort((self.word, self.start))
        own = self.start[order]
        self._sweep(beta, logp, own, self.word[order], self.end[order], range(self.size.max() - 1, -1, -1), self.piece[order])
        return beta

    def _sweep(self, table, logp, key, word, other, positions, piece=None) -> None:
        piece = self.piece if piece is None else piece
        bounds = np.searchsorted(key, np.arange(self.size.max() + 2))
        for p in positions:
            lo, hi = bounds[p], bounds[p + 1]
            if lo == hi:
                continue
            w = word[lo:hi]
            sums = table[w, other[lo:hi]] + logp[piece[lo:hi]]
            first = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
            table[w[first], p] = np.logaddexp.reduceat(sums, first, axis=0)

    def totals(self, alpha: np.ndarray) -> np.ndarray:
        return alpha[np.arange(self.n), self.size]


def lattices(words: list[str], known: dict[str, int], unknown: int, cells: int = 400_000):
    """Lattices of words of similar length, of a bounded size; with the words' indices."""
    order = sorted(range(len(words)), key=lambda i: len(words[i]))
    at = 0
    while at < len(order):
        end = at + 1
        while end < len(order) and (end - at + 1) * (len(words[order[end]]) + 1) <= cells:
            end += 1
        chosen = order[at:end]
        yield chosen, Lattice([words[i] for i in chosen], known, unknown)
        at = end


@dataclass
class PieceModel:
    """Log probabilities (piece or unknown character, language) and log priors."""

    pieces: dict[str, int]
    known: dict[str, int]
    languages: list[str]
    logp: np.ndarray
    prior: np.ndarray

    def word_scores(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), len(self.languages)))
        for chosen, lattice in lattices([SPACE + w for w in words], self.known, len(self.pieces)):
            out[chosen] = lattice.totals(lattice.forward(self.logp))
        return out


def letters(text: str) -> list[str]:
    return [w.lower() for w in LETTERS.findall(text)]


def fit_pieces(
    texts: list[str], langs: list[str], prior: dict[str, int], pieces: list[str], rounds: int = 3, smooth: float = 0.05
) -> PieceModel:
    """Expectation-maximisation from equal piece probabilities."""
    index = {p: i for i, p in enumerate(pieces)}
    languages = sorted(set(langs))
    counts = {lang: Counter() for lang in languages}
    for text, lang in zip(texts, langs):
        counts[lang].update(letters(text))
    words = sorted(set().union(*counts.values()))
    weight = np.array([[counts[lang][w] for lang in languages] for w in words], dtype=float).reshape(len(words), -1)
    known = with_prefixes(index)
    logp = np.full((len(pieces) + 1, len(languages)), -np.log(len(pieces)))
    logp[-1] = UNKNOWN
    for _ in range(rounds):
        expected = np.full((len(pieces) + 1, len(languages)), smooth)
        for chosen, lattice in lattices([SPACE + w for w in words], known, len(pieces)):
            alpha, beta = lattice.forward(logp), lattice.backward(logp)
            share = np.exp(
                alpha[lattice.word, lattice.start]
                + logp[lattice.piece]
                + beta[lattice.word, lattice.end]
                - lattice.totals(alpha)[lattice.word]
            )
            np.add.at(expected, lattice.piece, share * weight[chosen][lattice.word])
        logp = np.log(expected / expected[:-1].sum(0))
        logp[-1] = UNKNOWN
    total = np.array([prior.get(lang, 1) for lang in languages], dtype=float)
    return PieceModel(index, known, languages, logp, np.log(total / total.sum()))


class Identifier:
    """Scores batches of whole texts; remembers a bounded number of white-space tokens."""

    def __init__(self, model: PieceModel, remember: int = 600_000):
        self.model, self.remember = model, remember
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.words: dict[str, int] = {}
        self.scores = np.zeros((0, len(self.model.languages)))
        # per token: its letters' log score in each language, and whether it has any
        self.table = np.zeros((0, len(self.model.languages) + 1))

    def _learn(self, tokens: list[str]) -> None:
        parts = [letters(t) for t in tokens]
        words = [w for w in dict.fromkeys(w for p in parts for w in p) if w not in self.words]
        self.words |= {w: len(self.scores) + i for i, w in enumerate(words)}
        self.scores = scores = np.concatenate([self.scores, self.model.word_scores(words)])
        index = self.words
        rows = np.zeros((len(tokens), self.table.shape[1]))
        for row, part in zip(rows, parts):
            for w in part:
                row[:-1] += scores[index[w]]
            row[-1] = bool(part)
        for t in tokens:
            self.known[t] = len(self.known)
        self.table = np.concatenate([self.table, rows])

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Languages and their posterior probabilities."""
        langs, scores, names = [], [], self.model.languages
        for _, block in text_blocks(texts, 1_000_000):
            if len(self.known) > self.remember:
                self._forget()
            tokens = [t.split() for t in block]
            flat = [x for t in tokens for x in t]
            ids = list(map(self.known.get, flat))
            if None in ids:
                self._learn(list(dict.fromkeys(x for x, i in zip(flat, ids) if i is None)))
                ids = list(map(self.known.__getitem__, flat))
            sizes = np.array([len(t) for t in tokens])
            total = np.zeros((len(block), self.table.shape[1]))
            filled = np.flatnonzero(sizes)
            if len(filled):
                starts = (np.cumsum(sizes) - sizes)[filled]
                total[filled] = np.add.reduceat(self.table[ids], starts, axis=0)
            logit = total[:, :-1] + self.model.prior
            best = logit.argmax(1)
            share = 1 / np.exp(logit - logit.max(1, keepdims=True)).sum(1)
            known = total[:, -1] > 0
            langs += [names[b] if k else NO_LANGUAGE for b, k in zip(best, known)]
            scores.append(np.where(known, share, 0.0))
        return langs, np.concatenate([np.zeros(0), *scores])


def fit(
    documents: DataFrame,
    usable: Column,
    vocabulary: str,
    text: str = "text",
    lang: str = "lang",
    order: Column | None = None,
    sample_rows: int = 4_000,
    row_chars: int = 20_000,
) -> PieceModel | None:
    """Learn from a bounded sample of rows for which ``usable`` holds.

    The sample has at most ``sample_rows`` rows, dealt evenly to all languages but at
    least one each, in the order of ``order`` (a hash of the text by default), among
    texts of up to ``row_chars`` characters. A language that has no such text gives its
    shortest ones, as many as have the characters of its share. Priors count all usable
    rows. None when no usable row has a text and a language.
    """
    rows = documents.filter(usable & field(lang).isNotNull() & field(text).isNotNull())
    rows = rows.select(field(lang).alias("lang"), field(text).alias("t"), (order if order is not None else F.xxhash64(field(text))).alias("o"))
    counts = rows.groupBy("lang").count().collect()
    if not counts:
        return None
    prior = {r["lang"]: r["count"] for r in counts}
    # long texts come after all others, the shortest first
    size = F.when(F.length("t") > row_chars, F.length("t")).otherwise(0)
    rows, share = rows.withColumn("size", size), max(1, sample_rows // len(prior))
    place = Window.partitionBy("lang").orderBy("size", "o")
    # the cut is made on ids first, so that no group of texts is gathered
    ids = rows.select("lang", "size", "o").withColumn("k", F.row_number().over(place)).filter(F.col("k") <= share)
    least = F.min("size").over(Window.partitionBy("lang"))
    chars = F.sum("size").over(place.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ids = ids.withColumn("least", least).withColumn("chars", chars)
    ids = ids.filter((F.col("size") == 0) | (F.col("least") > 0) & ((F.col("k") == 1) | (F.col("chars") <= share * row_chars)))
    key = ["lang", "size", "o"]
    picked = rows.join(F.broadcast(ids.select(*key).distinct()), key).dropDuplicates(["lang", "o"]).toPandas()
    picked = picked.sort_values(["lang", "o"], kind="stable")
    if picked.empty:
        return None
    return fit_pieces(picked["t"].tolist(), picked["lang"].tolist(), prior, read_pieces(vocabulary))


def identify(
    df: DataFrame, model: PieceModel | None, text: str = "text", lang_pred: str = "lang_pred", score: str = "score"
) -> DataFrame:
    """Add the predicted language of every whole text and its posterior probability.

    ``und`` with score 0 for a null text, a text without a letter, or without a model.
    Words are runs of letters, lower-cased, and are scored independently; a letter
    outside the vocabulary costs the same in every language. Repeated rows stay;
    other columns pass through, and one named like a result is replaced.
    """
    shared, made = df.sparkSession.sparkContext.broadcast(model), fresh(df, "made")  # vocabulary x languages

    def make():
        identifier = Identifier(shared.value) if shared.value is not None else None

        def run(texts):
            if identifier is None:
                return pd.DataFrame({"l": [NO_LANGUAGE] * len(texts), "s": 0.0})
            langs, scores = identifier.predict(texts)
            return pd.DataFrame({"l": pd.Series(langs, dtype=object), "s": scores})

        return run

    keep = [field(c) for c in df.columns if c not in (lang_pred, score)]
    return df.withColumn(made, per_row(make, "l string, s double", field(text))).select(
        *keep, field(made)["l"].alias(lang_pred), field(made)["s"].alias(score)
    )
