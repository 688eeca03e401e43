import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpus_engine.llm import toxicity as T

TINY = T.Settings(slots=512, dims=4, filters=3, rows_per_class=60, epochs=20, language_slots=64)


def slow_logit(net, text):
    """One text, one word, one filter at a time."""
    s, words = net.settings, T.Words(net.settings)
    tokens = text.split() or [""]
    x = [sum(net.embed[f] for f in words.features(t)) for t in tokens]
    blank = sum(net.embed[f] for f in words.features(""))
    x += [blank] * (max(s.widths) - 1)
    out = net.bias
    for k, width in enumerate(s.widths):
        for f in range(s.filters):
            best = max(
                sum(x[i + j] @ net.kernels[k][j][:, f] for j in range(width)) for i in range(len(tokens))
            )
            out += max(best + net.shift[k * s.filters + f], 0) * net.out[k * s.filters + f]
    return out


def plain_features(s, word):
    word = T.EDGES.sub("", word.lower())
    keys = [word, *(f"{n}:{word[:n]}" for n in s.prefixes if len(word) >= n)]
    slots = [zlib.crc32(k.encode()) % s.slots for k in keys]
    return slots + [s.slots] * (1 + len(s.prefixes) - len(slots))


def test_features():
    words = ["", "a", "Vile!", "__x_y_", "«élève»", "ÉCOLES", "straße-", "(12,345)", "x²", "中文字符很多个", "İstanbul", "…", "a\u0301b", "\u0301bcdefgh"]
    for s in (TINY, T.Settings(prefixes=(3, 1))):
        assert [T.Words(s).features(w) for w in words] == [plain_features(s, w) for w in words]


def test_common_words_stay(monkeypatch):
    """A full memory lets go of words that came once, not of common ones."""
    asked, features = [], T.Words.features
    monkeypatch.setattr(T.Words, "features", lambda self, word: asked.append(word) or features(self, word))
    net = T.Network.fresh(TINY)
    net.languages, net.profile = ["en"], np.zeros((TINY.language_slots, 1), np.float32)
    texts = [f"often w{i} vile{i} rare{i}" for i in range(60)]
    scorer = T.Scorer(net, remember=40)
    parts = [scorer.logits([t])[0] for t in texts]
    assert asked.count("often") == 1 and len(scorer.words.ids) == len(scorer.table) < 50
    assert np.allclose(np.concatenate(parts), T.Scorer(net).logits(texts)[0])


@pytest.fixture(scope="module")
def tables(spark):
    rng = np.random.default_rng(3)
    rows, labels = [], []
    for i in range(160):
        words = [f"w{k}" for k in rng.integers(0, 40, rng.integers(1, 30))]
        if i % 2:
            words.insert(int(rng.integers(0, len(words) + 1)), ["Vile!", "rotten"][i % 3 % 2])
        rows.append((i, " ".join(words), None if i % 17 == 0 else ["en", "fr"][i % 3 % 2], "x"))
        if i < 140:
            labels.append((i, 1 if i % 2 else 0))
    rows += [(None, "vile", "en", "x"), (500, None, None, "x"), (501, "", None, "x"), (1, rows[1][1], "fr", "x")]
    labels += [(None, 1), (3, 1), (5, None), (700, 1), (501, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, made string")
    return docs, spark.createDataFrame(labels, "doc_id long, toxic int")


def test_learns_and_matches_slow_version(tables):
    docs, labels = tables
    net = T.fit(docs, labels, F.col("doc_id") % 4 != 0, settings=TINY)
    rows = T.score_texts(docs, net).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.made == "x" for r in rows)
    assert all(r.predicted == (r.score >= 0.5) for r in rows)
    fair = [r for r in rows if r.doc_id is not None and r.doc_id < 160]
    assert np.mean([r.predicted == r.doc_id % 2 for r in fair]) > 0.85
    texts = [r.text or "" for r in rows]
    logits, _ = T.Scorer(net).logits(texts)
    assert np.allclose(logits, [slow_logit(net, t) for t in texts], atol=1e-3)
    forgetful = T.Scorer(net, remember=2).scores(texts)
    assert np.allclose(forgetful, [r.score for r in rows], atol=1e-5)


def test_scorer_keeps_no_lists_of_features():
    """Words of later blocks join the table; the lists they came from are let go."""
    net = T.Network.fresh(TINY)
    net.languages, net.profile = ["en"], np.zeros((TINY.language_slots, 1), np.float32)
    texts = [f"w{i} w{i + 1} vile{i}" for i in range(50)]
    scorer = T.Scorer(net)
    parts = [scorer.logits(texts[at : at + 10])[0] for at in range(0, 50, 10)]
    assert scorer.words.rows == [] and len(scorer.table) == len(scorer.words.ids) == 102
    assert np.allclose(np.concatenate(parts), T.Scorer(net).logits(texts)[0])
    assert np.allclose(parts[4], [slow_logit(net, t) for t in texts[40:]], atol=1e-4)


def test_training_keeps_few_lists_of_features(monkeypatch):
    """The features of a sample's words become arrays on the way, and are the same as all at once."""
    texts = [" ".join(f"w{i * 7 + k}" for k in range(20)) for i in range(3_000)] + [""]
    held, of = [], T.Words.of
    monkeypatch.setattr(T.Words, "of", lambda self, text: [of(self, text), held.append(len(self.rows))][0])
    labels = np.arange(len(texts), dtype=np.float32) % 2
    T.train(texts, labels, ["en"] * len(texts), 0.5, T.Settings(slots=512, dims=4, filters=3, epochs=1, language_slots=64))
    assert max(held[: len(texts)]) < 11_000 < 21_000 < len({w for t in texts for w in t.split()})
    words = T.Words(TINY)
    want = [of(words, t) for t in texts]
    docs, rows = T._word_ids(texts, TINY, 50)
    assert all(map(np.array_equal, docs, want)) and np.array_equal(rows, np.array(words.rows))


def test_one_class_or_no_rows(spark, tables):
    docs, labels = tables
    assert T.fit(docs, labels.filter("toxic = 0"), F.lit(True), settings=TINY) is None
    assert T.fit(docs.limit(0), labels, F.lit(True), settings=TINY) is None
    assert {r.score for r in T.score_texts(docs, None).collect()} == {0.0}


def test_prior_of_usable_rows(spark):
    """Held-out rows and labels without a document don't count; long texts that are never sampled do."""
    rows = [(i, "w " * (30_000 if i < 2 else 3), "en") for i in range(20)]
    docs = spark.createDataFrame(rows + rows[:3], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i < 3 or i >= 10)) for i in range(40)], "doc_id long, toxic int")
    usable = F.col("doc_id") < 10
    frame, prior = T.sample(docs, labels, usable, "doc_id", "text", "lang", "toxic", TINY)
    assert sorted(frame["id"]) == list(range(2, 10)) and prior == 0.3
    assert T.sample(docs, labels, F.lit(False), "doc_id", "text", "lang", "toxic", TINY)[1] == 0.0


def test_many_languages(spark):
    """Languages too rare for a threshold share one profile; no number of languages is cut off."""
    common = [f"l{i:02}" for i in range(40)]
    rng, texts, langs, labels = np.random.default_rng(1), [], [], []
    for i in range(40 * 50 + 30):
        lang = common[i % 40] if i < 2000 else f"rare{i}"
        texts.append(" ".join(f"{lang}x{k}" for k in rng.integers(0, 9, 6)) + (" foul" if i // 40 % 2 else " fair"))
        langs.append(lang)
        labels.append(i // 40 % 2)
    s = T.Settings(slots=4096, dims=4, filters=3, epochs=4, language_slots=8192)
    net = T.train(texts, np.array(labels, dtype=np.float32), langs, 0.5, s)
    assert net.languages == common + [None]
    _, guesses = T.Scorer(net).logits(texts)
    assert guesses == [x if x in common else None for x in langs]


def test_threshold():
    p, y = np.array([0.1, 0.2, 0.7, 0.9]), np.array([0, 0, 1, 1])
    assert 0.2 < T.best_threshold(p, y, np.ones(4)) < 0.7


def test_held_out_accuracy(spark):
    from corpus_engine.llm.queries import op9_toxicity

    d = "/root/testdata/sf0.1"
    got = op9_toxicity(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").filter("held_out")
    rows = got.select("doc_id", "predicted", "toxic").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in rows)
    hit = sum(r.predicted and r.toxic for r in rows)
    assert hit / sum(r.toxic for r in rows) > 0.8 and hit / sum(r.predicted for r in rows) > 0.8


def test_learns_from_rows_beyond_the_sample(spark):
    """Words that no sampled row has are learned, in texts of any length, however the rows are dealt."""
    rng, rows, labels = np.random.default_rng(4), [], []
    foul = ["vile", "rotten", "wicked", "ghastly", "putrid", "sordid", "odious", "loathsome"]
    for i in range(1200):
        words = [f"w{k}" for k in rng.integers(0, 40, 5_000 if i % 300 == 1 else 12)]
        words.insert(3, foul[i // 2 % 8] if i % 2 else f"kind{i // 2 % 8}")
        rows.append((i, " ".join(words), ["en", "fr"][i // 20 % 2]))
        if i < 1000:
            labels.append((i, i % 2))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    few = T.Settings(slots=2048, dims=4, filters=4, rows_per_class=4, epochs=2, language_slots=64, learner_rows=300)
    nets = [T.fit(docs.repartition(parts), marks, F.lit(True), settings=few) for parts in (2, 7)]
    got = T.score_texts(docs.filter("doc_id >= 1000"), nets[0]).collect()
    assert np.mean([r.predicted == r.doc_id % 2 for r in got]) > 0.95
    assert np.array_equal(nets[0].embed, nets[1].embed) and nets[0].thresholds == nets[1].thresholds
    # every word of every labelled text is counted
    sums = np.exp(nets[0].profile.astype(float))
    want = sum(len(t.split()) + 2 for i, t, lang in rows if i < 1000 and lang == "en")
    assert nets[0].languages == ["en", "fr"]
    assert np.isclose(0.1 / sums[:, 0].min(), want + 0.1 * 64, rtol=0.001)
