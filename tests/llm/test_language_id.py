import zlib

import numpy as np
from pyspark.sql import functions as F

from corpus_engine.llm import language_id as L
from corpus_engine.llm.queries import PIECES

ROWS = [(i, t, lang, "x") for i, (t, lang) in enumerate([
    ("the cat and the dog, the house", "en"), ("le chat et le chien dans la maison", "fr"), ("THE END of the day", "en"),
    ("la fin de la nuit", "fr"), ("nothing", None), (None, "fr"), ("", "en"), ("12 ... 3", "en"), ("Łódź 中文", "en"),
    ("a" * 300, "en")] * 3)] + [(None, "the", "en", "x")]


def model(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, made string")
    return docs, L.fit(docs, F.lit(True), PIECES, sample_rows=40)


def slow_score(m, word, lang):
    """Sum over all segmentations, by recursion from the left."""
    word, total = L.SPACE + word, [0.0]
    for j in range(1, len(word) + 1):
        terms = [total[i] + m.logp[m.pieces[word[i:j]], lang] for i in range(j) if word[i:j] in m.pieces]
        if word[j - 1] not in m.pieces:
            terms.append(total[j - 1] + L.UNKNOWN)
        total.append(np.logaddexp.reduce(terms) if terms else -np.inf)
    return total[-1]


def test_forward_sum_and_table(spark):
    docs, m = model(spark)
    words = ["the", "chat", "łódź", "中文", "a" * 40, "x"]
    got = m.word_scores(words)
    want = [[slow_score(m, w, k) for k in range(len(m.languages))] for w in words]
    assert np.allclose(got, want)
    assert np.allclose(np.exp(m.logp[:-1]).sum(0), 1)

    rows = L.identify(docs, m).collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        assert 0 <= r.score <= 1 and r.made == "x"
        if not L.letters(r.text or ""):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        elif "le " in r.text or "la " in r.text or "the" in r.text.lower():
            assert r.lang_pred == ("fr" if "la " in r.text else "en")
    few = L.Identifier(m, remember=1)
    assert few.predict([r.text for r in rows])[0] == [r.lang_pred for r in rows]


def test_nothing_to_learn(spark):
    docs, m = model(spark)
    assert L.fit(docs.limit(0), F.lit(True), PIECES) is None
    assert {r.lang_pred for r in L.identify(docs, None).collect()} == {"und"}
    assert L.identify(docs.limit(0), m).collect() == []


def test_held_out_accuracy(spark):
    from corpus_engine.llm.queries import op4_language_id

    d = "/root/testdata/sf0.01"
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang").collect()}
    rows = op4_language_id(spark, d).collect()
    assert len(rows) == len(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) / len(held) > 0.97


def test_every_language_is_learned(spark):
    """However many languages there are, and even if a language has only long texts."""
    rows = [(f"l{i:03}", f"word{i} and more of it {k}") for i in range(230) for k in range(1 + (i < 200))]
    rows += [("long", "ein langer satz " * n) for n in (20, 30, 500)] + [("l000", "another text " * 20)]
    docs = spark.createDataFrame(rows, "lang string, text string")
    model = L.fit(docs, F.lit(True), PIECES, row_chars=100)
    assert sorted(model.languages) == sorted({r[0] for r in rows})
