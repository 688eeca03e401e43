import math
import random
import re

import pytest

from corpus_engine.llm import lexical_search as ls
from tests.llm.helpers import against_sql


def split(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)


def brute(docs, items, k=20):
    words = [(i, w) for i, w in ((i, split(t)) for i, t in docs) if w]
    n, total = len(words), sum(len(w) for _, w in words)
    df = {}
    for _, w in words:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    questions = {}
    for item, text in items:
        questions.setdefault(item, []).extend(split(text))
    out = []
    for item, terms in questions.items():
        found = []
        for doc, w in words:
            m = 75 + 25 * len(w) * n // total
            score = 0
            for t in terms:
                tf = w.count(t)
                if tf:
                    weight = math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))
                    score += weight * (1_000_000_000 * tf // (1000 * tf + 12 * m))
            if score:
                found.append((-score, doc is None, doc, score))
        found.sort(key=lambda f: (f[0], f[1], f[2] or 0))
        out += [(item, r, f[2], f[3]) for r, f in enumerate(found[:k], 1)]
    return sorted(out, key=str)


def rows(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=str)


def corpus(seed, n=300):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["É", "the", "The", "a1"]
    odds = [1 / (i + 1) for i in range(len(vocabulary))]
    docs = [(i, " ".join(rng.choices(vocabulary, odds, k=rng.choice([3, 8, 8, 40, 150])))) for i in range(n)]
    docs += [(i + 1000, docs[i % 3][1]) for i in range(80)]  # many equal scores
    docs += [(1, "w1 w2"), (1, "w1 w2"), (1, "w1 w2 w3"), (None, "w5, w5!"), (None, "w5"), (2000, None), (2001, ""), (2002, "!?")]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(1, 12)))) for i in range(30)]
    items += [(40, "THE the w5"), (40, "w7"), (None, "w5"), (41, None), (42, "nowhere"), (43, "--")]
    return docs, items


@pytest.mark.parametrize("k, piece_docs, block", [(20, 1024, 256), (3, 7, 8)])
def test_against_brute_force(spark, monkeypatch, k, piece_docs, block):
    monkeypatch.setattr(ls, "BLOCK_ITEMS", block)
    docs, items = corpus(k)
    d = spark.createDataFrame([(*r, 1, "m") for r in docs], "doc_id long, text string, m int, term string")
    q = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, w int")
    assert rows(ls.search(ls.build_index(d, piece_docs=piece_docs), q, k=k)) == brute(docs, items, k)


def test_bounds_rule_out_strata(spark):
    # one long list of short documents that hold the whole query, and long ones that hold a word of it
    docs = [(i, "alpha beta gamma") for i in range(40)] + [(100 + i, "alpha " + f"x{i} " * (50 + i)) for i in range(60)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    q = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    index = ls.build_index(d)
    assert rows(ls.search(index, q)) == brute(docs, [(1, "alpha beta gamma")])
    own = ls.Weights({"alpha": 0, "beta": 1, "gamma": 2}, __import__("numpy").ones((1, 3)))
    assert own.exact()


def test_inexact_doubles(spark, monkeypatch):
    monkeypatch.setattr(ls, "EXACT", 1)  # takes the path of whole numbers
    docs, items = corpus(9, 60)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    q = spark.createDataFrame(items, "item_id long, text string")
    assert rows(ls.search(ls.build_index(d), q)) == brute(docs, items)


def test_empty_and_text_ids(spark):
    d = spark.createDataFrame([("b", "x y"), ("a", "x y"), ("c", "x " * 3_000_000)], "`doc.id` string, body string")
    q = spark.createDataFrame([("q", "x")], "`item.id` string, body string")
    index = ls.build_index(d, "doc.id", "body")
    found = ls.search(index, q, "item.id", "body")
    assert [r.doc_id for r in found.orderBy("rank").collect()] == ["c", "a", "b"]
    assert ls.search(index, q.limit(0), "item.id", "body").collect() == []
    assert ls.search(ls.build_index(d.limit(0), "doc.id", "body"), q, "item.id", "body").collect() == []


def test_against_sql(spark):
    against_sql(spark, "op13_lexical_search")
