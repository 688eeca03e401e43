import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from corpus_engine.llm import context_tree as C


def slow_model(texts):
    """Weights and estimates node by node, with exact sequential estimators."""
    data = [b" ".join(C.tokens(t)) + C.END for t in texts]
    counts = [{} for _ in range(C.DEPTH + 1)]
    for x in data:
        padded = C.END * C.DEPTH + x
        for i in range(C.DEPTH, len(padded)):
            for d in range(C.DEPTH + 1):
                node = 1
                for bit in range(7, -1, -1):
                    b = padded[i] >> bit & 1
                    counts[d].setdefault((padded[i - d : i], node), [0, 0])[b] += 1
                    node = node * 2 + b

    def kt(z, o):
        return sum(math.log(k + 0.5) for k in range(z)) + sum(math.log(k + 0.5) for k in range(o)) - math.lgamma(z + o + 1)

    stop, weighted = {}, {}
    for d in reversed(range(C.DEPTH + 1)):
        deeper = {}
        for ctx, node in counts[d + 1] if d < C.DEPTH else ():
            deeper.setdefault((ctx[1:], node), []).append(weighted[ctx, node])
        for (ctx, node), (z, o) in counts[d].items():
            own = kt(z, o)
            below = deeper.get((ctx, node), [])
            if not below:
                weighted[ctx, node], stop[ctx, node] = own, 1.0
            else:
                weighted[ctx, node] = math.log(0.5) + np.logaddexp(own, sum(below))
                stop[ctx, node] = math.exp(math.log(0.5) + own - weighted[ctx, node])

    def score(text):
        padded, total = C.END * C.DEPTH + b" ".join(C.tokens(text)) + C.END, 0.0
        for i in range(C.DEPTH, len(padded)):
            node = 1
            for bit in range(7, -1, -1):
                b = padded[i] >> bit & 1
                p, ahead, last = 0.0, 1.0, 0.5
                for d in range(C.DEPTH + 1):
                    key = (padded[i - d : i], node)
                    if key not in counts[d]:
                        break
                    z, o = counts[d][key]
                    last = (o + 0.5) / (z + o + 1)
                    p += ahead * stop[key] * last
                    ahead *= 1 - stop[key]
                p += ahead * last
                total += math.log10(p if b else 1 - p)
                node = node * 2 + b
        return total

    return score


ROWS = [(i, t, "x") for i, t in enumerate(
    [None, "", "The cat sat", "the  cat\nran", "éa b", "a", "the the THE", "b " * 50] + [
        " ".join(random.Random(s).choices(["the", "cat", "dog", "of", "x1"], k=9)) for s in range(20)])] + [(2, "The cat sat", "x"), (None, "zebra q", "x")]


def test_against_slow_version(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, score string")
    train = F.coalesce(F.col("doc_id"), F.lit(1)) % 3 != 1
    texts = [t for i, t, _ in ROWS if (1 if i is None else i) % 3 != 1]
    model = C.fit(df, train)
    slow, words = slow_model(texts), Counter()
    for t in texts:
        words.update(C.tokens(t) + [C.END])
    total, distinct = sum(words.values()), len(words)
    got = C.score_texts(df, model).collect()
    assert len(got) == len(ROWS)
    left = Counter((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in got)
    want = Counter()
    for i, t, _ in ROWS:
        own = C.tokens(t) + [C.END]
        base = sum(math.log10((words[w] + 1) / (total + distinct + 1)) for w in own)
        want[(str(i), len(own), sum(words[w] > 0 for w in own), round(base, 6), round(slow(t), 6))] += 1
    assert left == want
    assert {r.train_tokens for r in got} == {total}


def test_rare_tokens_by_join(spark, monkeypatch):
    """With a coarse share nearly all tokens take the join; the base score stays."""
    df = spark.createDataFrame(ROWS, "doc_id long, text string, score string").drop("score")
    rows = lambda: sorted((str(r.doc_id), r.n_known, round(r.base_score, 6)) for r in C.score_texts(df, C.fit(df, F.lit(True))).collect())
    want = rows()
    monkeypatch.setattr(C, "SHARE", 3)
    assert rows() == want


def test_rare_symbols_by_join(spark, monkeypatch):
    """Whatever is broadcast, all counts make the score; parts of the tree may be built one by one."""
    df = spark.createDataFrame(ROWS, "doc_id long, text string, score string").drop("score")
    train = F.coalesce(F.col("doc_id"), F.lit(1)) % 3 != 1
    slow = slow_model([t for i, t, _ in ROWS if (1 if i is None else i) % 3 != 1])
    want = sorted((str(i), round(slow(t), 6)) for i, t, _ in ROWS)
    for share, rows in ((3, 500_000), (40, 1), (1, 7)):
        monkeypatch.setattr(C, "SHARE", share)
        monkeypatch.setattr(C, "PART_ROWS", rows, raising=False)
        got = C.score_texts(df, C.fit(df, train)).collect()
        assert sorted((str(r.doc_id), round(r.score, 6)) for r in got) == want


def test_pieces_and_blocks(monkeypatch):
    """Texts are split and coded alike in pieces of any size."""
    texts = ["", "a", " Ab\tcd  e\r\n", "x" * 50, "the cat sat on the mat " * 9, "\x0b", "é \x1f\u00a0b"]
    def made():
        words = [Counter() for _ in texts]
        data = [C.coded(*pair) for pair in zip(texts, words)]
        codes, owner = (np.concatenate(x) for x in zip(*C.code_blocks(data)))
        return data, words, codes.tolist(), owner.tolist()

    want = made()
    assert want[0][2] == b"ab cd e\n" and want[1][4]["the".encode()] == 18
    padded = [C.END * C.DEPTH + x for x in want[0]]
    assert want[2] == [int.from_bytes(x[i : i + C.DEPTH + 1], "big") for x in padded for i in range(len(x) - C.DEPTH)]
    for size in (1, 3, 7, 40):
        monkeypatch.setattr(C, "PIECE", size)
        assert made() == want


def test_long_text_in_bounded_memory():
    """A text of 20 MB is split, counted and scored in blocks."""
    import tracemalloc

    text = "lorem ipsum dolor sit amet " * 750_000
    tracemalloc.start()
    words = Counter()
    data = C.coded(text, words)
    total, codes, times = C.TreeScorer(np.zeros(0, dtype=np.uint64), np.zeros(0), bits=8).scores([data])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(data) == len(text) and words[b"lorem"] == 750_000
    assert total.tolist() == [0] and times[0].sum() == len(data)
    assert peak < 10 * len(text)


def test_log_kt_table():
    """Counts on both sides of the table's end."""
    z = np.array([0, 1, 5, C.TABLE - 1, C.TABLE, 3, 1e6])
    o = np.array([0, 0, 2, 1, C.TABLE + 9, C.TABLE - 3, 7])
    want = [math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi) for a, b in zip(z, o)]
    assert np.allclose(C.log_kt(z, o), want, rtol=1e-9, atol=1e-7)


def test_log_gamma():
    x = np.array([0.5, 1, 1.5, 3, 7.9, 8, 100.5, 1e7])
    assert np.allclose(C.log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-9, atol=1e-8)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    model = C.fit(df, F.lit(True))
    assert C.score_texts(df, model).collect() == []
    other = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    row = C.score_texts(other, model).collect()[0]
    assert row.n_known == 0 and abs(row.score - 4 * 8 * math.log10(0.5)) < 1e-9
