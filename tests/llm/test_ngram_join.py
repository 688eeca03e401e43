import random
import re

import pytest

from corpus_engine.llm import ngram_join as N


def sets_of(texts, n=5):
    out = []
    for t in texts:
        w = re.findall(r"\w+", (t or "").lower())
        out.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    return out


def brute(rows):
    sets = sets_of([t for _, t in rows])
    near = [[j for j in range(len(rows)) if j != i and s and len(s & sets[j]) >= 0.8 * len(s | sets[j]) - 1e-9]
            for i, s in enumerate(sets)]
    label = list(range(len(rows)))
    for _ in rows:
        label = [min([label[i], *(label[j] for j in near[i])]) for i in range(len(rows))]
    out = []
    for i, (doc_id, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if label[j] == label[i] and rows[j][0] is not None]
        out.append((doc_id, min(ids, default=None), len(near[i])))
    return sorted(out, key=str)


def documents(seed=1, groups=12, members=9):
    rng, rows = random.Random(seed), []
    for g in range(groups):
        base = [f"g{g}w{rng.randrange(60)}" for _ in range(rng.randint(3, 120))]
        for _ in range(rng.randint(1, members)):
            words = list(base)
            for _ in range(rng.randint(0, max(1, len(words) // 40))):
                words[rng.randrange(len(words))] = f"x{rng.randrange(999)}"
            rows.append((len(rows) + 10, " ".join(words)))
    rows += [(1, None), (2, ""), (3, "!!"), (None, rows[0][1]), (4, rows[0][1].upper()), (4, rows[0][1]), (5, "one two"), (6, "One, two")]
    rows += [(None, "alone here"), (None, None)]
    return rows


def run(spark, rows):
    df = spark.createDataFrame([(*r, b"x", 1) for r in rows], "doc_id long, text string, node binary, copies int")
    return sorted(((r.doc_id, r.class_id, r.n_links) for r in N.near_copies(df).collect()), key=str)


def test_brute_force(spark):
    rows = documents()
    assert run(spark, rows) == brute(rows)


def test_blocks_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(N, "BUCKET_PAIRS", 2)
    monkeypatch.setattr(N, "BLOCK_NODES", 3)
    rows = documents(2, 8, 14)
    assert run(spark, rows) == brute(rows)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert N.near_copies(df).collect() == []


@pytest.mark.parametrize("recall", [0.9, 0.99, 0.999])
def test_bands(recall):
    bands, rows = N.bands_for(0.8, recall)
    assert 1 - (1 - 0.8**rows) ** bands >= recall and bands * rows <= 128


def test_recall_out_of_reach():
    with pytest.raises(ValueError):
        N.bands_for(0.05, 0.999)
