import random

import numpy as np
import pytest

from corpus_engine.llm import suffix_array, suffix_dedup


@pytest.mark.parametrize("seed", range(6))
def test_suffix_array(seed):
    rng = np.random.default_rng(seed)
    for n in (1, 2, 3, 7, 60, 400):
        s = np.append(rng.integers(1, [2, 3, 5, 200][seed % 4], n), 0)
        want = sorted(range(len(s)), key=lambda i: s[i:].tolist())
        order = suffix_array.suffix_array(s)
        assert order.tolist() == want
        plcp = suffix_array.permuted_common_prefixes(s, order, 5)
        for a, b in zip(want, want[1:]):
            common = next((k for k in range(len(s)) if max(a, b) + k >= len(s) or s[a + k] != s[b + k]), len(s))
            assert plcp[b] == common


def brute(rows, length):
    """rows: (doc_id, text) with distinct (id, text), in order."""
    seen, out = set(), []
    for doc_id, text in rows:
        data = (text or "").encode()
        gone = np.zeros(len(data), dtype=bool)
        for i in range(len(data) - length + 1):
            w = data[i : i + length]
            if w in seen:
                gone[i : i + length] = True
            seen.add(w)
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((doc_id, np.frombuffer(data, np.uint8)[~gone].tobytes(), runs))
    return sorted(out, key=str)


def documents(seed, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abé ") for _ in range(rng.randint(2, 6)))
    passages = [" ".join(word() for _ in range(rng.randint(4, 40))) for _ in range(8)]
    rows = []
    for i in range(n):
        parts = [rng.choice(passages) if rng.random() < 0.5 else " ".join(word() for _ in range(rng.randint(1, 30))) for _ in range(4)]
        rows.append((i * 3, " ".join(parts)))
    rows += [(1, None), (2, ""), (4, "a" * 700), (5, "ab" * 300), (7, rows[3][1]), (8, rows[3][1]), (10, "short")]
    return rows


def run(spark, rows):
    df = spark.createDataFrame([(*r, 0, "x") for r in rows], "doc_id long, text string, tie int, kept string")
    got = suffix_dedup.remove_repeats(df).collect()
    assert all(r.tie == 0 for r in got)
    for r in got:
        data = (r.text or "").encode()
        stay = np.ones(len(data), dtype=bool)
        for span in r.removed:
            stay[span.begin : span.end] = False
        assert bytes(np.frombuffer(data, np.uint8)[stay]) == bytes(r.kept)
    return sorted(((r.doc_id, bytes(r.kept), len(r.removed)) for r in got), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_brute_force(spark, seed):
    rows = documents(seed)
    assert run(spark, rows) == brute(sorted(rows), 100)


def test_small_parts_give_the_same(spark, monkeypatch):
    for name, value in (("GROUP", 2), ("SHARD", 300), ("SLICE", 150), ("RUN", 7)):
        monkeypatch.setattr(suffix_dedup, name, value)
    rows = documents(3)
    df = spark.createDataFrame([], "doc_id long, text string")
    assert run(spark, rows) == brute(sorted(rows), 100)
    assert suffix_dedup.remove_repeats(df).collect() == []


def test_repeated_and_null_ids(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(5, long), (5, long), (5, long + " more"), (None, long)]
    got = run(spark, rows)
    assert got[0][0] == 5 and sum(r[1] == b"" for r in got if r[0] == 5) == 2
    assert [r for r in got if r[0] is None] == [(None, long.encode(), 0)]
    assert len(got) == 4
    apart = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(bytes(r.kept) for r in suffix_dedup.remove_repeats(apart).collect()) == sorted(r[1] for r in got)


@pytest.mark.parametrize(
    "text",
    ["a" * 300, "ab" * 150, "a" * 609, "-" * 120, "The sixty bytes of this line are not repeated within itself\n" * 4],
    ids=["one byte", "two bytes", "two runs", "rule", "line"],
)
def test_repeats_within_the_only_run(spark, text):
    """The text's windows have one key, and no other text has it."""
    rows = [(1, " ".join(f"w{i}" for i in range(60))), (2, text)]
    want = brute(rows, 100)
    assert want[1][2] == 1
    assert run(spark, rows) == want


@pytest.mark.parametrize("seed", range(4))
def test_runs_that_repeat_themselves(seed):
    rng = np.random.default_rng(seed)
    parts = [np.tile(rng.integers(97, 123, p), 400 // p + 1)[: rng.integers(90, 400)] for p in (1, 2, 7, 35, 60, 69, 90, 150, 240)]
    parts += [rng.integers(97, 123, n) for n in (150, 300)]
    data = np.concatenate([parts[i] for i in rng.permutation(len(parts))]).astype(np.uint8)
    for k in (suffix_dedup.COARSE, suffix_dedup.FINE):
        start, count, _, _, inner = suffix_dedup.runs(suffix_dedup.Rolling(), data, np.ones(len(data), bool), k, 100)
        windows = [[data[s + i : s + i + 100].tobytes() for i in range(c)] for s, c in zip(start, count)]
        assert inner.tolist() == [len(set(w)) < len(w) for w in windows]
        assert k == suffix_dedup.FINE or inner.any()
