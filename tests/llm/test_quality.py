import random
import re

import numpy as np

from corpus_engine.llm import quality as Q


def slow_statistics(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    hit = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""),
            sum(x in lines[:i] for i, x in enumerate(lines)), len(hit))


def test_statistics():
    rng = random.Random(2)
    texts = [None, "", " \n\t", "a b c a b c", "a b c\x1cd", "x | y <z>\nx | y <z>\n\n \n", "é" * 5000]
    texts += [" ".join(rng.choice("ab#\n") for _ in range(rng.randint(1, 60))) for _ in range(60)]
    for t in texts:
        assert Q.text_statistics(t) == slow_statistics(t), repr(t)


def slow_kept(rows):
    """The same estimates with numpy, all values at once."""
    stats = [slow_statistics(r[1]) for r in rows]
    x = np.array([[np.log(max(n, 1)), c / max(n, 1), np.log1p(100 * s / max(c, 1)), np.log1p(100 * d / max(n, 1)),
                   np.log1p(100 * p / max(n, 1))] for n, c, s, d, p in stats])
    failed = np.array([n < 50 or 100 * p > 50 * n for n, _, _, _, p in stats])

    def cut(v, q):
        return np.sort(v)[max(int(np.ceil(q * len(v))) - 1, 0)]

    def scatter(v):
        cov = np.cov(v.T, bias=True)
        cov += np.diag(np.maximum(np.square(Q.FLOOR) - np.diag(cov), 0))
        return v.mean(0), cov

    def fit(v):
        m = np.array([cut(c, 0.5) for c in v.T])
        sd = np.maximum(1.4826 * np.array([cut(c, 0.5) for c in np.abs(v - m).T]), Q.FLOOR)
        out = []
        for mean, cov in ((m, np.diag(sd**2)), scatter(v)):
            size, fell = np.inf, np.inf
            while fell > Q.GAIN:
                d = np.einsum("ij,jk,ik->i", v - mean, np.linalg.inv(cov), v - mean)
                after = scatter(v[d <= cut(d, Q.COVER)])
                fell = size - np.linalg.slogdet(after[1])[1]
                if fell >= 0:
                    (mean, cov), size = after, np.linalg.slogdet(after[1])[1]
            out.append((size, len(out), mean, np.linalg.inv(cov)))
        _, _, mean, prec = min(out, key=lambda e: e[:2])
        d = np.einsum("ij,jk,ik->i", v - mean, prec, v - mean)
        return mean, prec, max(cut(d, 0.5) / Q.CHI_MEDIAN, 1.0)

    kept = []
    keys = [[(r[2], r[3]), r[2], "all"] for r in rows]
    for i in range(len(rows)):
        for level in range(3):
            own = np.array([k[level] == keys[i][level] for k in keys]) & ~failed
            if own.sum() >= Q.LEAST or level == 2:
                break
        if failed[i]:
            kept.append(False)
            continue
        mean, prec, scale = fit(x[own])
        kept.append(bool((x[i] - mean) @ prec @ (x[i] - mean) / scale <= Q.CHI_FAR))
    return kept


def documents():
    rng, rows = random.Random(4), []
    for i in range(330):
        n = int(np.exp(rng.gauss(5, 0.5))) + 20
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9))) for _ in range(n)]
        if i % 55 == 7:
            words = [w + "|*#$%" * 4 for w in words]
        rows.append((i, " ".join(words), ["en", "fr", None][i % 3 % 2 if i < 300 else 2], ["a", "b"][i % 2], 1))
    rows += [(1, rows[1][1], "en", "a", 1), (None, None, None, None, 1), (900, "", "en", "a", 1), (901, "a b c " * 50, "en", None, 1)]
    return rows


def test_against_numpy(spark):
    rows = documents()
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, kept int")
    want = slow_kept(rows)
    got = sorted(((str(r.doc_id), r.n_words, r.n_symbols, r.kept) for r in Q.judge(df).collect()))
    stats = [slow_statistics(r[1]) for r in rows]
    assert got == sorted((str(r[0]), s[0], s[2], k) for r, s, k in zip(rows, stats, want))
    assert 0 < sum(not k for k, r in zip(want, rows) if r[1] and len(r[1].split()) >= 50) < 12


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert Q.judge(df).collect() == []


def test_concentration_goes_on_until_it_is_stable(spark):
    """A start far from the dense part takes more than three steps; the last step changes nothing."""
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(0, 1, (500, Q.SIZE)), rng.normal(4, 3, (300, Q.SIZE))])
    rows = spark.createDataFrame([("g", v) for v in x.tolist()], "grp string, x array<double>")
    got = Q.robust_estimates(rows).first()
    mean, precision = np.array(got.mean), np.array(got.precision).reshape(Q.SIZE, Q.SIZE)
    d = np.einsum("ij,jk,ik->i", x - mean, precision, x - mean)
    near = x[d <= np.sort(d)[int(np.ceil(Q.COVER * len(x))) - 1]]
    again = np.linalg.slogdet(np.cov(near.T, bias=True))[1]
    assert -np.linalg.slogdet(precision)[1] - again <= Q.GAIN
