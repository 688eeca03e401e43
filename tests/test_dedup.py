import random

from corpus_engine.operators import dedup as D


def test_near_boilerplate_equals_brute_force(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(60)]
    base = [[rng.choice(vocabulary) for _ in range(rng.randrange(8, 60))] for _ in range(6)]
    rows = []
    for i, words in enumerate(base):
        rows += [(" ".join(words), f"p{p}") for p in range(3 + i % 2)]
        for _ in range(12):
            other = list(words)
            for _ in range(rng.randrange(0, 4)):
                other[rng.randrange(len(other))] = rng.choice(vocabulary)
            rows.append((" ".join(other).upper(), f"q{rng.randrange(2)}"))
    rows += [("Hi there", f"p{p}") for p in range(3)] + [("ok", "p1"), ("  bye   now ", "p9")]
    # one text makes up a third of all rows
    rows += [(" ".join(base[0]), "p0")] * (len(rows) // 2)

    def norm(t):
        return " ".join(t.lower().split())

    pages = {}
    for t, p in rows:
        pages.setdefault(norm(t), set()).add(p)

    def grams(t):
        w = t.split()
        return {tuple(w[i : i + 3]) for i in range(len(w) - 2)}

    def alike(a, b):
        a, b = grams(a), grams(b)
        return 1.0 if not a and not b else len(a & b) / len(a | b)

    common = [t for t, p in pages.items() if len(p) >= 3]
    want = {t for t, p in pages.items() if len(p) < 3 and any(alike(t, c) >= 0.85 for c in common)}
    df = spark.createDataFrame(rows, "content string, page_url string")
    hashes = {r.hash for r in D.near_boilerplate(df).collect()}
    import hashlib

    assert hashes == {hashlib.md5(t.encode()).hexdigest() for t in want} and want
    kept = D.remove_boilerplate(df, D.boilerplate_hashes(df)).collect()
    assert {norm(r.content) for r in kept} == set(pages) - set(common) - want


def test_near_boilerplate_of_long_texts_sends_no_sets_around(spark):
    """A prefix row that held its whole set would make the sent table count a text's length by its square."""
    long = [f"w{i}" for i in range(12_000)]
    rows = [(" ".join(long), f"p{p}") for p in range(3)]
    rows += [(" ".join([*long[:at], "x", *long[at + 1 :]]), "q") for at in (9, 3_000)] + [(" ".join(long[:6_000]), "q")]
    df = spark.createDataFrame(rows, "content string, page_url string")
    limit = "spark.sql.maxBroadcastTableSize"
    spark.conf.set(limit, str(100 << 20))
    try:
        assert D.near_boilerplate(df).count() == 2
    finally:
        spark.conf.unset(limit)


def test_near_boilerplate_looks_beyond_the_first_sets(spark):
    """A text near the last of many sets that share its rarest shingles is found."""
    shared = [f"s{i}" for i in range(12)]
    sets = [shared + [f"t{k}x{i}" for i in range(28)] for k in range(2 * D.FIRST_SETS)]
    rows = [(" ".join(words), f"p{p}") for words in sets for p in range(3)]
    rows += [(" ".join([*words[:-1], "other"]), "q") for words in sets]
    df = spark.createDataFrame(rows, "content string, page_url string")
    assert D.near_boilerplate(df).count() == len(sets)
