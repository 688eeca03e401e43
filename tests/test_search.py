import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpus_engine.operators import keyword as K
from corpus_engine.operators import ranking as L
from corpus_engine.operators import search as S
from corpus_engine.operators import vector_index as V
from corpus_engine.runtime import scratch_path


def vectors(n, dim, seed):
    return np.random.default_rng(seed).normal(size=(n, dim)).astype(np.float32)


def frames(spark):
    # site 0 holds most chunks; one vector is zero, one is missing
    c, q = vectors(700, 8, 1), vectors(30, 8, 2)
    c[3] = 0
    chunks = [(f"c{i:04d}", 0 if i % 4 else 1, c[i].tolist() if i != 5 else []) for i in range(len(c))]
    queries = [(i, i % 2, q[i].tolist()) for i in range(len(q))]
    return (
        c, q, chunks, queries,
        spark.createDataFrame(queries, "query_id int, agent_id int, embedding array<float>"),
        spark.createDataFrame(chunks, "chunk_id string, agent_id int, embedding array<float>"),
    )


def brute(queries, chunks, threshold, k):
    want = {}
    for qid, site, qv in queries:
        scored = []
        for cid, s, cv in chunks:
            if s == site and cv and any(cv):
                a, b = np.array(qv, dtype=float), np.array(cv, dtype=float)
                sim = a @ b / (np.linalg.norm(a) * np.linalg.norm(b))
                if sim > threshold:
                    scored.append((-sim, cid))
        want[qid] = [cid for _, cid in sorted(scored)[:k]]
    return want


def test_vector_search_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(S, "QUERY_BLOCK", 4)
    monkeypatch.setattr(S, "CHUNK_BLOCK", 50)
    _, _, chunks, queries, qdf, cdf = frames(spark)
    got = {}
    for r in S.vector_search(qdf, cdf, 0.3, 5).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.chunk_id)
    assert got == {k: v for k, v in brute(queries, chunks, 0.3, 5).items() if v}


def test_ann_recall(spark):
    _, _, chunks, queries, qdf, cdf = frames(spark)
    got = {(r.query_id, r.chunk_id) for r in S.ann_search(qdf, cdf, 5, 0.3).collect()}
    want = {(q, c) for q, cs in brute(queries, chunks, 0.3, 5).items() for c in cs}
    assert len(got & want) / len(want) > 0.9
    blocks = S.ann_hits(qdf, cdf, 5).groupBy("query_id", "block").agg(F.first("compared").alias("n"))
    assert blocks.agg(F.sum("n")).first()[0] < 0.35 * sum(s == c[1] for _, s, _ in queries for c in chunks)


def texts(spark):
    rows = [
        (1, "a", "en", "The quick brown fox jumps over the lazy dog"),
        (2, "a", "en", "A brown and quick answer; quick, brown!"),
        (3, "a", "en", "Nothing to see but a fox"),
        (4, "b", "en", "quick brown fox elsewhere"),
    ]
    return spark.createDataFrame(rows, "chunk_id int, agent_id string, language string, content string")


def index(spark):
    return K.write_index(K.build_index(texts(spark)), scratch_path(spark, "index"))


def ask(spark, text):
    q = spark.createDataFrame([(1, "a", text)], "query_id int, agent_id string, query_text string")
    return sorted(r.chunk_id for r in K.keyword_match(q, index(spark)).collect())


def test_keyword_queries(spark):
    assert ask(spark, "quick brown") == [1, 2]
    assert ask(spark, '"quick brown"') == [1, 2]
    assert ask(spark, '"quick brown fox"') == [1]
    assert ask(spark, '"jumps over the lazy"') == [1]
    assert ask(spark, "brown -fox") == [2]
    assert ask(spark, "lazy OR nothing") == [1, 3]
    assert ask(spark, "the fox") == [1, 3]


def test_cover_density(spark):
    q = spark.createDataFrame([(1, "a", "quick brown fox")], "query_id int, agent_id string, query_text string")
    (row,) = K.keyword_rank(q, index(spark)).collect()
    assert (row.chunk_id, round(row.keyword_rank, 6)) == (1, 0.1)
    entries = [(1, 0), (4, 1), (5, 0), (9, 2), (10, 1)]
    df = spark.createDataFrame([(entries,)], "e array<struct<start: int, clause_no: int>>")
    # covers 4..9 (three hits, three words between) and 5..10 (three hits, three between)
    assert round(df.select(K.cover_density(F.col("e"))).first()[0], 6) == round(2 * 0.1 / 4, 6)


def test_rerank_and_citations(spark):
    hits = spark.createDataFrame(
        [(1, i, i, i) for i in range(8)] + [(2, i, i, i) for i in range(3)], "query_id int, orig int, chunk_id int, page_id int"
    )
    ranking = spark.createDataFrame([(1, [7, 2, 7, 50, -1]), (2, [2, 0])], "query_id int, indices array<int>")
    rows = L.rerank(hits, ranking, 6).orderBy("query_id", "rank").collect()
    assert [r.chunk_id for r in rows if r.query_id == 1] == [7, 2, 0, 1, 3, 4]
    assert [r.chunk_id for r in rows if r.query_id == 2] == [0, 1, 2]
    full = L.rerank(hits, ranking, 6).withColumn("snippet", F.lit("")).withColumn("content", F.lit("x" * 200))
    pages = spark.createDataFrame([(7, "u7", None), (3, "u3", "t3"), (4, "u4", "t4")], "page_id int, url string, title string")
    cited = L.citations(full, pages, 5, fallback=True).filter("query_id = 1").orderBy("rank").collect()
    assert [(r.url, r.title, len(r.snippet)) for r in cited] == [("u7", "u7", 153), ("u3", "t3", 153)]


def many_texts(spark):
    rng = np.random.default_rng(5)
    words, odds = np.array([f"w{i}" for i in range(30)]), 1 / np.arange(1, 31)
    rows = []
    for i in range(400):
        size = int(rng.choice([3, 10, 40, 200]))
        rows.append((i, "ab"[i % 3 == 0], "xx", " ".join(rng.choice(words, size, p=odds / odds.sum()))))
    rows += [(1000 + i, "a", "xx", "w3 w4 w3") for i in range(60)]  # equal ranks
    return spark.createDataFrame(rows, "chunk_id int, agent_id string, language string, content string")


ASKED = ["w3", "w3 w4", "w1 w2 w9", '"w3 w4" w5', "w7 OR w8 w9", "w2 -w3", "w20 w21 w22", "nowhere", "w1 nowhere", "-w1", "w4 w4"]


def test_keyword_top_equals_full_rank(spark, monkeypatch):
    monkeypatch.setattr(K, "BLOCKS", 2)
    monkeypatch.setattr(K, "RANK_ALL", 0)
    built = K.write_index(K.build_index(many_texts(spark), stop_words=False), scratch_path(spark, "index"))
    rows = [(f"{s}{i}", s, text) for s in "ab" for i, text in enumerate(ASKED)]
    q = spark.createDataFrame(rows, "query_id string, agent_id string, query_text string")
    full = {}
    for r in K.keyword_rank(q, built, stop_words=False).collect():
        full.setdefault(r.query_id, []).append((-round(r.keyword_rank, 9), r.chunk_id))
    for k, named in ((4, 2000), (15, 1)):
        monkeypatch.setattr(K, "NAMED_TERMS", named)
        got, ranked = {}, {}
        for r in K.keyword_top(q, built, k, stop_words=False).collect():
            got.setdefault(r.query_id, []).append((-round(r.keyword_rank, 9), r.chunk_id))
            ranked[r.query_id] = r.ranked
        assert {i: sorted(v) for i, v in got.items()} == {i: sorted(v)[:k] for i, v in full.items()}
        assert all(n <= len(full[i]) for i, n in ranked.items())
    # one word: its counts are its ranks, so few chunks of many are looked at
    assert ranked["a0"] < len(full["a0"])
    monkeypatch.setattr(K, "RANK_ALL", 1 << 40)
    once = {}
    for r in K.keyword_top(q, built, 15, stop_words=False).collect():
        once.setdefault(r.query_id, []).append((-round(r.keyword_rank, 9), r.chunk_id))
    assert {i: sorted(v) for i, v in once.items()} == {i: sorted(v)[:15] for i, v in full.items()}


def test_rank_bound_holds(spark):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(300):
        n = int(rng.integers(1, 5))
        found = sorted((int(p), int(rng.integers(0, n))) for p in rng.integers(0, 40, int(rng.integers(n, 25))))
        counts = [sum(c == j for _, c in found) for j in range(n)]
        if min(counts):
            rows.append((i, sorted(set(found)), n, min(sum(c == j for _, c in set(found)) for j in range(n))))
    df = spark.createDataFrame(rows, "i int, e array<struct<start: int, clause_no: int>>, n int, least int")
    over = df.withColumn("score", K.cover_density(F.col("e"))).filter(F.col("score") > K.rank_bound(F.col("n"), F.col("least")))
    assert over.count() == 0


def test_index_follows_its_table(spark):
    from corpus_engine.registry.search_queries import index as stored

    folder = scratch_path(spark, "docs")
    rows = [(1, "one two", "en"), (2, "two three", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    docs.write.parquet(f"{folder}/documents.parquet")
    assert stored(spark, folder) is stored(spark, folder)
    assert stored(spark, folder).postings.count() == 4
    docs.limit(1).write.mode("append").parquet(f"{folder}/documents.parquet")
    assert stored(spark, folder).postings.filter("term = 'one'").count() == 1
    docs.withColumn("doc_id", F.col("doc_id") + 5).write.mode("append").parquet(f"{folder}/documents.parquet")
    assert stored(spark, folder).postings.filter("term = 'three'").count() == 2


def clustered(n, dim, groups, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dim)) * 3
    own = rng.integers(0, groups, n)
    own[: n // 3] = 0  # a third of all rows in one cluster
    return (centres[own] + rng.normal(size=(n, dim)) * 0.6).astype(np.float32), centres


def recall(found, exact):
    both = sum(len(set(found.get(q, [])) & set(ids)) for q, ids in exact.items())
    return both / sum(map(len, exact.values()))


def by_query(rows):
    out = {}
    for r in rows:
        out.setdefault(r.query_id, []).append(r.chunk_id)
    return out


@pytest.mark.parametrize("structure", [True, False])
def test_stored_vector_index(spark, structure):
    c, centres = clustered(3000, 24, 16, 3)
    if not structure:
        c = vectors(3000, 24, 3)
    q = (centres[np.arange(40) % 16] + np.random.default_rng(4).normal(size=(40, 24)) * 0.6) if structure else vectors(40, 24, 9)
    rows = [(f"c{i:04d}", i % 2, v.tolist()) for i, v in enumerate(c)] + [("none", 0, None), ("zero", 0, [0.0] * 24), ("short", 1, [1.0])]
    chunks = spark.createDataFrame(rows, "chunk_id string, agent_id int, embedding array<float>")
    asked = spark.createDataFrame([(i, i % 2, v.tolist()) for i, v in enumerate(q)], "query_id int, agent_id int, embedding array<float>")
    book = V.fit_codebook(chunks, cells=16, parts=8, sample=1500)
    path = scratch_path(spark, "vectors")
    V.write_index(chunks, book, path)
    assert spark.read.parquet(f"{path}/codes").count() == 3000  # every vector of the dimension is indexed
    probes = 3 if structure else 16
    found = V.index_search(asked, path, book, 10, -1.0, probes=probes, candidates=120)
    exact = by_query(S.vector_search(asked, chunks, -1.0, 10).collect())
    got = found.collect()
    assert recall(by_query(got), exact) >= 0.9
    sims = {(r.query_id, r.chunk_id): r.similarity for r in S.vector_search(asked, chunks, -1.0, 3000).collect()}
    assert all(abs(sims[r.query_id, r.chunk_id] - r.similarity) < 1e-6 for r in got)  # re-ranked exactly
    read, stored = V.read_share(path, asked, book, probes).first()
    assert read < 0.5 * stored if structure else read == stored
    one = asked.filter("query_id = 1")
    cells = spark.read.parquet(f"{path}/codes").select("cell").distinct().count()
    assert V.read_share(path, one, book, 1).first()[0] < 3000 and cells > 8


def test_vector_index_without_vectors(spark):
    empty = spark.createDataFrame([("a", 0, None)], "chunk_id string, agent_id int, embedding array<float>")
    with pytest.raises(ValueError):
        V.fit_codebook(empty)


def test_postings_combine_within_rows(spark):
    """Equal, null and repeated ids; nothing is moved where each row has its own id."""
    rows = [(1, "b a B, c a"), (2, "a"), (2, "x a a"), (None, "n"), (None, "m n"), (3, None), (4, ""), (5, " - "), (6, "é É")]
    schema = "chunk_id long, content string"
    want = {}
    for i, text in rows:
        for pos, word in enumerate(re.findall(r"\w+", (text or "").lower()), 1):
            want.setdefault((i, word), []).append(pos)
    got = K.postings(spark.createDataFrame(rows, schema), stop_words=False).collect()
    assert {(r.chunk_id, r.term): r.positions for r in got} == {k: sorted(v) for k, v in want.items()} and len(got) == len(want)
    single = K.postings(spark.createDataFrame([rows[0], rows[1]], schema), stop_words=False)
    assert single.count() == 4
    assert "Exchange" not in single._jdf.queryExecution().executedPlan().toString()


def test_index_takes_texts_apart_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    docs = texts(spark).mapInPandas(counted, texts(spark).schema)
    built = K.write_index(K.build_index(docs, stop_words=False), scratch_path(spark, "index"))
    assert seen.value == 2 * 4  # equal ids are looked for first, and nothing is sampled
    assert built.blocks.agg(F.sum("chunks")).first()[0] == built.postings.count()


def test_matches_are_not_moved(spark):
    built = K.write_index(K.build_index(many_texts(spark), stop_words=False), scratch_path(spark, "index"))
    rows = [(f"{s}{i}", s, text) for s in "ab" for i, text in enumerate(ASKED)]
    q = spark.createDataFrame(rows, "query_id string, agent_id string, query_text string")
    for found in (K.keyword_match(q, built, stop_words=False), K.keyword_rank(q, built, stop_words=False)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(chunk_id" in plan and "hashpartitioning(query_id" not in plan


def test_keyword_forms_equal_brute_force(spark):
    rows = [(r.chunk_id, r.agent_id, r.content.split()) for r in many_texts(spark).collect()]
    has = {
        "w3 w4": lambda t: {"w3", "w4"} <= set(t),
        '"w3 w4" w5': lambda t: "w5" in t and ("w3", "w4") in zip(t, t[1:]),
        "w3 OR w3 w9": lambda t: "w3" in t,
        "w7 OR w8 w9": lambda t: "w7" in t or {"w8", "w9"} <= set(t),
        'w2 -"w3 w4"': lambda t: "w2" in t and ("w3", "w4") not in zip(t, t[1:]),
        "w1 -w2 OR w20": lambda t: "w1" in t and "w2" not in t or "w20" in t,
    }
    built = K.write_index(K.build_index(many_texts(spark), stop_words=False), scratch_path(spark, "index"))
    q = spark.createDataFrame([(x, "a", x) for x in has] * 2, "query_id string, agent_id string, query_text string")
    got = sorted((r.query_id, r.chunk_id) for r in K.keyword_match(q, built, stop_words=False).collect())
    assert got == sorted((x, i) for x, test in has.items() for i, site, t in rows if site == "a" and test(t))
