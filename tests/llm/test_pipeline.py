"""The pipeline against brute force, stage by stage, on a small table."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from corpus_engine.llm import toxicity
from tests.llm.test_decontamination import brute as brute_hits
from tests.llm.test_ngram_join import brute as brute_classes
from tests.llm.test_suffix_dedup import brute as brute_cut

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def texts():
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgé") for _ in range(rng.randint(2, 7)))
    question = " ".join(word() for _ in range(20))
    shared = " ".join(word() for _ in range(40))
    out = []
    for i in range(60):
        parts = [word() for _ in range(rng.randint(10, 90))]
        if i % 7 == 1:
            parts += shared.split()
        if i % 11 == 2:
            parts += question.split()
        if i % 2:
            parts.insert(rng.randrange(len(parts)), "vile")
        out.append((i, " ".join(parts)))
    out += [(100 + i, out[i][1] + (" more" if i % 3 else "")) for i in range(0, 40, 4)]
    return [*out, (200, None), (201, ""), (None, out[2][1]), (None, "alone in here"), (0, out[0][1])], question


@pytest.fixture(scope="module")
def case(spark, tmp_path_factory):
    rows, question = texts()
    d = str(tmp_path_factory.mktemp("sf"))
    full = [(i, t, "en", "s", len(t or "")) for i, t in rows]
    spark.createDataFrame(full, COLUMNS).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, question)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    labels = [(i, i % 2) for i in range(0, 60)]
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{d}/labels.parquet")
    return d, rows, question


def read(df):
    assert df.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    got = df.collect()
    assert all(r.n_chars == len(r.text or "") for r in got)
    return sorted(((r.doc_id, r.text) for r in got), key=str)


def test_stages(spark, case):
    d, rows, question = case
    docs = spark.read.parquet(f"{d}/documents.parquet")

    clean = P.drop_toxic(spark, docs, d)
    labels = spark.read.parquet(f"{d}/labels.parquet")
    network = toxicity.fit(docs, labels, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    flags = toxicity.score_texts(docs, network).collect()
    assert read(clean) == sorted(((r.doc_id, r.text) for r in flags if not r.predicted), key=str)
    vile = sum("vile" in (t or "").split() for _, t in read(clean))
    assert vile <= 4

    near = read(P.keep_one_of_each_class(spark, docs, d))
    classes = {}
    for doc_id, class_id, n in brute_classes(rows):
        classes.setdefault((class_id if n else ("alone", doc_id)), 0)
    assert len(near) == len(set(classes)) + 0
    assert len({t for _, t in near if t}) == len([t for _, t in near if t])

    cut = read(P.cut_repeats(spark, docs, d))
    order = sorted({r for r in rows}, key=lambda r: (r[0] is not None, r[0] or 0))
    want = {(i, k.decode("utf-8", "replace")) for i, k, _ in brute_cut(order, 100)}
    assert {(i, t or "") for i, t in cut} == want and len(cut) == len(rows)

    safe = read(P.drop_contaminated(spark, docs, d))
    bad = brute_hits(rows, [(1, question)])
    assert len(safe) == sum(not b[4] for b in bad)
    assert not {t for _, t in safe if t and question in t and 20 * 20 >= len(t.split())}


def test_run(spark, case):
    d, rows, _ = case
    got = P.run(spark, d)
    assert 5 < got.count() < len(rows)
    assert [n for n, _ in P.STAGES] == [
        "toxicity", "ngram_jaccard_join", "suffix_array_dedup", "benchmark_decontamination", "byte_bpe"]
    r = got.first()
    assert len(r.token_ids) == 4 * r.n_tokens


def test_empty(spark, case):
    d, _, _ = case
    docs = spark.read.parquet(f"{d}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, docs, d).collect() == []
