import re

from corpus_engine.llm.decontamination import decontaminate
from tests.llm.helpers import against_sql


def brute(docs, bench, window=13):
    def split(t):
        t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)

    out = []
    for doc_id, text in docs:
        w, hit, items = split(text), set(), set()
        for item, question in bench:
            q = split(question)
            n = min(window, len(q))
            for i in range(len(q) - n + 1 if n else 0):
                for j in range(len(w) - n + 1):
                    if w[j : j + n] == q[i : i + n]:
                        hit |= set(range(j, j + n))
                        items.add("" if item is None else str(item))
        out.append((doc_id, len(w), len(hit), sorted(items), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


LONG = " ".join(f"w{i % 97}" for i in range(600))
BENCH = [(1, " ".join(f"W{i}" for i in range(3, 20))), (2, "short Item"), (2, "short item"), (None, "éa, b"), (3, None),
         (4, "!!"), (10, " ".join(f"w{i}" for i in range(3, 16)))]
DOCS = [(1, LONG), (1, LONG), (2, None), (3, ""), (None, "x short-item y"), (None, None), (5, "A short item éa b"),
        (1, "another short, item of one id"), (6, "nothing"), (7, "short " * 300 + "item " + "x " * 50)]


def rows(df):
    return sorted(((r.doc_id, r.n_words, r.n_hit, list(r["items"]), r.contaminated) for r in df.collect()), key=str)


def test_brute_force(spark):
    docs = spark.createDataFrame([(*d, 1, 2) for d in DOCS], "doc_id long, text string, w int, items int")
    bench = spark.createDataFrame([(*b, 0) for b in BENCH], "item_id long, text string, window int")
    want = brute(DOCS, BENCH)
    assert rows(decontaminate(docs, bench)) == want
    assert rows(decontaminate(docs, bench, broadcast_bytes=500)) == want


def test_empty_tables(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    assert all(r[2] == 0 and r[3] == [] for r in rows(decontaminate(docs, bench.limit(0))))
    assert rows(decontaminate(docs.limit(0), bench)) == []


def test_against_sql(spark):
    against_sql(spark, "op7_decontamination")
