"""Token counts and byte-level encoding against the public libraries."""

import base64
import hashlib

import numpy as np
import public_tokenizers as P
import pytest

from corpus_engine.llm import byte_bpe, token_counts
from corpus_engine.llm.queries import BYTE_RANKS, PIECES

TEXTS = [
    None, "", " ", "a", "  two  spaces ", "café é 中文\U0001f600 end", "<s>x</s> <0x41> ▁a\tb\n\n c",
    "it's we'll  I'd 12 345 ... !!\r\n x", "word " * 400, "a" * 3000, "ab " * 10 + " " * 700 + "z" * 900, "\u0000　x",
]


def frame(spark, texts=TEXTS):
    rows = [(i, t, "clash", i) for i, t in enumerate(texts)] + [(None, "a b", "clash", 1), (0, None, "clash", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, made string, n_tokens int")


def test_counts_by_windows(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = token_counts.count_tokens(frame(spark), PIECES, window_chars=40, overlap_chars=4).collect()
    assert len(got) == len(TEXTS) + 2
    for row in got:
        assert row.n_tokens == len(sp.encode(row.text or "")), row
        assert row.n_bytes == len((row.text or "").encode())
        assert row.made == "clash"


def test_windows_of_documents(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    got = token_counts.count_tokens(docs, PIECES, window_chars=500, overlap_chars=16).collect()
    assert all(r.n_tokens == len(sp.encode(r.text)) for r in got) and len(got) == docs.count()


def test_empty_table(spark):
    empty = frame(spark).limit(0)
    assert token_counts.count_tokens(empty, PIECES).collect() == []
    assert byte_bpe.encode_texts(empty, BYTE_RANKS, P.PATTERN).collect() == []


@pytest.fixture(scope="module")
def library():
    import tiktoken

    with open(BYTE_RANKS, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bytes_against_library(spark, library):
    docs = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    coded = byte_bpe.encode_texts(frame(spark, TEXTS + docs), BYTE_RANKS, P.PATTERN)
    coded = byte_bpe.decode_ids(coded, BYTE_RANKS, P.PATTERN).withColumn("ids", byte_bpe.unpack_ids(coded.token_ids))
    rows = coded.collect()
    assert len(rows) == len(TEXTS) + len(docs) + 2
    for r in rows:
        want = library.encode_ordinary(r.text or "")
        assert r.ids == want and r.n_tokens == len(want)
        assert bytes(r.decoded) == (r.text or "").encode()
        assert hashlib.sha256(bytes(r.token_ids)).digest() == hashlib.sha256(np.array(want, "<u4").tobytes()).digest()


def test_blocks_do_not_matter():
    ranks = byte_bpe.read_ranks(BYTE_RANKS)
    bpe = byte_bpe.ByteBpe(ranks, P.PATTERN, byte_bpe.PerfectHash([], []), remember=3)
    for text in filter(None, TEXTS):
        whole = bpe.find.findall(text)
        assert [p for part in bpe.pieces(text, 5) for p in part] == whole


def test_common_words_stay_known(monkeypatch):
    """Words that come once push out none that come again."""
    ranks, merged, merge = byte_bpe.read_ranks(BYTE_RANKS), [], byte_bpe.merge_bytes
    monkeypatch.setattr(byte_bpe, "merge_bytes", lambda word, ranks: merged.append(word) or merge(word, ranks))
    bpe = byte_bpe.ByteBpe(ranks, P.PATTERN, byte_bpe.PerfectHash([], []), remember=40)
    names = [f"{a}{b}" for a in "bcdfghklmn" for b in "aeiou"]
    for name in names:
        text = f"often q{name} z{name} k{name}ka"
        want = b"".join(np.array(merge(p.encode(), ranks), "<u4").tobytes() for p in bpe.find.findall(text))
        assert bpe.encode(text) == want
    assert merged.count(b"often") == 1
    assert len(bpe.known) + len(bpe.young) + len(bpe.old) <= 40


def test_perfect_hash_is_minimal():
    ranks = byte_bpe.read_ranks(BYTE_RANKS)
    table = byte_bpe.PerfectHash(list(ranks), list(ranks.values()))
    assert sorted(table.keys) == sorted(ranks)
    assert table.lookup(list(ranks)).tolist() == list(ranks.values())
    assert table.lookup([b"no such word in there", b""]).tolist() == [-1, -1]


def test_every_entry_decodes_to_its_bytes():
    ranks = byte_bpe.read_ranks(BYTE_RANKS)
    bpe = byte_bpe.ByteBpe(ranks, P.PATTERN, byte_bpe.PerfectHash([], []))
    words = [*ranks, b"\0", b"\0\0"]  # bytes that end in zeros must keep them
    for word in words:
        ids = byte_bpe.merge_bytes(word, ranks)
        assert bpe.decode(np.array(ids, "<u4").tobytes()) == word
    assert bpe.decode(b"") == b""
    with pytest.raises((KeyError, IndexError, TypeError)):
        bpe.decode(np.array([len(ranks) + 5], "<u4").tobytes())
