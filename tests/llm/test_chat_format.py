import random
import re
from hashlib import sha256

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpus_engine.llm import chat_format as cf
from corpus_engine.llm.queries import CONTROL_TEXT, QUERIES
from tests.llm.helpers import SMALL

PIECES = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "conv_id long, turn long, role string, text string, conv long, segment string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)


def in_order(rows):
    """Rows of each conversation in their defined order, nulls as empty text."""
    out = {}
    for conv, turn, role, text in rows:
        out.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))

    def place(r):
        close = cf.MARKS[r[2]][1] if r[2] in cf.MARKS else "[/ROLE]"
        return *r[:3], (escape(r[3]) + close).encode()

    return {c: [(r[2], r[3]) for r in sorted(rs, key=place)] for c, rs in out.items()}


def escape(text):
    return re.sub(cf.ESCAPE, r"\1\2\\", text)


def digests(rows):
    out = {}
    for conv, turns in in_order(rows).items():
        said = "".join(t for r, t in turns if r == "assistant")
        whole = "".join(f"{r}\n{t}\n" for r, t in turns)
        out[conv] = (len(turns), sha256(whole.encode()).hexdigest(), len(said), sha256(said.encode()).hexdigest())
    return out


def read(windows):
    return {r.conv_id: tuple(r)[1:5] for r in cf.read_back(windows).collect()}


def random_rows(seed, convs=12, most=30):
    rng = random.Random(seed)
    parts = ["a", "é", "[INST]", "</s>", "<s>", "\\", "<", "[", "<<SYS>>", "[ROLE:61]", "[/ROLE]", "words of a text ", "😀", "\n"]
    rows = []
    for conv in [*range(convs), None]:
        for i in range(rng.randint(1, most)):
            role = "system" if i == 0 and rng.random() < 0.6 else rng.choice(["user", "assistant", "tool", None, "a]b", "system"])
            text = None if rng.random() < 0.05 else "".join(rng.choices(parts, k=rng.randint(0, 12)))
            rows.append((conv, rng.choice([i, i, i, None, 3]), role, text))
    return rows


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["<", "[", "\\", "s", ">", "/", "INST]", "SYS>>", "ROLE:6a]", "/ROLE]", "x"])).map("".join))
def test_escape_is_reversible(text):
    hidden = escape(text)
    assert cf.unescape(hidden) == text
    assert not re.search(r"\[/?INST\]|</?s>|<</?SYS>>|\[ROLE:[0-9a-f]*\]|\[/ROLE\]", hidden)
    for begin, close in (*cf.MARKS.values(), ("[ROLE:6a]", "[/ROLE]")):
        turns = list(cf.read_turns(begin + hidden + close + "[INST]x[/INST]"))
        assert len(turns) == 2 and cf.unescape((begin + hidden + close)[turns[0][1] : turns[0][2]]) == text


@pytest.mark.parametrize("budget, history_turns, history_tokens, segment_turns", [(2048, 2, 512, 4096), (60, 2, 30, 4096), (60, 3, 40, 4), (1, 0, 0, 2)])
def test_round_trip(spark, budget, history_turns, history_tokens, segment_turns):
    rows = random_rows(budget + segment_turns) + [(1, 0, "user", "twice"), (1, 0, "user", "twice")]
    limits = dict(budget=budget, history_turns=history_turns, history_tokens=history_tokens, segment_turns=segment_turns)
    windows = cf.format_conversations(frame(spark, rows), PIECES, **limits).cache()
    assert read(windows) == digests(rows)
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    ordered = in_order(rows)
    several = 0
    for w in windows.collect():
        turns = list(cf.read_turns(w.formatted))
        assert len(turns) == w.n_turns
        ends = [m.end() for m in cf.TURN.finditer(w.formatted)]
        texts = [w.formatted[a:b] for a, b in zip([0, *ends], ends)]
        sizes = [len(ids) for ids in model.encode(texts)]
        assert sum(sizes) == w.n_tokens and w.over_budget == (w.n_tokens > budget)
        system = ordered[w.conv_id][0][0] == "system"
        if system:
            assert turns[0][0] == "system"
        repeated_system = system and w.n_repeated > 0
        history = sizes[int(repeated_system) : w.n_repeated]
        assert len(history) <= history_turns and sum(history) <= history_tokens
        new = w.n_turns - w.n_repeated
        if w.over_budget:  # only a turn that does not fit beside the system turn
            assert not history and new <= 1 + int(system and not repeated_system)
        several += w.n_repeated > 0
    assert several or budget == 2048


def test_segments_do_not_change_the_turns(spark):
    rows = [(5, i, "system" if i == 0 else ("user", "assistant")[i % 2 == 0], f"turn {i} " * (i % 7)) for i in range(300)]
    rows += [(6, 0, "user", "short")]
    windows = cf.format_conversations(frame(spark, rows), PIECES, budget=100, segment_turns=50).cache()
    assert read(windows) == digests(rows)
    hot = windows.filter("conv_id = 5")
    assert hot.select("segment").distinct().count() == 6
    assert all(r.formatted.startswith("<<SYS>>") for r in hot.collect())
    # the first window of a later segment repeats turns of the segment before
    assert hot.filter("segment > 0 and window = 0 and n_repeated > 1").count() == 5


def test_huge_turn_and_empty_table(spark):
    rows = [(1, 0, "user", "long words " * 200_000), (1, 1, "assistant", "[INST]" * 100_000), (2, 0, "system", "alone")]
    windows = cf.format_conversations(frame(spark, rows), PIECES)
    assert read(windows) == digests(rows)
    assert windows.filter("over_budget").count() == 2
    empty = cf.format_conversations(frame(spark, rows).limit(0), PIECES)
    assert empty.collect() == [] and cf.read_back(empty).collect() == []


def test_text_ids(spark):
    df = spark.createDataFrame([("a.b", 1, "user", "x")], "`c.id` string, turn int, role string, text string")
    got = cf.read_back(cf.format_conversations(df, PIECES, conv_id="c.id"), "c.id")
    assert got.columns[0] == "c.id" and got.first()[0] == "a.b"


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-7, 0, "user", CONTROL_TEXT), (-7, 1, "assistant", CONTROL_TEXT)]
    got = QUERIES["op11_chat_format"](spark, SMALL)
    assert {r.conv_id: tuple(r)[1:5] for r in got.collect()} == digests(rows)
    assert got.filter(F.col("formatted_chars") <= F.col("loss_chars")).count() == 0
