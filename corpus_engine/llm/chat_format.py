"""Chat formatting in budgeted windows.

Every turn is rendered between markers of its role, and control strings inside its
text get a backslash, which reading back takes away again. Running sums of the turns'
tokens choose turn-aligned windows: the system turn stands in each of them, a few
earlier turns are repeated as history, and only turns that are there for the first
time are under the loss mask. No turn is cut or left out.

Windows are built while sorted rows stream by, so a task holds one window at a time.
A conversation of more than ``segment_turns`` rows is cut into segments of about that
many, which may lie in different tasks; windows begin anew there, with the system
turn and the history of the segment before.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce
from hashlib import sha256
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpus_engine.llm.common import field
from corpus_engine.llm.token_counts import count_tokens

# The markers of the template.
MARKS = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
OTHER = ("[ROLE:", "]", "[/ROLE]")

# what follows the first character of a control string, and any backslashes
REST = r"(?=/?INST\]|/?s>|</?SYS>>|/ROLE\]|ROLE:[0-9a-f]*\])"
ESCAPE = r"([<\[])(\\*)" + REST
UNESCAPE = re.compile(r"([<\[])\\(\\*)" + REST)
TURN = re.compile(
    r"<<SYS>>(?P<system>.*?)<</SYS>>|\[INST\](?P<user>.*?)\[/INST\]|<s>(?P<assistant>.*?)</s>"
    r"|\[ROLE:(?P<role>[0-9a-f]*)\](?P<other>.*?)\[/ROLE\]",
    re.DOTALL,
)

# turn numbers that are counted together before the running sum over a conversation
SLICE = 4096
SYSTEM, CARRIED, OWN = 0, 1, 2


def rendered_turn(role: Column, text: Column) -> Column:
    """The turn as it stands in a window."""
    body = F.regexp_replace(text, ESCAPE, r"$1$2\\")
    own_marker = F.concat(F.lit(OTHER[0]), F.lower(F.hex(F.encode(role, "UTF-8"))), F.lit(OTHER[1]))
    by_role = F.concat(own_marker, body, F.lit(OTHER[2]))
    for name, (begin, end) in MARKS.items():
        by_role = F.when(role == name, F.concat(F.lit(begin), body, F.lit(end))).otherwise(by_role)
    return by_role


def unescape(text: str) -> str:
    return UNESCAPE.sub(r"\1\2", text)


def read_turns(formatted: str) -> Iterator[tuple[str, int, int]]:
    """(role, begin, end) of the turns of a window; begin and end enclose the escaped text."""
    for found in TURN.finditer(formatted):
        kind = found.lastgroup
        role = bytes.fromhex(found["role"]).decode() if kind == "other" else kind
        yield role, *found.span(kind)


class Spans:
    """Windows of one segment, turn by turn."""

    def __init__(self, budget: int, history_turns: int, history_tokens: int):
        self.budget, self.history_turns, self.history_tokens = budget, history_turns, history_tokens
        self.system, self.system_tokens, self.made, self.repeat_system = None, 0, 0, False
        # sums[i] are the tokens before turns[i]; turns before ``first`` are history
        self.turns, self.sums, self.first = [], [0], 0

    def _append(self, turn: tuple[str, str], tokens: int) -> None:
        self.turns.append(turn)
        self.sums.append(self.sums[-1] + tokens)

    def put_system(self, turn: tuple[str, str], tokens: int, repeated: bool) -> None:
        self.system, self.system_tokens, self.repeat_system = turn, tokens, repeated

    def carry(self, turn: tuple[str, str], tokens: int) -> None:
        self._append(turn, tokens)
        self.first = len(self.turns)

    def add(self, turn: tuple[str, str], tokens: int) -> dict | None:
        """Take a turn; gives the window that it no longer fits into."""
        done = None
        self._append(turn, tokens)
        if self.first == len(self.turns) - 1:
            self._begin()
        elif self.system_tokens + self.sums[-1] - self.sums[0] > self.budget:
            done = self._window(len(self.turns) - 1)
            self.first = len(self.turns) - 1
            self._begin()
        return done

    def _begin(self) -> None:
        """Keep as history the last turns that the limits and the first new turn leave room for."""
        least = max(self.sums[self.first] - self.history_tokens, self.system_tokens + self.sums[-1] - self.budget)
        begin = min(max(bisect_left(self.sums, least), self.first - self.history_turns, 0), self.first)
        del self.turns[:begin], self.sums[:begin]
        self.first -= begin

    def _window(self, end: int) -> dict:
        parts, at, loss = [self.system] if self.system else [], 0, []
        repeated = (1 if self.system and self.repeat_system else 0) + self.first
        parts += self.turns[:end]
        for i, (role, text) in enumerate(parts):
            if i >= repeated and role == "assistant":
                begin, close = MARKS[role]
                loss.append({"start": at + len(begin), "end": at + len(text) - len(close)})
            at += len(text)
        tokens = self.system_tokens + self.sums[end] - self.sums[0]
        out = {
            "window": self.made,
            "n_turns": len(parts),
            "n_repeated": repeated,
            "n_tokens": tokens,
            "over_budget": tokens > self.budget,
            "formatted": "".join(text for _, text in parts),
            "loss": loss,
        }
        self.made += 1
        self.repeat_system = True
        return out

    def rest(self) -> dict | None:
        if self.first < len(self.turns) or (self.system and not self.repeat_system):
            return self._window(len(self.turns))
        return None


RESULT = (
    "window long, n_turns int, n_repeated int, n_tokens long, over_budget boolean, "
    "formatted string, loss array<struct<start:int,end:int>>"
)
ARROW = pa.schema(
    [
        ("window", pa.int64()),
        ("n_turns", pa.int32()),
        ("n_repeated", pa.int32()),
        ("n_tokens", pa.int64()),
        ("over_budget", pa.bool_()),
        ("formatted", pa.string()),
        ("loss", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
    ]
)


def _build(limits: tuple[int, int, int], flush_chars: int = 4_000_000):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key_type, held, size, key, spans = None, [], 0, None, None

        def batch() -> pa.RecordBatch:
            schema = pa.schema([("conv", key_type), ("segment", pa.int64()), *ARROW])
            return pa.RecordBatch.from_pylist(held, schema=schema)

        def keep(window: dict | None) -> None:
            nonlocal size
            if window:
                held.append({"conv": key[0], "segment": key[1], **window})
                size += len(window["formatted"])

        for rows in batches:
            key_type = rows.schema.field("conv").type
            names = ("conv", "segment", "kind", "role", "rendered", "n_tokens")
            for conv, segment, kind, role, text, tokens in zip(*(rows[n].to_pylist() for n in names)):
                if spans is None or (conv, segment) != key:
                    if spans:
                        keep(spans.rest())
                    key, spans = (conv, segment), Spans(*limits)
                    if kind == OWN and segment == 0 and role == "system":
                        spans.put_system((role, text), tokens, repeated=False)
                        continue
                if kind == SYSTEM:
                    spans.put_system((role, text), tokens, repeated=True)
                elif kind == CARRIED:
                    spans.carry((role, text), tokens)
                else:
                    keep(spans.add((role, text), tokens))
                if size > flush_chars:
                    yield batch()
                    held, size = [], 0
        if spans:
            keep(spans.rest())
        if held:
            yield batch()

    return run


def _long_segments(turns: DataFrame, segment_turns: int, history_turns: int) -> DataFrame | None:
    """``conv, turn, segment, carried, segments``, one row per turn number of a long conversation.

    Rows of one turn number stay together. ``carried`` is the segment that repeats the
    turn as possible history, or null; the first turn number names all ``segments``.
    None without a long conversation.
    """
    counts = turns.groupBy("conv", "turn").agg(F.count("*").alias("n"))
    long = counts.groupBy("conv").agg(F.sum("n").alias("total")).filter(F.col("total") > segment_turns)
    if long.isEmpty():
        return None
    part = F.floor(F.col("turn") / SLICE)
    c, g = counts.withColumn("slice", part).alias("c"), long.alias("g")
    c = c.join(g, F.col("c.conv").eqNullSafe(F.col("g.conv"))).select("c.*", "total")
    sums = c.groupBy("conv", "slice").agg(F.sum("n").alias("m"))
    over = Window.partitionBy("conv").orderBy(F.asc_nulls_first("slice"))
    sums = sums.withColumn("base", F.sum("m").over(over) - F.col("m")).alias("s")
    same = F.col("c.conv").eqNullSafe(F.col("s.conv")) & F.col("c.slice").eqNullSafe(F.col("s.slice"))
    c = c.alias("c").join(sums, same).select("c.*", "base")
    inside = Window.partitionBy("conv", "slice").orderBy(F.asc_nulls_first("turn"))
    c = c.withColumn("after", F.col("base") + F.sum("n").over(inside))
    c = c.withColumn("segment", F.floor((F.col("after") - F.col("n")) / segment_turns))
    c = c.withColumn("end", F.max("after").over(Window.partitionBy("conv", "segment")))
    near = (F.col("end") - F.col("after") < history_turns) & (F.col("end") < F.col("total"))
    c = c.withColumn("carried", F.when(near, F.floor(F.col("end") / segment_turns)))
    every = c.groupBy("conv").agg(F.collect_set("segment").alias("segments")).alias("e")
    opening = F.when(F.col("after") == F.col("n"), F.col("segments")).alias("segments")
    joined = c.alias("c").join(every, F.col("c.conv").eqNullSafe(F.col("e.conv")))
    return joined.select("c.conv", "turn", "segment", "carried", opening)


def format_conversations(
    conversations: DataFrame,
    model_path: str,
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    budget: int = 2048,
    history_turns: int = 2,
    history_tokens: int = 512,
    segment_turns: int = 4096,
) -> DataFrame:
    """Windows ``conv_id, segment, window, n_turns, n_repeated, n_tokens, over_budget, formatted, loss``.

    ``formatted`` holds ``n_turns`` rendered turns, of which the first ``n_repeated``
    stood in an earlier window already; ``loss`` are the code point ranges of the
    escaped assistant texts that are new. A window's tokens are those of its turns,
    each encoded on its own. A turn that is too long for the budget beside the system
    turn gets a window without history, marked ``over_budget``. The system turn is a
    conversation's first row, if its role is ``system``; later ones are plain turns.

    A null text or role counts as empty, a null id is one conversation. Rows go by
    turn (a number), null first, then role, then rendered text; repeated rows are turns of their own. Empty
    tables give no window, and other columns are left out, so their names can't clash.
    """
    empty = F.lit("")
    turns = conversations.select(
        field(conv_id).alias("conv"),
        field(turn).alias("turn"),
        F.coalesce(field(role), empty).alias("role"),
        rendered_turn(F.coalesce(field(role), empty), F.coalesce(field(text), empty)).alias("rendered"),
    )
    segments = _long_segments(turns, segment_turns, history_turns)
    turns = count_tokens(turns, model_path, text="rendered").drop("n_bytes")
    own = turns.withColumns({"segment": F.lit(0).cast("long"), "kind": F.lit(OWN)})
    if segments is not None:
        t, s = turns.alias("t"), segments.alias("s")
        same = F.col("t.conv").eqNullSafe(F.col("s.conv")) & F.col("t.turn").eqNullSafe(F.col("s.turn"))
        joined = t.join(s, same, "left").select("t.*", "segment", "carried", "segments")
        own = joined.withColumns({"segment": F.coalesce("segment", F.lit(0)), "kind": F.lit(OWN)})
        carried = joined.filter("carried is not null").withColumns({"segment": F.col("carried"), "kind": F.lit(CARRIED)})
        opening = joined.filter("segments is not null").groupBy("conv").agg(
            F.min(F.struct("role", "rendered", "n_tokens", "turn", "segments")).alias("o")
        )
        system = opening.filter(F.col("o.role") == "system").select("conv", "o.*")
        system = system.withColumn("segment", F.explode("segments")).filter("segment > 0").withColumn("kind", F.lit(SYSTEM))
        columns = own.drop("carried", "segments").columns
        own = reduce(DataFrame.unionByName, (df.select(*columns) for df in (own, carried, system)))
    order = ["conv", "segment", "kind", F.asc_nulls_first("turn"), "role", "rendered"]
    ordered = own.repartition("conv", "segment").sortWithinPartitions(*order)
    key = conversations.select(field(conv_id)).schema[0].dataType.simpleString()
    windows = ordered.select("conv", "segment", "kind", "role", "rendered", "n_tokens").mapInArrow(
        _build((budget, history_turns, history_tokens)), f"conv {key}, segment long, {RESULT}"
    )
    return windows.withColumnRenamed("conv", conv_id)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per conversation, from its windows in order."""
    key_type, key, state, out = None, None, None, []

    def row() -> dict:
        n, turns, chars, loss, total = state
        return {
            "conv": key,
            "n_turns": n,
            "turns_sha256": turns.hexdigest(),
            "loss_chars": chars,
            "loss_sha256": loss.hexdigest(),
            "formatted_chars": total,
        }

    def flush() -> pa.RecordBatch:
        fields = [("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64())]
        fields += [("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]
        return pa.RecordBatch.from_pylist(out, schema=pa.schema([("conv", key_type), *fields]))

    for rows in batches:
        key_type = rows.schema.field("conv").type
        columns = (rows[n].to_pylist() for n in ("conv", "formatted", "n_repeated", "loss"))
        for conv, windows in groupby(zip(*columns), key=lambda r: r[0]):
            if state is None or conv != key:
                if state:
                    out.append(row())
                key, state = conv, [0, sha256(), 0, sha256(), 0]
            for _, formatted, repeated, loss in windows:
                for role, begin, end in list(read_turns(formatted))[repeated:]:
                    state[0] += 1
                    state[1].update(f"{role}\n{unescape(formatted[begin:end])}\n".encode())
                for span in loss:
                    said = unescape(formatted[span["start"] : span["end"]])
                    state[2] += len(said)
                    state[3].update(said.encode())
                state[4] += len(formatted)
        if len(out) >= 10_000:
            yield flush()
            out = []
    if state:
        out.append(row())
    if out:
        yield flush()


def read_back(windows: DataFrame, conv_id: str = "conv_id") -> DataFrame:
    """Counts and digests of whole conversations, read from their windows alone.

    A digest needs the turns in order; the windows stream by sorted, so a task holds
    one batch of them however long the conversation is. A null id is one conversation,
    and no windows give no row.
    """
    rows = windows.select(field(conv_id).alias("conv"), "segment", "window", "formatted", "n_repeated", "loss")
    ordered = rows.repartition("conv").sortWithinPartitions("conv", "segment", "window")
    key = windows.select(field(conv_id)).schema[0].dataType.simpleString()
    schema = f"conv {key}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return ordered.select("conv", "formatted", "n_repeated", "loss").mapInArrow(_digest, schema).withColumnRenamed("conv", conv_id)
