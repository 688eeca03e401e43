"""Repair of conversation structure by a persistent audit DP.

A conversation becomes one letter per row: who speaks, and whether the row must go or
ends unfinished. A dynamic programme over the four places of the grammar
``(s?(ua)+)?`` finds the cheapest edits. Edit strings share their beginnings as linked
nodes; each node has the rolling hash of its string and binary-lifting ancestors, so
that strings of equal cost are compared by a search for their longest common prefix.

Texts take no part in this: the edits are joined back to the rows, which stay spread
over all tasks whatever the size of their conversation.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpus_engine.llm.common import bound_batches, field

WORD_CHAR = r"[^\x20\x09-\x0D]"
UNFINISHED = r"[^\x20\x09-\x0D.!?][\x20\x09-\x0D]*\z"
# Costs of the edits, and of a row that stays although it is unfinished.
REROLE, DELETE, INSERT, STAYS = 1, 2, 5, 5

# letters of a pattern: three of each speaker (s, u, a, anyone else), in this order
FINE, GOES, CUT = 0, 1, 2
SPEAKERS = "sua"
ROLES = {"u": "user", "a": "assistant"}
# the grammar: what a role initial leads to, and whom each place expects next
STEPS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
EXPECTED = "uuau"
ACCEPTED = (0, 3)
LEGAL = {"su", "ua", "au"}

PRIME, BASE = (1 << 61) - 1, 1_000_003


class Edits:
    """Edit strings as nodes; node 0 is the empty string."""

    def __init__(self, prime: int = PRIME):
        self.prime = prime
        self.letter, self.depth, self.hash, self.up = [""], [0], [0], [()]

    def add(self, parent: int, letter: str) -> int:
        """The string of ``parent`` and one letter more."""
        node, ups, at, k = len(self.letter), [parent], parent, 0
        while k < len(self.up[at]):
            at = self.up[at][k]
            ups.append(at)
            k += 1
        self.letter.append(letter)
        self.depth.append(self.depth[parent] + 1)
        self.hash.append((self.hash[parent] * BASE + ord(letter)) % self.prime)
        self.up.append(tuple(ups))
        return node

    def ancestor(self, node: int, depth: int) -> int:
        while self.depth[node] > depth:
            rise = self.depth[node] - depth
            node = self.up[node][rise.bit_length() - 1]
        return node

    def same(self, a: int, b: int) -> bool:
        """Whether the strings are equal: by hash, then letter by letter up to a shared node."""
        if self.hash[a] != self.hash[b]:
            return False
        while a != b:
            if self.letter[a] != self.letter[b]:
                return False
            a, b = self.up[a][0], self.up[b][0]
        return True

    def text(self, node: int) -> str:
        out = []
        while node:
            out.append(self.letter[node])
            node = self.up[node][0]
        return "".join(reversed(out))

    def less(self, a: int, b: int) -> bool:
        """Whether the string of ``a`` comes before that of ``b``."""
        depth = min(self.depth[a], self.depth[b])
        x, y = self.ancestor(a, depth), self.ancestor(b, depth)
        if self.hash[x] == self.hash[y]:
            if self.same(x, y):
                return self.depth[a] < self.depth[b]
            return self.text(a) < self.text(b)  # a collision
        # the highest ancestors that still differ stand just below the common prefix
        k = len(self.up[x]) - 1
        while k >= 0:
            if k < len(self.up[x]):
                p, q = self.up[x][k], self.up[y][k]
                if self.hash[p] != self.hash[q]:
                    x, y = p, q
            k -= 1
        if not self.same(self.up[x][0], self.up[y][0]):
            return self.text(a) < self.text(b)  # a collision
        return self.letter[x] < self.letter[y]


def cheapest_edits(pattern: str, prime: int = PRIME) -> tuple[int, str]:
    """(cost, edit initials) of one conversation; equal costs go to the ASCII-least initials."""
    edits = Edits(prime)

    def offer(cells: list, place: int, cost: int, parent: int, letter: str) -> None:
        held = cells[place]
        if held is None or cost < held[0]:
            cells[place] = (cost, parent, letter)
        elif cost == held[0]:
            new = edits.add(parent, letter)
            old = edits.add(*held[1:]) if held[2] else held[1]
            cells[place] = (cost, new if edits.less(new, old) else old, "")

    def settle(cells: list, place: int) -> None:
        if cells[place] and cells[place][2]:
            cost, parent, letter = cells[place]
            cells[place] = (cost, edits.add(parent, letter), "")

    def insert(cells: list) -> None:
        # user rows first, then answers to them; a third insert in a row never pays
        for begin, end in ((0, 2), (1, 2), (3, 2), (2, 3)):
            settle(cells, begin)
            if cells[begin]:
                offer(cells, end, cells[begin][0] + INSERT, cells[begin][1], "I")
        settle(cells, 3)

    cells = [(0, 0, ""), None, None, None]
    insert(cells)
    for code in map(ord, pattern):
        speaker, fault = divmod(code - 97, 3)
        initial = SPEAKERS[speaker] if speaker < 3 else ""
        stays = STAYS if fault == CUT else 0
        after: list = [None] * 4
        for place, held in enumerate(cells):
            if held is None:
                continue
            cost, node, _ = held
            offer(after, place, cost + DELETE, node, "D")
            if fault == GOES:
                continue
            kept = STEPS.get((place, initial))
            if kept is not None:
                offer(after, kept, cost + stays, node, "K")
            offer(after, STEPS[place, EXPECTED[place]], cost + REROLE + stays, node, "R")
        insert(after)
        cells = after
    best = None
    for place in ACCEPTED:
        held = cells[place]
        if held and (best is None or held[0] < best[0] or held[0] == best[0] and edits.less(held[1], best[1])):
            best = held
    return best[0], edits.text(best[1])


def fates(pattern: str, audit: str) -> tuple[list[int], list[str], list[tuple[int, str]]]:
    """Place of each row in the repaired conversation (-1: gone), K, D or new initial, and inserted places."""
    places, fate, inserted, at, state, row = [], [], [], 0, 0, 0
    for edit in audit:
        expected = EXPECTED[state]
        if edit == "D":
            places.append(-1)
            fate.append("D")
            row += 1
            continue
        if edit == "I":
            inserted.append((at, ROLES[expected]))
        else:
            speaker = (ord(pattern[row]) - 97) // 3
            expected = SPEAKERS[speaker] if edit == "K" else expected
            places.append(at)
            fate.append("K" if edit == "K" else expected)
            row += 1
        state = STEPS[state, expected]
        at += 1
    return places, fate, inserted


def _illegal(pattern: str) -> int:
    initials = [SPEAKERS[s] if s < 3 else " " for s in ((ord(c) - 97) // 3 for c in pattern)]
    return sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))


PLAN = (
    "illegal long, cost long, audit string, places array<int>, fates array<string>, "
    "inserted array<struct<place:int,role:string>>"
)


def _plan(patterns: pd.Series, sizes: pd.Series) -> pd.DataFrame:
    # short conversations of the same pattern are planned once a batch
    solve = lru_cache(maxsize=20_000)(cheapest_edits)
    out = []
    for letters, counts in zip(patterns, sizes):
        # copies of a row beyond its first must go
        gone = [chr(ord(c) - (ord(c) - 97) % 3 + GOES) for c in letters]
        pattern = "".join(c + g * (n - 1) for c, g, n in zip(letters, gone, counts))
        cost, audit = solve(pattern) if len(pattern) <= 64 else cheapest_edits(pattern)
        places, fate, inserted = fates(pattern, audit)
        first, at = [], 0
        for n in counts:
            first.append(at)
            at += int(n)
        out.append(
            (
                _illegal(pattern),
                cost,
                audit,
                [places[i] for i in first],
                [fate[i] for i in first],
                [{"place": p, "role": r} for p, r in inserted],
            )
        )
    return pd.DataFrame(out, columns=["illegal", "cost", "audit", "places", "fates", "inserted"])


def _rows(conversations: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """``conv, turn, role, text, mark``: nulls as one space, the text's digest as mark."""
    said = F.coalesce(field(text), F.lit(" "))
    return conversations.select(
        field(conv_id).alias("conv"),
        field(turn).alias("turn"),
        F.coalesce(field(role), F.lit(" ")).alias("role"),
        said.alias("text"),
        F.unhex(F.sha2(said, 256)).alias("mark"),
    )


def _fault(text: Column) -> Column:
    return F.when(~text.rlike(WORD_CHAR), GOES).when(text.rlike(UNFINISHED), CUT).otherwise(FINE)


def plan_repairs(
    conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """One row per conversation: its faults, the cost and the initials of its cheapest edits.

    ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, edits, inserted``.
    ``edits`` holds ``turn, role, mark, place, fate`` of each distinct row, ``inserted``
    the places and roles of new rows.

    Rows go by turn (a number), null first, then role, then the digest of the text. A
    null text or role is one space, a null id is one conversation; repeated rows are
    duplicates of the first. Empty tables give no row, and other columns are not read.
    The plan of a conversation is one row of some 60 bytes per distinct turn; its audit
    has a letter per turn by definition, so it meets in one place, but no text does.
    """
    bound_batches(conversations.sparkSession)
    rows = _rows(conversations, conv_id, turn, role, text)
    # rows that are there several times meet only as a count
    distinct = (
        rows.withColumn("fault", _fault(F.col("text")))
        .groupBy("conv", "turn", "role", "mark")
        .agg(F.count("*").cast("int").alias("n"), F.max("fault").alias("fault"))
        .repartition("conv")
    )
    again = F.row_number().over(Window.partitionBy("conv", "role", "mark").orderBy(F.asc_nulls_first("turn"))) > 1
    initial = F.substring("role", 1, 1)
    speaker = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    blank = F.col("fault") == GOES
    each = distinct.withColumn("again", again).withColumns(
        {
            "blank": F.when(blank, F.col("n")).otherwise(0),
            "duplicate": F.when(blank, 0).when(F.col("again"), F.col("n")).otherwise(F.col("n") - 1),
            "truncated": F.when((F.col("fault") == CUT) & ~F.col("again"), 1).otherwise(0),
            "letter": F.char(97 + 3 * speaker + F.when(F.col("again"), GOES).otherwise(F.col("fault"))),
        }
    )
    total = [F.sum(c).cast("long").alias(c) for c in ("blank", "duplicate", "truncated")]
    listed = F.sort_array(F.collect_list(F.struct("turn", "role", "mark", "n", "letter"))).alias("rows")
    whole = each.groupBy("conv").agg(*total, F.min("turn").alias("low"), F.max("turn").alias("high"), listed)
    turns = F.size(F.array_distinct(F.filter(F.transform("rows", lambda r: r["turn"]), lambda t: t.isNotNull())))
    plan = F.pandas_udf(_plan, PLAN).asNondeterministic()(
        F.concat_ws("", F.transform("rows", lambda r: r["letter"])), F.transform("rows", lambda r: r["n"])
    )
    planned = whole.withColumn("gaps", F.coalesce((F.col("high") - F.col("low") + 1 - turns).cast("long"), F.lit(0)))
    planned = planned.withColumn("plan", plan)
    edits = F.zip_with(
        "rows",
        F.arrays_zip("plan.places", "plan.fates"),
        lambda r, p: F.struct(r["turn"], r["role"], r["mark"], p["places"].alias("place"), p["fates"].alias("fate")),
    )
    return planned.select(
        F.col("conv").alias(conv_id),
        "gaps",
        "blank",
        "duplicate",
        "truncated",
        "plan.illegal",
        "plan.cost",
        "plan.audit",
        edits.alias("edits"),
        "plan.inserted",
    )


def apply_repairs(
    conversations: DataFrame,
    plans: DataFrame,
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
) -> DataFrame:
    """The repaired rows ``conv_id, place, turn, role, text, edit``.

    ``edit`` is K, R or I; an inserted row has no turn and an empty text. Rows are joined
    one by one, so a conversation of any size is spread over the tasks. Conversations
    of which nothing is left have no row; nulls, repeats and clashing names as in
    :func:`plan_repairs`.
    """
    rows = _rows(conversations, conv_id, turn, role, text)
    keys = ["conv", "turn", "role", "mark"]
    once = rows.groupBy(*keys).agg(F.any_value("text").alias("text"))
    plans = plans.select(field(conv_id).alias("conv"), "edits", "inserted")
    edits = plans.select("conv", F.explode("edits").alias("e")).select("conv", "e.*").filter("place >= 0")
    r, e = once.alias("r"), edits.alias("e")
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"e.{k}")) for k in ("conv", "turn")]
    same += [F.col(f"r.{k}") == F.col(f"e.{k}") for k in ("role", "mark")]
    fate = F.col("fate")
    new_role = F.when(fate == "u", "user").when(fate == "a", "assistant").otherwise(F.col("r.role"))
    kept = r.join(e, same).select(
        F.col("r.conv").alias("conv"),
        F.col("place").cast("long").alias("place"),
        F.col("r.turn").alias("turn"),
        new_role.alias("role"),
        F.col("r.text").alias("text"),
        F.when(fate == "K", "K").otherwise("R").alias("edit"),
    )
    turn_type = conversations.select(field(turn)).schema[0].dataType
    new = plans.select("conv", F.explode("inserted").alias("i")).select(
        "conv",
        F.col("i.place").cast("long").alias("place"),
        F.lit(None).cast(turn_type).alias("turn"),
        F.col("i.role").alias("role"),
        F.lit("").alias("text"),
        F.lit("I").alias("edit"),
    )
    return kept.unionByName(new).withColumnRenamed("conv", conv_id)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, state, out, key_type = None, None, [], None

    def flush() -> pa.RecordBatch:
        schema = pa.schema([("conv", key_type), ("repaired_sha256", pa.string())])
        return pa.RecordBatch.from_pylist(out, schema=schema)

    for rows in batches:
        key_type = rows.schema.field("conv").type
        for conv, role, text in zip(*(rows[c].to_pylist() for c in ("conv", "role", "text"))):
            if state is None or conv != key:
                if state:
                    out.append({"conv": key, "repaired_sha256": state.hexdigest()})
                key, state, between = conv, sha256(), ""
            state.update(f"{between}{role}:{text}".encode())
            between = "\n"
        if len(out) >= 10_000:
            yield flush()
            out = []
    if state:
        out.append({"conv": key, "repaired_sha256": state.hexdigest()})
    if out:
        yield flush()


def conversation_digests(repaired: DataFrame, conv_id: str = "conv_id") -> DataFrame:
    """``conv_id, repaired_sha256`` of ``role:text``, joined by newlines in the order of places.

    The rows stream by sorted; a task holds one batch of them, not a conversation. A
    null id is one conversation, and no rows give no row.
    """
    rows = repaired.select(field(conv_id).alias("conv"), "place", "role", "text")
    key = rows.schema["conv"].dataType.simpleString()
    ordered = rows.repartition("conv").sortWithinPartitions("conv", "place").drop("place")
    return ordered.mapInArrow(_digests, f"conv {key}, repaired_sha256 string").withColumnRenamed("conv", conv_id)
