import random
import re
from hashlib import sha256
from zlib import crc32

from corpus_engine.llm import structure_repair as sr
from corpus_engine.llm.queries import QUERIES, damaged
from tests.llm.helpers import SMALL

GOAL = re.compile(r"(s?(ua)+)?")


def every_repair(rows):
    """All (cost, audit, roles) up to the cost of deleting everything; rows are (initial, fault)."""
    limit, out = 2 * len(rows), []

    def go(i, cost, audit, roles):
        if cost > limit:
            return
        if i == len(rows) and GOAL.fullmatch(roles):
            out.append((cost, audit, roles))
        for role in "ua":
            go(i, cost + 5, audit + "I", roles + role)
        if i == len(rows):
            return
        initial, fault = rows[i]
        go(i + 1, cost + 2, audit + "D", roles)
        if fault != sr.GOES:
            stays = 5 if fault == sr.CUT else 0
            go(i + 1, cost + stays, audit + "K", roles + initial)
            for role in "ua":
                go(i + 1, cost + 1 + stays, audit + "R", roles + role)

    go(0, 0, "", "")
    return out


def best_strings(pattern):
    """The same programme on whole strings."""
    cells = {0: (0, "")}

    def put(to, place, cost, audit):
        if place not in to or (cost, audit) < to[place]:
            to[place] = (cost, audit)

    def inserts(to):
        for _ in range(2):
            for place, (cost, audit) in list(to.items()):
                put(to, sr.STEPS[place, sr.EXPECTED[place]], cost + 5, audit + "I")

    inserts(cells)
    for letter in pattern:
        speaker, fault = divmod(ord(letter) - 97, 3)
        after = {}
        for place, (cost, audit) in cells.items():
            put(after, place, cost + 2, audit + "D")
            if fault != sr.GOES:
                stays = 5 * (fault == sr.CUT)
                kept = sr.STEPS.get((place, "sua?"[speaker]))
                if kept is not None:
                    put(after, kept, cost + stays, audit + "K")
                put(after, sr.STEPS[place, sr.EXPECTED[place]], cost + 1 + stays, audit + "R")
        inserts(after)
        cells = after
    return min(cells[p] for p in (0, 3) if p in cells)


def test_against_all_repairs():
    rng = random.Random(3)
    for _ in range(250):
        pattern = "".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(0, 4)))
        rows = [("sua "[(ord(c) - 97) // 3], (ord(c) - 97) % 3) for c in pattern]
        cost, audit, _ = min(every_repair(rows))
        assert sr.cheapest_edits(pattern) == (cost, audit), pattern


def test_long_patterns_and_collisions():
    rng = random.Random(4)
    for n in (0, 1, 30, 200, 1500):
        pattern = "".join(rng.choice("adddgggjehi") for _ in range(n))
        want = best_strings(pattern)
        assert sr.cheapest_edits(pattern) == want
        assert sr.cheapest_edits(pattern, prime=3) == want  # nearly every hash collides


def test_comparison_by_common_prefix():
    rng = random.Random(5)
    for prime in (sr.PRIME, 2):
        edits, nodes = sr.Edits(prime), [0]
        for _ in range(600):
            nodes.append(edits.add(rng.choice(nodes[-8:] + [0]), rng.choice("DK")))
        for _ in range(2000):
            a, b = rng.choice(nodes), rng.choice(nodes)
            if edits.text(a) != edits.text(b):
                assert edits.less(a, b) == (edits.text(a) < edits.text(b))


def brute(rows):
    """conv -> (gaps, blank, duplicate, truncated, illegal, cost, audit, repaired digest)."""
    space, out = "\x20\t\n\x0b\x0c\r", {}
    convs = {}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        convs.setdefault(conv, []).append((turn is not None, turn or 0, role, sha256(text.encode()).digest(), text))
    for conv, rs in convs.items():
        rs.sort()
        seen, counts, pattern = set(), [0, 0, 0], ""
        for _, _, role, _, text in rs:
            fault = sr.FINE
            if not text.strip(space):
                counts[0] += 1
                fault = sr.GOES
            elif (role, text) in seen:
                counts[1] += 1
                fault = sr.GOES
            elif text.rstrip(space)[-1] not in ".!?":
                counts[2] += 1
                fault = sr.CUT
            seen.add((role, text))
            pattern += chr(97 + 3 * ("sua".find(role[:1]) if role[:1] and role[:1] in "sua" else 3) + fault)
        pairs = [a[2][:1] + b[2][:1] for a, b in zip(rs, rs[1:])]
        numbers = [r[1] for r in rs if r[0]]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        cost, audit = best_strings(pattern)
        lines, place, i = [], 0, 0
        for edit in audit:
            expected = sr.EXPECTED[place]
            if edit == "I":
                role, text = sr.ROLES[expected], ""
            else:
                _, _, role, _, text = rs[i]
                i += 1
                if edit == "D":
                    continue
                role = sr.ROLES[expected] if edit == "R" else role
            place = sr.STEPS[place, role[0]]
            lines.append(f"{role}:{text}")
        digest = sha256("\n".join(lines).encode()).hexdigest()
        out[conv] = (gaps, *counts, sum(p not in sr.LEGAL for p in pairs), cost, audit, digest)
    return out


def library(df, **names):
    plans = sr.plan_repairs(df, **names).cache()
    digests = {r[0]: r[1] for r in sr.conversation_digests(sr.apply_repairs(df, plans, **names)).collect()}
    empty = sha256(b"").hexdigest()
    columns = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    return {r.conv_id: (*(r[c] for c in columns), digests.get(r.conv_id, empty)) for r in plans.collect()}


def random_rows(seed):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "cut", "", None, " \t", "ends. \n", "é?", "Yes. x"]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "users"]
    rows = []
    for conv in [*range(25), None]:
        for i in range(rng.randint(1, 14)):
            rows.append((conv, rng.choice([i, i, i, 2 * i, None]), rng.choice(roles), rng.choice(texts)))
    return rows + rows[:5] + [(77, None, "user", "a."), (78, -5, "user", "a."), (78, 5, "assistant", "b.")]


def test_against_brute_force(spark):
    rows = random_rows(8)
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "conv_id long, turn long, role string, text string, n int, mark string, conv int")
    assert library(df) == brute(rows)
    assert library(df.limit(0)) == {}


def test_long_conversation_and_text(spark):
    rows = [(1, i, ("user", "assistant")[i % 2], f"row {i % 500}" + "." * (i % 3 > 0)) for i in range(4000)]
    rows += [(2, 0, "user", "word " * 400_000 + "."), (2, 1, "assistant", " " * 500_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert library(df) == brute(rows)


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    harmed = []
    for conv, turn, role, text in rows:
        fault = crc32(f"{conv}:{turn}".encode()) % 20
        if fault:
            text = {1: "", 2: re.sub("[.!?]", "", text)}.get(fault, text)
            harmed += [(conv, turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    want = {conv: (0, 0, 0, 0, 0, 0, "", sha256(b"").hexdigest()) for conv, *_ in rows} | brute(harmed)
    got = {r[0]: tuple(r)[1:] for r in QUERIES["op12_structure_repair"](spark, SMALL).collect()}
    assert got == want


def test_damage_of_nulls(spark):
    df = spark.createDataFrame([(i, None, None, None) for i in (None, *range(60))], "conv_id long, turn long, role string, text string")
    want = []
    for conv in (None, *range(60)):
        fault = crc32(f"{' ' if conv is None else conv}: ".encode()) % 20
        row = (conv, None, "user" if fault == 4 else " ", "" if fault == 1 else " ")
        want += [row] * (0 if fault == 0 else 2 if fault == 3 else 1)
    assert sorted(map(str, map(tuple, damaged(df).collect()))) == sorted(map(str, want))
