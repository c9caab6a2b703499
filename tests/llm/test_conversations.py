import hashlib
import random
import re
import zlib
from heapq import heappop, heappush

import pytest
from pyspark.sql import functions as F

from weftgraph.llm import conversations as cv


def damage(rows):
    """(conv, turn, role, text) after damage, by turn, null first, and the digest of role and text."""
    out = []
    for conv, turn, role, text in rows:
        show = lambda x: " " if x is None else str(x)
        fate = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        role, text = show(role), show(text)
        if fate == 0:
            continue
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        role = "user" if fate == 4 else role
        out += [(conv, turn, role, text)] * (2 if fate == 3 else 1)
    return sorted(out, key=lambda r: (r[1] is not None, r[1], hashlib.sha256(f"{len(r[2])}:{r[2]}{r[3]}".encode()).hexdigest()))


def cheapest(rows):
    """(cost, audit, lines) by an ordered search over (cost, audit): the first end is the cheapest and least."""
    n, after = len(rows), {"": "u", "s": "u", "u": "a", "a": "u"}
    heap, seen = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, state, lines = heappop(heap)
        if i == n and state in ("", "a"):
            return cost, audit, lines
        if (i, state) in seen:
            continue
        seen.add((i, state))  # no audit of equal cost to here begins another, so the least goes on least
        nxt = after[state]
        name = {"u": "user", "a": "assistant"}[nxt]
        if audit[-2:] != "II":  # a third one only comes back
            heappush(heap, (cost + 3, audit + "I", i, nxt, (*lines, f"{name}:")))
        if i < n:
            role, text, must, cut = rows[i]
            heappush(heap, (cost + 4, audit + "D", i + 1, state, lines))
            if not must:
                first = role[:1]
                if first == nxt or (first == "s" and state == ""):
                    heappush(heap, (cost + 3 * cut, audit + "K", i + 1, first, (*lines, f"{role}:{text}")))
                heappush(heap, (cost + 3 + 3 * cut, audit + "R", i + 1, nxt, (*lines, f"{name}:{text}")))
    raise AssertionError


def brute(rows):
    out = []
    for conv in {r[0] for r in rows}:
        mine = [r for r in damage(rows) if r[0] == conv]
        blank = dup = cut = illegal = 0
        seen, turns, marked = set(), [r[1] for r in mine if r[1] is not None], []
        for i, (_, _, role, text) in enumerate(mine):
            words = re.sub(r"[\x20\x09-\x0D]", "", text)
            b, d = not words, (role, text) in seen
            t = bool(words) and words[-1] not in ".!?"
            seen.add((role, text))
            blank, dup, cut = blank + b, dup + (not b and d), cut + (not b and not d and t)
            marked.append((role, text, b or d, t and not d))
            illegal += i > 0 and mine[i - 1][2][:1] + role[:1] not in ("su", "ua", "au")
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        cost, audit, lines = cheapest(marked)
        out.append((conv, gaps, blank, dup, cut, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def table(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return df.withColumns({c: F.lit("x") for c in ("_ck", "_turn", "_d", "_m", "cost", "audit", "_part", "blank", "role_")})


def some(seed, n=160):
    rng = random.Random(seed)
    rows = []
    for conv in [*range(40), None]:
        for turn in range(rng.randrange(0, 9)):
            role = rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None, "usr"])
            text = rng.choice(["Hello.", "Hello", "Why?", "", " \n", None, "é! ", "Go on. ", "a:b\nc.", f"T{turn}."])
            rows.append((conv, rng.choice([turn, turn, turn, turn + 1, None]), role, text))
    return rows


@pytest.mark.parametrize("seed, size", [(0, 4096), (1, 2), (2, 1), (3, 5)])
def test_repair_against_an_ordered_search(spark, seed, size):
    rows = some(seed)
    got = cv.conversation_repair(table(spark, rows), size=size).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)


def test_repeats_of_a_turn_are_one_row(spark):
    rows = [(1, t, r, f"T{t}.") for t, r in enumerate(["user", "assistant"] * 3)] + [(1, 1, "assistant", "T1.")] * 7
    assert sorted(map(tuple, cv.conversation_repair(table(spark, rows)).collect())) == brute(rows)
    assert cv.turns(cv.undamaged(table(spark, rows))).count() == 6


def test_a_conversation_over_many_segments(spark):
    rng = random.Random(5)
    rows = [(7, t, rng.choice(["user", "assistant", "assistant", "system"]), rng.choice([f"T{t}.", f"T{t}", "same.", ""])) for t in range(300)]
    whole, cut = (cv.conversation_repair(table(spark, rows), size=s).collect() for s in (4096, 7))
    assert whole == cut and whole[0]["cost"] > 0
    assert whole[0]["audit"].count("D") >= whole[0]["blank"] + whole[0]["duplicate"]


def test_empty_and_undamaged(spark):
    assert cv.conversation_repair(table(spark, some(0)).limit(0)).collect() == []
    rows = [(1, 0, "user", "Hi."), (1, 1, "assistant", "Yes."), (2, 0, "assistant", "Yes.")]
    got = {r["conv_id"]: (r["cost"], r["audit"]) for r in cv.conversation_repair(table(spark, rows), damage=False).collect()}
    assert got == {1: (0, "KK"), 2: (3, "IK")}
    lines = [(r["role"], r["text"]) for r in cv.repaired(table(spark, rows)).orderBy("_ck", "turn", "at").collect()]
    assert lines == [("user", "Hi."), ("assistant", "Yes."), ("user", ""), ("assistant", "Yes.")]


def test_layers_are_few_bits_a_row():
    symbols = bytes(random.Random(3).randrange(9) for _ in range(2000))
    layers = cv.Layers(symbols, cv.ENDS, True)
    cost = layers.first(cv.BEGIN)
    assert len(layers.inside) == cost + 1
    assert sum(bits.bit_count() for layer in layers.inside for bits in layer.values()) <= 4 * (len(symbols) + 1)
