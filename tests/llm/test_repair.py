"""Repairs of conversations: the block tables against a plain search, conversations cut anywhere, and the edges."""

import hashlib
import random
from functools import lru_cache
from itertools import product

import pytest

from serospark.llm import repair

NEXT = {"": "su", "s": "u", "u": "a", "a": "u"}


def plain(rows):
    """``(cost, audit, lines)`` of rows ``(role, text, fault)`` by trying every edit."""
    @lru_cache(None)
    def best(i, last, fresh):
        found = []

        def add(cost, edit, line, rest):
            if rest is not None:
                found.append((cost + rest[0], edit + rest[1], (() if line is None else (line,)) + rest[2]))

        if i == len(rows):
            found += [(0, "", ())] if last in ("", "a") else []
        else:
            role, text, fault = rows[i]
            cut = int(fault == "truncated")
            add(3, "D", None, best(i + 1, last, 2))
            if fault not in ("blank", "duplicate"):
                if role[:1] in tuple(NEXT[last]):
                    add(cut, "K", f"{role}:{text}", best(i + 1, role[0], 2))
                for to in ("user", "assistant"):
                    if to[0] in NEXT[last]:
                        add(2 + cut, "R", f"{to}:{text}", best(i + 1, to[0], 2))
        if fresh:
            for to in ("user", "assistant"):
                if to[0] in NEXT[last]:
                    add(2, "I", f"{to}:", best(i, to[0], fresh - 1))
        return min(found) if found else None
    return best(0, "", 2)


@pytest.mark.parametrize("block", [1, 3, 4])
def test_tables_against_search(block):
    rng = random.Random(block)
    cases = [c for n in range(3) for c in product(range(1, repair.SYMBOLS), repeat=n)]
    cases += [tuple(rng.choices(range(1, repair.SYMBOLS), k=rng.randrange(3, 25))) for _ in range(400)]
    for case in cases:
        rows = tuple(("", "", "blank") if c == 1 else ("sua?"[(c - 2) // 2], "", "truncated" if c % 2 else "") for c in case)
        assert repair.cheapest(bytes(case), block) == plain(rows)[:2]
    assert len(repair.tables(block).vectors) < 40


def expected(rows):
    """Per conversation what the operator returns, from rows ``(conv_id, turn, role, text)`` in their order."""
    made = {}
    for conv in {r[0] for r in rows}:
        own = [((r[1] is not None, r[1] or 0), " " if r[2] is None else r[2], " " if r[3] is None else r[3]) for r in rows if r[0] == conv]
        own.sort(key=lambda r: r[0])
        seen, faulty = set(), []
        for _, role, text in own:
            end = text.rstrip(" \t\n\x0b\x0c\r")
            fault = "blank" if not end else "duplicate" if (role, text) in seen else "" if end[-1] in ".!?" else "truncated"
            seen.add((role, text))
            faulty.append((role, text, fault))
        turns = [t for (known, t), _, _ in own if known]
        heads = [r[:1] for _, r, _ in own]
        cost, audit, lines = plain(tuple(faulty))
        made[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *[sum(f == k for _, _, f in faulty) for k in ("blank", "duplicate", "truncated")],
            sum(a + b not in ("su", "ua", "au") for a, b in zip(heads, heads[1:])), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return made


def found(frame):
    return {r[0]: tuple(r)[1:] for r in repair.repair(frame).select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()}


def test_conversations_of_any_length(spark):
    """One conversation holds a third of all rows and is cut over tasks and batches; equal rows and turns occur."""
    rng, rows = random.Random(9), []
    texts = ["Yes.", "No!", "Well", "", " \n", "So?\t", "a\x0b.", "é."]
    for conv in [*range(40), None]:
        turn = 0
        for _ in range(250 if conv == 7 else rng.randrange(1, 14)):
            turn += rng.choice([0, 1, 1, 1, 3])
            role = rng.choice(["system", "user", "assistant", "tool", None, ""])
            text = rng.choice(texts) if rng.random() < 0.4 else f"Line {rng.random()}" + rng.choice(["", ".", "?"])
            row = (conv, None if rng.random() < 0.02 else turn, role, text)
            if any(r[:2] == row[:2] for r in rows):
                row = next(r for r in rows if r[:2] == row[:2])  # equal turns hold equal rows
            rows.append(row)
    shuffled = rows[:]
    rng.shuffle(shuffled)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 17)
    try:
        frame = spark.createDataFrame(shuffled, "conv_id long, turn long, role string, text string").repartition(6)
        assert found(frame) == expected(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_edges(spark):
    kind = "conv_id long, turn long, role string, text string, audit string, lead int, cost string, h1 long, symbols int"
    rows = [(1, None, None, None), (2, 5, "user", "x" * 2_000_000), (2, 5, "user", "x" * 2_000_000), (3, 1, "", "."), (4, 1, "user", "Hi."), (4, 2, "assistant", "Ho."), (4, 3, "é", "?")]
    frame = spark.createDataFrame([(*r, "a", 1, "c", 2, 3) for r in rows], kind)
    assert found(frame) == expected(rows)
    assert repair.repair(frame.limit(0)).collect() == []
