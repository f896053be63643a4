"""Conversation repair against a shortest-path search."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from heapq import heappop, heappush

import pytest

from moodmill.llm.conversation import BlockTables, conversation_repair
from moodmill.llm.queries import QUERIES

AFTER = {"": "user", "s": "user", "u": "assistant", "a": "user"}


def cheapest(symbols):
    """(cost, edits) by Dijkstra over (row, last initial); a symbol is (initial or "x", truncated)."""
    heap, done = [(0, "", 0, "")], set()
    while True:
        cost, edits, row, last = heappop(heap)
        if row == len(symbols) and last in ("", "a"):
            return cost, edits
        if (row, last) in done:
            continue
        done.add((row, last))
        turn = AFTER[last][0]
        heappush(heap, (cost + 2, edits + "I", row, turn))
        if row < len(symbols):
            initial, truncated = symbols[row]
            heappush(heap, (cost + 3, edits + "D", row + 1, last))
            if initial != "x":
                heappush(heap, (cost + 2 + truncated, edits + "R", row + 1, turn))
                if initial == turn or (initial == "s" and last == ""):
                    heappush(heap, (cost + truncated, edits + "K", row + 1, initial))


def expected(rows):
    found, out = defaultdict(list), {}
    for conv, turn, role, text in rows:
        kept = found[conv]
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        if kind:
            kept += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    for conv, kept in found.items():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, symbols, faults = set(), [], [0, 0, 0]
        for _, role, text in kept:
            core = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
            fault = 0 if not core else 1 if (role, text) in seen else 2 if core[-1] not in ".!?" else None
            if fault is not None:
                faults[fault] += 1
            symbols.append(("x", 0) if fault in (0, 1) else (role[:1], int(fault == 2)))
            seen.add((role, text))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(kept, kept[1:], strict=False))
        turns = [t for t, _, _ in kept if t is not None]
        gaps = min(max(turns) - min(turns) + 1 - len(set(turns)), 2**63 - 1) if turns else 0
        cost, edits = cheapest(symbols)
        lines, at = [], 0
        for e in edits:
            role, text = ("", "") if e == "I" else kept[at][1:]
            at += e != "I"
            if e != "D":
                last = lines[-1][:1] if lines else ""
                lines.append(f"{role if e == 'K' else AFTER[last]}:{text}")
        out[conv] = (gaps, *faults, illegal, cost, edits, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def repaired(df):
    got = [tuple(r) for r in conversation_repair(df).collect()]
    assert len({r[0] for r in got}) == len(got)
    return {r[0]: r[1:] for r in got}


@pytest.mark.parametrize("block", [1, 3, 4])
def test_tables_find_the_least_audit(block):
    tables, rng = BlockTables(block), random.Random(block)
    assert len(tables.vectors) < 100
    for k in range(1500):
        line = bytes(rng.choice(range(9) if k % 2 else [0, 2, 4, 2, 4, 8, 3]) for _ in range(rng.randrange(13)))
        symbols = [("x", 0) if s == 8 else ("suao"[s // 2], s % 2) for s in line]
        assert tables.repair(line) == cheapest(symbols), line


def test_a_long_conversation_is_linear():
    symbols = bytes(random.Random(3).choice([2, 4, 4, 8, 3, 6]) for _ in range(400_000))
    cost, audit = BlockTables().repair(symbols)
    assert cost > 0 and len(audit.replace("I", "")) == len(symbols)


def test_query_matches_shortest_paths(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r.conv_id: tuple(r)[1:] for r in QUERIES["op11_conversation_repair"](spark, "/root/testdata/sf0.01").collect()}
    assert got == expected(rows)


def test_nulls_ties_and_odd_rows(spark):
    rng = random.Random(5)
    roles = ["user", "assistant", "system", "User", "tool", "", None, "umpire"]
    texts = ["Yes.", "Yes.", "No", "No?  ", "", " \t\r\n", None, ".\x0b", "¿Qué?\n", "a ", "!"]
    rows = [
        (rng.choice([*range(40), None]), rng.choice([None, 0, 1, 2, 2, 3, 7, 11]), rng.choice(roles), rng.choice(texts))
        for _ in range(600)
    ]
    rows += [(500, k, "user", "same.") for k in range(300)] + [(501, -(2**63), "user", "a."), (501, 2**63 - 1, "assistant", "b.")]
    rows += [(502, None, "user", "x" * 300_000)]
    df = spark.createDataFrame([(*r, 1, "q") for r in rows], "conv_id long, turn long, role string, text string, place int, symbol string")
    assert repaired(df.repartition(7)) == expected(rows)


def test_conversations_without_rows_left(spark):
    gone = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(gone, 0, "user", "hello.")], "conv_id long, turn long, role string, text string")
    assert repaired(df) == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert repaired(df.limit(0)) == {}
