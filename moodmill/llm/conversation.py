"""Operator 11: cheapest repair of conversations, by block tables (the Four Russians' way).

The role initials of a repaired conversation are read by four states: nothing yet, a
system turn, a user turn, an assistant turn. A prefix of rows has a least cost for each
state; less their minimum, those vectors are few. So every vector and every block of
``BLOCK`` row symbols have their next vector and added cost in a table, and a
conversation costs one lookup a block. Going back, blocks are expanded row by row: an
edit stays only if it lies on a cheapest path to the end, and of those each state takes
the one whose initial is least, which settles ties.

One shuffle brings a conversation's rows together, twice over: first their symbols, one
byte a row, then the texts in the same order, which are hashed as they pass. A task
holds no texts but those of one batch; what it keeps of a conversation is as long as the
audit that the contract asks for.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from moodmill.llm.common import bounded_batches

BLOCK = 4
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
SPACES = " \t\n\x0b\x0c\r"
LONGEST = (1 << 63) - 1

START, SYSTEM, USER, ASSISTANT = range(4)
FINAL = (START, ASSISTANT)
# The state after a user or assistant turn: only one of the two may follow a state.
NEXT = (USER, USER, ASSISTANT, USER)
# A row's symbol is twice its initial (s, u, a, any other), plus one if it is truncated.
INITIALS = "sua"
ROLES = (SYSTEM, USER, ASSISTANT, None)
GONE = 8
SYMBOLS = 9
LEGAL = {(0, 1), (1, 2), (2, 1)}
FAR = 1 << 20


def row_edits(symbol: int) -> list[tuple[str, int, int, int]]:
    """(initial, state, next state, cost) of each edit of a row with that symbol."""
    edits = [("D", s, s, DELETE) for s in range(4)]
    if symbol < GONE:
        role, extra = ROLES[symbol // 2], TRUNCATED * (symbol % 2)
        edits += [("R", s, to, REROLE + extra) for s, to in enumerate(NEXT)]
        edits += [("K", s, role, extra) for s, to in enumerate(NEXT) if role == to or (role == SYSTEM and s == START)]
    return edits


EDITS = [row_edits(k) for k in range(SYMBOLS)]


def _settled(costs: list[int]) -> tuple[tuple[int, ...], int]:
    """Costs after insertions, less their minimum, and that minimum.

    A state that costs more than an assistant turn, and for START more than that
    and a deletion, is on no cheapest path: what may follow it may follow an
    assistant turn too. So vectors are few.
    """
    for s in (START, SYSTEM, USER, ASSISTANT, USER):
        costs[NEXT[s]] = min(costs[NEXT[s]], costs[s] + INSERT)
    for s, slack in ((START, DELETE), (SYSTEM, 0)):
        if costs[s] > costs[ASSISTANT] + slack:
            costs[s] = FAR
    least = min(costs)
    return tuple(FAR if c >= FAR else c - least for c in costs), least


class BlockTables:
    """Transitions of cost vectors by row and by block, and the edits on cheapest paths."""

    def __init__(self, block: int = BLOCK):
        first, _ = _settled([0, FAR, FAR, FAR])
        self.block, self.vectors, number = block, [first], {first: 0}
        follow, added = [], []
        for vector in self.vectors:
            row = [self._step(vector, k) for k in range(SYMBOLS)]
            for after, _ in row:
                if after not in number:
                    number[after] = len(self.vectors)
                    self.vectors.append(after)
            follow.append([number[after] for after, _ in row])
            added.append([cost for _, cost in row])
        self.row_next, self.row_cost = follow, added
        one, cost = np.array(follow), np.array(added)
        many, total = one, cost
        for _ in range(block - 1):
            total = (total[:, :, None] + cost[many]).reshape(len(one), -1)
            many = one[many].reshape(len(one), -1)
        self.block_next, self.block_cost = many.tolist(), total.tolist()
        self.weights = SYMBOLS ** np.arange(block - 1, -1, -1)
        self._rows: dict[tuple[int, int, int], tuple] = {}
        self._blocks: dict[tuple[int, int, int], tuple] = {}

    @staticmethod
    def _step(vector: tuple[int, ...], symbol: int) -> tuple[tuple[int, ...], int]:
        costs = [FAR] * 4
        for _, s, to, cost in EDITS[symbol]:
            if vector[s] < FAR:
                costs[to] = min(costs[to], vector[s] + cost)
        return _settled(costs)

    def _with_insertions(self, vector: tuple[int, ...], choices: dict[int, tuple[str, int]]) -> tuple[int, tuple]:
        """Which states are on cheapest paths and their next edits, given those that need no insertion first.

        Each state's entry is (edits, state after them); insertions come before
        the row's edit wherever their initial is less than that of the edit itself.
        """
        # Insertions lead to dearer states, so those are settled first.
        for s in sorted(range(4), key=lambda s: -vector[s]):
            to = NEXT[s]
            if vector[s] < FAR and vector[s] + INSERT == vector[to] and to in choices:
                if s not in choices or "I" < choices[s][0]:
                    choices[s] = ("I" + choices[to][0], choices[to][1])
        return sum(1 << s for s in choices), tuple(choices.get(s) for s in range(4))

    def _row_back(self, v: int, symbol: int, live: int) -> tuple[int, tuple]:
        key = (v, symbol, live)
        if key not in self._rows:
            vector, after, cost = self.vectors[v], self.vectors[self.row_next[v][symbol]], self.row_cost[v][symbol]
            choices: dict[int, tuple[str, int]] = {}
            for label, s, to, price in EDITS[symbol]:
                if vector[s] < FAR and live >> to & 1 and vector[s] + price == after[to] + cost:
                    choices[s] = min(choices.get(s, (label, to)), (label, to))
            self._rows[key] = self._with_insertions(vector, choices)
        return self._rows[key]

    def _block_back(self, v: int, symbols: tuple[int, ...], code: int, live: int) -> tuple[int, tuple]:
        """A block expanded backward: its rows' vectors from the left, its edits from the right."""
        key = (v, code, live)
        if key not in self._blocks:
            inner = [v]
            for k in symbols[:-1]:
                inner.append(self.row_next[inner[-1]][k])
            path: tuple = tuple(("", s) for s in range(4))
            for at, k in zip(reversed(inner), reversed(symbols), strict=True):
                live, row = self._row_back(at, k, live)
                path = tuple(e and (e[0] + path[e[1]][0], path[e[1]][1]) for e in row)
            self._blocks[key] = live, path
        return self._blocks[key]

    def repair(self, symbols: bytes | bytearray) -> tuple[int, str]:
        """Least cost, and the initials of the cheapest edits, ASCII-least among equals."""
        line = np.frombuffer(symbols, dtype=np.uint8)
        whole = len(line) // self.block
        blocks = line[: whole * self.block].reshape(whole, self.block)
        codes = (blocks @ self.weights).tolist()
        v, total, bounds = 0, 0, []
        for code in codes:
            bounds.append(v)
            total += self.block_cost[v][code]
            v = self.block_next[v][code]
        tail = []
        for k in line[whole * self.block :].tolist():
            tail.append((v, k))
            total += self.row_cost[v][k]
            v = self.row_next[v][k]

        vector = self.vectors[v]
        least = min(vector[s] for s in FINAL)
        live, last = self._with_insertions(vector, {s: ("", s) for s in FINAL if vector[s] == least})
        paths = [last]
        for at, k in reversed(tail):
            live, path = self._row_back(at, k, live)
            paths.append(path)
        for at, row, code in zip(reversed(bounds), blocks[::-1].tolist(), reversed(codes), strict=True):
            live, path = self._block_back(at, tuple(row), code, live)
            paths.append(path)
        edits, state = [], START
        for path in reversed(paths):
            label, state = path[state]
            edits.append(label)
        return total + least, "".join(edits)


@cache
def block_tables() -> BlockTables:
    return BlockTables()


class _Conversation:
    """What a task keeps of the conversation that passes: a byte a row, then its audit and a hash."""

    def __init__(self, conv_id: int | None):
        self.conv_id = conv_id
        self.symbols, self.faults, self.illegal = bytearray(), [0, 0, 0, 0], 0
        self.initial = self.least = self.most = None
        self.turns = 0
        self.audit: str | None = None

    def note(self, turn: int | None, symbol: int, initial: int, fault: int) -> None:
        self.symbols.append(symbol)
        self.faults[fault] += 1
        if self.initial is not None and (self.initial, initial) not in LEGAL:
            self.illegal += 1
        self.initial = initial
        if turn is not None and turn != self.most:
            self.least = turn if self.least is None else self.least
            self.most = turn
            self.turns += 1

    def solve(self) -> None:
        self.cost, self.audit = block_tables().repair(self.symbols)
        self.at, self.hash, self.lines, self.user_next = 0, hashlib.sha256(), 0, True

    def _line(self, role: str, text: str) -> None:
        self.hash.update((("\n" if self.lines else "") + role + ":" + text).encode("utf-8", "replace"))
        self.lines += 1
        self.user_next = role[:1] != "u"

    def _next_role(self) -> str:
        return "user" if self.user_next else "assistant"

    def _insert(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self._line(self._next_role(), "")
            self.at += 1

    def write(self, role: str, text: str) -> None:
        if self.audit is None:
            self.solve()
        self._insert()
        edit = self.audit[self.at]
        self.at += 1
        if edit != "D":
            self._line(role if edit == "K" else self._next_role(), text)

    def result(self) -> tuple:
        if self.audit is None:
            self.solve()
        self._insert()
        gaps = 0 if self.most is None else min(self.most - self.least + 1 - self.turns, LONGEST)
        return (self.conv_id, gaps, *self.faults[1:], self.illegal, self.cost, self.audit, self.hash.hexdigest())


RESULT = (
    "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, "
    "audit string, repaired_sha256 string"
)
_TYPES = [pa.int64()] * 7 + [pa.string()] * 2
_NAMES = [f.split()[0] for f in RESULT.split(", ")]


def _repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now: _Conversation | None = None

    def rows(done: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), _TYPES, strict=True)], _NAMES)

    for batch in batches:
        done = []
        columns = (c.to_pylist() for c in batch.columns)
        for conv_id, writing, dropped, turn, symbol, initial, fault, role, text in zip(*columns, strict=True):
            if now is None or now.conv_id != conv_id:
                if now is not None:
                    done.append(now.result())
                now = _Conversation(conv_id)
            if writing:
                now.write(role, text)
            elif not dropped:
                now.note(turn, symbol, initial, fault)
        if done:
            yield rows(done)
    if now is not None:
        yield rows([now.result()])


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and dropped of each row, damaged by its hash; repeated rows are there twice."""
    blank = F.lit(" ")
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    kind = (F.crc32(name.cast("binary")) % 20).cast("int")
    text = F.coalesce(F.col("text"), blank)
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.when(kind == 4, "user").otherwise(F.coalesce(F.col("role"), blank)).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        (kind == 0).alias("dropped"),
        F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def repair_conversations(rows: DataFrame) -> DataFrame:
    """Faults, least cost, edits and the hash of the repaired text of each conversation.

    ``rows`` have conv_id, turn, role and text as ``damaged`` gives them; those
    marked ``dropped`` only name their conversation. Rows go by turn, nulls first,
    then role and text. A null conv_id is a conversation of its own. A role counts
    by its first letter. ``gaps`` stops at the largest long. An empty table gives
    no rows.
    """
    bounded_batches(rows.sparkSession)
    last = F.rtrim("text", F.lit(SPACES))
    blank = last == ""
    order = [F.asc_nulls_first("turn"), F.asc("role"), F.asc("text")]
    seen = F.row_number().over(Window.partitionBy("conv_id", "dropped", "role", "text").orderBy(*order)) > 1
    first = F.substring("role", 1, 1)
    initial = F.coalesce(*(F.when(first == c, k) for k, c in enumerate(INITIALS)), F.lit(len(INITIALS)))
    fault = F.when(blank, 1).when(F.col("seen"), 2).when(~F.substring(last, -1, 1).isin(".", "!", "?"), 3).otherwise(0)
    judged = (
        rows.repartition("conv_id")
        .withColumn("seen", seen)
        .withColumn("place", F.row_number().over(Window.partitionBy("conv_id", "dropped").orderBy(*order)))
        .withColumns({"fault": fault, "initial": initial})
    )
    symbol = F.when(F.col("fault").isin(1, 2), GONE).otherwise(F.col("initial") * 2 + (F.col("fault") == 3).cast("int"))
    twice = F.explode(F.when(F.col("dropped"), F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True))))
    passes = judged.select(
        "conv_id", twice.alias("writing"), "dropped", "turn", symbol.alias("symbol"), "initial", "fault", "role", "text", "place"
    )
    ordered = passes.withColumn("text", F.when(F.col("writing"), F.col("text"))).sortWithinPartitions("conv_id", "writing", "place")
    return ordered.drop("place").mapInArrow(_repair, RESULT)


def conversation_repair(conversations: DataFrame) -> DataFrame:
    """``repair_conversations`` of the damaged rows; a conversation whose rows are all dropped has zeros.

    Nulls read one space, in the hashed name too; extra columns are ignored.
    """
    return repair_conversations(damaged(conversations))
