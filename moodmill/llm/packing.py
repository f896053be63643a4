"""Operator 10: packing token sequences by exact complements, then best fit."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from moodmill.llm.bpe import part_encoder
from moodmill.llm.common import bounded_batches, byte_steps, stored, text_buffer

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = f"{PIECES}, sequence_id long, offset long"
# Ranks within one length are taken in so many parts, so that a frequent length is no single group.
RANK_PARTS = 64


def document_pieces(
    docs: DataFrame, capacity: int, *, tokenizer: str = "byte_bpe_50k.json", end_id: int = 0,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """A row per piece: its place in the document's ids, its length, and the checksum of its ids.

    Documents of more than ``capacity`` ids are cut into pieces of ``capacity``;
    what is left over is the first piece.
    """
    bounded_batches(docs.sparkSession)
    path = public_tokenizers.path(tokenizer)
    end = np.array([end_id], dtype="<u4").tobytes()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = part_encoder(path)
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            doc_row, piece, start, length, crc = [], [], [], [], []
            for lo, hi in byte_steps(offsets):
                ids, at = encoder.encode(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                raw, at = memoryview(ids.astype("<u4").tobytes()), at.tolist()
                for row in range(hi - lo):
                    a, n = at[row], at[row + 1] - at[row] + 1
                    begin, k = 0, 0
                    size = n if n <= capacity else n % capacity or capacity
                    while begin < n:
                        stop = begin + size
                        value = zlib.crc32(raw[4 * (a + begin) : 4 * (a + min(stop, n - 1))])
                        crc.append(zlib.crc32(end, value) if stop == n else value)
                        doc_row.append(lo + row)
                        piece.append(k)
                        start.append(begin)
                        length.append(size)
                        begin, size, k = stop, capacity, k + 1
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(doc_row, pa.int64())), pa.array(piece, pa.int32()),
                    pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()),
                ],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(pieces, PIECES)


@dataclass(frozen=True)
class Fill:
    """``times`` sequences that each hold ``items``: (length, how often), in order."""

    times: int
    items: tuple[tuple[int, int], ...]


class _Gaps:
    """Index from a sum to the lengths that make it up: singles, pairs and triples.

    A sum maps to the largest members of its combinations, which are hashed when
    a gap first asks for the sum. A combination is taken if enough of its lengths
    are left. As lengths only ever run out, one that cannot be taken is dropped
    from its sum for good, so that no combination is tried twice in vain.
    """

    def __init__(self, counts: np.ndarray):
        self.counts = counts
        self.pairs: dict[int, list[int]] = {}
        self.triples: dict[int, list[int]] = {}

    def _members(self, low: int, high: int) -> list[int]:
        """Lengths left in [low, high], ascending, so that the largest is last."""
        return (np.flatnonzero(self.counts[low : high + 1]) + low).tolist() if low <= high else []

    def single(self, gap: int) -> tuple[int, ...] | None:
        return (gap,) if self.counts[gap] else None

    def _pair_sums(self, gap: int) -> list[int]:
        if gap not in self.pairs:
            self.pairs[gap] = [a for a in self._members((gap + 1) // 2, gap - 1) if self.counts[gap - a]]
        return self.pairs[gap]

    def pair(self, gap: int) -> tuple[int, ...] | None:
        """The pair with the largest member."""
        sums = self._pair_sums(gap)
        while sums:
            a, b = sums[-1], gap - sums[-1]
            if self.counts[a] > (a == b) and self.counts[b]:
                return a, b
            sums.pop()
        return None

    def triple(self, gap: int) -> tuple[int, ...] | None:
        """The triple with the largest member that a pair sum completes with no larger ones."""
        if gap not in self.triples:
            self.triples[gap] = self._members(-(-gap // 3), gap - 2)
        sums = self.triples[gap]
        while sums:
            a = sums[-1]
            # The pair's own look drops what has run out from its sum.
            for b in reversed(self.pairs[gap - a] if self.pair(gap - a) else []):
                need = (a, b, gap - a - b)
                if b <= a and all(self.counts[x] >= need.count(x) for x in need):
                    return need
            sums.pop()
        return None


def plan_fills(counts: np.ndarray, capacity: int) -> list[Fill]:
    """Fills that use up a histogram of lengths (``counts[length]``), largest lengths first.

    For each largest length left, its gap is closed by a single length, a pair or
    a triple that sums to it exactly, as often as their counts allow; where none
    does, the largest length that fits goes in and the smaller gap is tried again.
    Identical sequences are planned together, so the work depends on the capacity
    and not on the number of rows.
    """
    counts = counts.copy()
    gaps, fills = _Gaps(counts), []

    def spread(items: list[int]) -> dict[int, int]:
        return {x: items.count(x) for x in items}

    top = capacity
    while True:
        while top and not counts[top]:
            top -= 1
        if not top:
            return fills
        chosen, gap = [top], capacity - top
        counts[top] -= 1
        while gap:
            exact = gaps.single(gap) or gaps.pair(gap) or gaps.triple(gap)
            if exact:
                more: tuple[int, ...] = exact
            else:
                fitting = np.flatnonzero(counts[: gap + 1])
                if not len(fitting):
                    break
                more = (int(fitting[-1]),)
            for x in more:
                chosen.append(x)
                counts[x] -= 1
                gap -= x
        need = spread(chosen)
        times = 1 + min(int(counts[x]) // k for x, k in need.items())
        for x, k in need.items():
            counts[x] -= k * (times - 1)
        fills.append(Fill(times, tuple(sorted(need.items(), reverse=True))))


def _places(fills: list[Fill]) -> dict[str, np.ndarray]:
    """For each length, which ranks go to which sequences: sorted by (length, first rank)."""
    used: dict[int, int] = {}
    rows, first_sequence = [], 0
    for fill in fills:
        offset = 0
        for length, often in fill.items:
            rank = used.get(length, 0)
            rows.append((length, rank, first_sequence, often, offset))
            used[length] = rank + often * fill.times
            offset += length * often
        first_sequence += fill.times
    table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)
    return {"key": (table[:, 0] << 44) + table[:, 1], "rank": table[:, 1], "sequence": table[:, 2], "often": table[:, 3], "offset": table[:, 4]}


def pack_pieces(pieces: DataFrame, capacity: int) -> DataFrame:
    """Adds sequence_id and offset to pieces of at most ``capacity`` ids.

    The driver sees a histogram of at most ``capacity`` lengths and plans from
    it. Pieces are then numbered within their length (per length and hash part,
    with the parts' counts added up), and a number is a place in the plan.
    """
    histogram = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in pieces.groupBy("length").count().collect():
        histogram[length] = n
    plan = _places(plan_fills(histogram, capacity))

    part = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(RANK_PARTS)).cast("int")
    keyed = pieces.withColumn("part", part)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = keyed.groupBy("length", "part").count().select(
        "length", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("earlier")
    )
    within = Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")
    ranked = keyed.withColumn("nth", F.row_number().over(within)).join(parts, ["length", "part"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("earlier") + F.col("nth") - 1).alias("rank")
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column(3).to_numpy(zero_copy_only=False)
            rank = batch.column(5).to_numpy(zero_copy_only=False)
            at = np.searchsorted(plan["key"], (length << 44) + rank, side="right") - 1
            nth = rank - plan["rank"][at]
            sequence = plan["sequence"][at] + nth // plan["often"][at]
            offset = plan["offset"][at] + nth % plan["often"][at] * length
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(sequence), pa.array(offset)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return ranked.mapInArrow(place, PACKED)


def pack_documents(docs: DataFrame, *, capacity: int = 2048, tokenizer: str = "byte_bpe_50k.json",
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packs whole documents, each closed by id 0, into sequences of at most ``capacity`` ids.

    Null and empty texts hold the closing id only. Repeated rows, also of one id,
    are packed each for itself; null ids are packed like others. An empty table
    gives no rows. Other columns of the input are ignored.
    """
    pieces = stored(document_pieces(docs, capacity, tokenizer=tokenizer, id_col=id_col, text_col=text_col))
    return pack_pieces(pieces, capacity)
