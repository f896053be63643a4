"""Helpers shared by the operators: stored intermediates and vectorized text work on Arrow batches."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from moodmill.session import checkpoint_dir

# Bytes of text that one vectorized step works on; longer single texts form a step of their own.
STEP_BYTES = 2 << 20
# Spark cuts Arrow batches by rows; long texts would make such batches huge.
ARROW_BYTES = 8 << 20

# Narrow rows of which up to so many are sent to every task (about 16 MB); more are joined by a shuffle.
BROADCAST_IDS = 1_000_000

SPACES = np.zeros(256, dtype=bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
LOWER_BYTES = LOWER.tobytes()
SPACE = re.compile(rb"[\x20\x09-\x0D]")

BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Cut Arrow batches by bytes as well as by rows."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def stored(df: DataFrame) -> DataFrame:
    """Write an intermediate once to the shared folder and read it from there.

    This cuts lineage like checkpoint(), but computes the rows once only, keeps
    columns apart, and survives the loss of any executor.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/moodmill-llm/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def keyed_rows(rows: DataFrame, ids: DataFrame, key: str, how: str) -> DataFrame:
    """Join rows, which may hold texts, with narrow rows by id; these are broadcast only after counting them."""
    few = ids.count() <= BROADCAST_IDS
    return rows.join(F.broadcast(ids) if few else ids, key, how)


def side_of(ids: DataFrame, rows: int) -> DataFrame:
    """Narrow rows to join with, of which there are ``rows`` at most; many are never broadcast, however well their files compress."""
    return ids if rows <= BROADCAST_IDS else ids.hint("merge")


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; null ids fall into fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % F.lit(modulus), F.lit(0)).cast("int")


# --- vectorized text work -------------------------------------------------------------------


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts of a column and the offsets of each; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or off[-1] == off[0]:
        return np.zeros(0, dtype=np.uint8), off - off[0]
    raw = np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]]
    return raw, off - off[0]


def text_pieces(text: bytes, limit: int = STEP_BYTES // 2) -> Iterator[bytes]:
    """A text in pieces of about ``limit`` bytes that no word crosses."""
    at = 0
    while at < len(text):
        cut = SPACE.search(text, at + limit) if at + limit < len(text) else None
        end = cut.start() if cut else len(text)
        yield text[at:end]
        at = end


def byte_steps(offsets: np.ndarray, limit: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges holding about ``limit`` bytes each; a longer text is a range of its own."""
    rows, lo = len(offsets) - 1, 0
    while lo < rows:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), rows)
        yield lo, hi
        lo = hi


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each maximal run of bytes other than the six ASCII spaces."""
    if not len(data):
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    inside = ~SPACES[data]
    first, last = offsets[:-1], offsets[1:]
    before = np.empty(len(data), dtype=bool)
    before[0], before[1:] = False, inside[:-1]
    before[first[first < last]] = False
    after = np.empty(len(data), dtype=bool)
    after[-1], after[:-1] = False, inside[1:]
    after[last[first < last] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit moves every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(n, 1 << 16)
        for key, base in (("up", BASE), ("down", BASE_INVERSE)):
            line = np.full(size, base, dtype=np.uint64)
            line[0] = 1
            _POWERS[key] = np.cumprod(line, dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, window: int = 1 << 20) -> np.ndarray:
    """64-bit hashes of byte spans in ascending order, from prefix sums over windows of the bytes."""
    out = np.empty(len(starts), dtype=np.uint64)
    lo = 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + window, side="right")))
        a, b = int(starts[lo]), int(ends[hi - 1])
        up, down = _powers(b - a + 1)
        sums = np.zeros(b - a + 1, dtype=np.uint64)
        np.cumsum((data[a:b].astype(np.uint64) + np.uint64(1)) * up[: b - a], out=sums[1:])
        s, e = starts[lo:hi] - a, ends[lo:hi] - a
        out[lo:hi] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        lo = hi
    if len(_POWERS.get("up", ())) > 4 * window:  # one huge text passed
        _POWERS.clear()
    return out


def gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions start, start+1, … of all spans, one after the other."""
    total = int(lengths.sum())
    at = np.cumsum(lengths) - lengths
    return np.repeat(starts - at, lengths) + np.arange(total)
