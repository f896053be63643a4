"""Exact subword ids of many texts with few calls of the tokenizer library.

A text is cut wherever an ASCII space follows a character that is no space, and
between an ASCII letter and one of a few marks. The tokenizer's own splitting
pattern always ends a match there, and its added token holds neither, so each
part has the same ids alone as in its text. Equal parts are encoded once: a part
is found by a 64-bit hash in a sorted table and then compared byte by byte, so
ids never depend on the hash.
"""

from __future__ import annotations

import os
from itertools import chain

import numpy as np

from moodmill.llm.common import SPACES, gather, span_hashes

# A worker forgets its parts when it holds so many of them, or so many bytes of them.
MAX_PARTS = 1_500_000
MAX_POOL_BYTES = 48 << 20
# Longer parts are encoded each time.
MAX_PART_BYTES = 256
CALL_PARTS = 20_000

LETTERS = np.zeros(256, dtype=bool)
LETTERS[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = True
# Neither the apostrophe of contractions nor a character of the added token.
MARKS = np.zeros(256, dtype=bool)
MARKS[list(b".,;:!?&%$*#")] = True


def part_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the parts of all texts.

    Characters outside ASCII may be spaces too; behind one of their possible
    last bytes no cut is made.
    """
    n = len(data)
    if not n:
        none = np.zeros(0, dtype=np.int64)
        return none, none
    space = SPACES[data]
    cut = np.zeros(n, dtype=bool)
    cut[1:] = space[1:] & ~space[:-1]
    at = np.flatnonzero(cut)
    high = at[data[at - 1] >= 0x80]
    two, three = data[np.maximum(high - 2, 0)], data[np.maximum(high - 3, 0)]
    odd = ((two == 0xC2) & np.isin(data[high - 1], (0x85, 0xA0))) | (
        np.isin(three, (0xE1, 0xE2, 0xE3)) & np.isin(two, (0x80, 0x81, 0x9A))
    )
    cut[high[odd]] = False
    cut[1:] |= MARKS[data[1:]] & LETTERS[data[:-1]]
    first, last = offsets[:-1], offsets[1:]
    cut[first[first < last]] = True
    starts = np.flatnonzero(cut)
    return starts, np.append(starts[1:], n)


class PartEncoder:
    """Ids of parts, kept from batch to batch of one Python worker."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task per core already
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, dtype=np.uint64)  # sorted
        self.rows = np.zeros(0, dtype=np.int64)  # of the key at the same place
        self.n_ids = np.zeros(0, dtype=np.int64)
        self.id_at = np.zeros(0, dtype=np.int64)
        self.n_bytes = np.zeros(0, dtype=np.int64)
        self.byte_at = np.zeros(0, dtype=np.int64)
        self.ids = np.zeros(0, dtype=np.uint32)
        self.pool = np.zeros(0, dtype=np.uint8)

    def _encode(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        lengths, ids = [], []
        for lo in range(0, len(parts), CALL_PARTS):
            found = [e.ids for e in self.tokenizer.encode_batch_fast(parts[lo : lo + CALL_PARTS], add_special_tokens=False)]
            lengths.append(np.fromiter(map(len, found), dtype=np.int64, count=len(found)))
            ids.append(np.fromiter(chain.from_iterable(found), dtype=np.uint32, count=int(lengths[-1].sum())))
        return np.concatenate(lengths), np.concatenate(ids)

    def _add(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Encode parts and append them; returns their rows."""
        raw = data.tobytes() if len(starts) > 64 else None
        texts = [
            (raw[a:b] if raw is not None else data[a:b].tobytes()).decode("utf-8", "replace")
            for a, b in zip(starts.tolist(), ends.tolist(), strict=True)
        ]
        n_ids, ids = self._encode(texts)
        rows = len(self.n_ids) + np.arange(len(starts))
        lengths = ends - starts
        self.id_at = np.append(self.id_at, len(self.ids) + np.cumsum(n_ids) - n_ids)
        self.n_ids = np.append(self.n_ids, n_ids)
        self.ids = np.append(self.ids, ids)
        self.byte_at = np.append(self.byte_at, len(self.pool) + np.cumsum(lengths) - lengths)
        self.n_bytes = np.append(self.n_bytes, lengths)
        self.pool = np.append(self.pool, data[gather(starts, lengths)])
        return rows

    def rows_of(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Rows of the parts, encoding those not seen before."""
        if len(self.n_ids) > MAX_PARTS or len(self.pool) > MAX_POOL_BYTES:
            self.clear()
        hashes = span_hashes(data, starts, ends)
        keys, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        place = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), dtype=bool)
        inside = place < len(self.keys)
        known[inside] = self.keys[place[inside]] == keys[inside]
        row = np.empty(len(keys), dtype=np.int64)
        row[known] = self.rows[place[known]]
        new = np.flatnonzero(~known)
        if len(new):
            row[new] = self._add(data, starts[first[new]], ends[first[new]])
            keep = (ends - starts)[first[new]] <= MAX_PART_BYTES
            kept = new[keep]
            self.keys = np.insert(self.keys, place[kept], keys[kept])
            self.rows = np.insert(self.rows, place[kept], row[kept])
        rows = row[inverse]
        self._compare(data, starts, ends, rows)
        return rows

    def _compare(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, rows: np.ndarray) -> None:
        """Encode again the parts whose bytes differ from those kept under their hash."""
        lengths = ends - starts
        wrong = self.n_bytes[rows] != lengths
        good = np.flatnonzero(~wrong)
        mine = data[gather(starts[good], lengths[good])]
        kept = self.pool[gather(self.byte_at[rows[good]], lengths[good])]
        differ = np.flatnonzero(mine != kept)
        if len(differ):
            bounds = np.cumsum(lengths[good])
            wrong[good[np.searchsorted(bounds, differ, side="right")]] = True
        again = np.flatnonzero(wrong)
        if len(again):
            rows[again] = self._add(data, starts[again], ends[again])

    def counts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Number of ids of each text."""
        if not len(data):
            return np.zeros(len(offsets) - 1, dtype=np.int64)
        starts, ends = part_spans(data, offsets)
        rows = self.rows_of(data, starts, ends)
        total = np.concatenate(([0], np.cumsum(self.n_ids[rows])))
        at = np.searchsorted(starts, offsets)
        return total[at[1:]] - total[at[:-1]]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids, one text after the other, and the offsets of each text in them."""
        if not len(data):
            return np.zeros(0, dtype=np.uint32), np.zeros(len(offsets), dtype=np.int64)
        starts, ends = part_spans(data, offsets)
        rows = self.rows_of(data, starts, ends)
        lengths = self.n_ids[rows]
        total = np.concatenate(([0], np.cumsum(lengths)))
        return self.ids[gather(self.id_at[rows], lengths)], total[np.searchsorted(starts, offsets)]


_ENCODERS: dict[str, PartEncoder] = {}


def part_encoder(path: str) -> PartEncoder:
    """The encoder of this Python worker; workers are reused by later tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PartEncoder(path)
    return _ENCODERS[path]
