"""Operator 3: log-probabilities of texts, summed over all ways to spell their words in known pieces.

The pieces are those of a public vocabulary, and their starting scores follow
from their ranks in it. Expected counts over all segmentations of the distinct
training words turn these into probabilities. The lattice of a word sums over
all its segmentations by a forward recursion in log space. A word met in training
is also a segment of its own: its discounted share of the training tokens joins
the sum, and the discounts are what the lattice of pieces weighs. A text is its
words and an end, and its probability their product.

Words are counted once over all texts, within the tasks first. The commonest are then
scored where the texts are read, and only the others are shuffled to their scores, so
no word of very many rows is a key of any join.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moodmill.llm.common import (
    LOWER,
    LOWER_BYTES,
    bounded_batches,
    byte_steps,
    fold,
    gather,
    span_hashes,
    stored,
    text_buffer,
    text_pieces,
    word_spans,
)

FOLDS = 10
SMOOTHING = 0.1
MARK = "▁"  # starts the first piece of a word
# Steps of expectation-maximisation, and what each piece is given beside its expected count.
ROUNDS, PRIOR = 3, 0.01
# Cells (words times length) of one vectorized step; longer words are steps of their own.
STEP_CELLS = 1 << 18
# Distinct words a task holds before it hands its counts on, and the commonest words that every task is given.
HELD_WORDS, COMMON_WORDS = 400_000, 1 << 16
# A row with a null word is the text's own: its tokens and what its common words add up to.
SUMS = ("words", "known_words", "base", "mixed", "spelled")
WORDS_SCHEMA = (
    "part long, doc_id long, held_out boolean, word string, n long, "
    "words long, known_words long, base double, mixed double, spelled double"
)
NAMES = [f.split()[0] for f in WORDS_SCHEMA.split(", ")]
SCORED = "word string, c long, base double, mixed double, spelled double"


def vocabulary(model: str = "piece_bpe_32k.model") -> tuple[list[str], np.ndarray]:
    """Pieces of a public vocabulary and their starting log-probabilities, by rank as in Zipf's law."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(model))
    pieces = [
        m.id_to_piece(i) for i in range(m.get_piece_size())
        if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))
    ]
    pieces = [p for p in dict.fromkeys(pieces) if MARK not in p[1:] and p.translate(_LOWER_TABLE) == p]
    pieces += [f"<{b:02X}>" for b in range(256)]
    start = -np.log(np.arange(len(pieces)) + 10.0)
    return pieces, start - np.logaddexp.reduce(start)


_LOWER_TABLE = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


class Lattice:
    """Segmentations of many words at a time, by walking a tree of pieces in arrays.

    Code points 0x110000 + b stand for the byte b of characters that are no piece.
    """

    def __init__(self, pieces: list[str]):
        self.size = len(pieces)
        table: dict[tuple[int, int], int] = {}
        ends: dict[int, int] = {}
        nodes = 1
        self.singles = set()
        for i, piece in enumerate(pieces):
            chars = [0x110000 + int(piece[1:3], 16)] if i >= len(pieces) - 256 else [ord(c) for c in piece]
            if len(chars) == 1:
                self.singles.add(chars[0])
            at = 0
            for c in chars:
                if (at, c) not in table:
                    table[at, c] = nodes
                    nodes += 1
                at = table[at, c]
            ends[at] = i
        keys = np.array([(a << 22) | c for a, c in table], dtype=np.int64)
        to = np.array(list(table.values()), dtype=np.int64)
        order = np.argsort(keys)
        self.keys, self.to = keys[order], to[order]
        self.piece = np.full(nodes, -1, dtype=np.int64)
        for at, i in ends.items():
            self.piece[at] = i
        self.reach = max(len(p) for p in pieces[:-256])

    def codes(self, word: str) -> list[int]:
        out = []
        for c in MARK + word:
            code = ord(c)
            if code in self.singles:
                out.append(code)
            else:
                out.extend(0x110000 + b for b in c.encode("utf-8", "replace"))
        return out

    def arcs(self, codes: np.ndarray) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
        """(from, to, rows, pieces) of all pieces found in a matrix of code points, from left to right."""
        n, length = codes.shape
        found = []
        for start in range(length):
            rows, node = np.arange(n), np.zeros(n, dtype=np.int64)
            for stop in range(start + 1, min(length, start + self.reach) + 1):
                key = (node << 22) | codes[rows, stop - 1]
                at = np.searchsorted(self.keys, key)
                at[at == len(self.keys)] = 0
                hit = self.keys[at] == key
                rows, node = rows[hit], self.to[at[hit]]
                if not len(rows):
                    break
                piece = self.piece[node]
                whole = piece >= 0
                if whole.any():
                    found.append((start, stop, rows[whole], piece[whole]))
        return found

    def steps(self, words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places in ``words``, matrix of code points) of words of one length each."""
        coded = [self.codes(w) for w in words]
        lengths = np.array([len(c) for c in coded])
        order = np.argsort(lengths, kind="stable")
        for length in np.unique(lengths):
            same = order[np.searchsorted(lengths[order], length) : np.searchsorted(lengths[order], length, "right")]
            rows = max(1, STEP_CELLS // int(length))
            for lo in range(0, len(same), rows):
                part = same[lo : lo + rows]
                yield part, np.array([coded[i] for i in part], dtype=np.int64)

    def forward(self, arcs, shape: tuple[int, int], scores: np.ndarray) -> np.ndarray:
        alpha = np.full((shape[1] + 1, shape[0]), -np.inf)
        alpha[0] = 0.0
        for start, stop, rows, piece in arcs:
            alpha[stop, rows] = np.logaddexp(alpha[stop, rows], alpha[start, rows] + scores[piece])
        return alpha

    def log_probabilities(self, words: list[str], scores: np.ndarray) -> np.ndarray:
        """Log of the summed probability of all segmentations of each word."""
        out = np.zeros(len(words))
        for places, codes in self.steps(words):
            out[places] = self.forward(self.arcs(codes), codes.shape, scores)[-1]
        return out

    def expected_counts(self, words: list[str], weights: np.ndarray, scores: np.ndarray) -> np.ndarray:
        """How often each piece is expected in the words, over all segmentations."""
        counts = np.zeros(self.size)
        for places, codes in self.steps(words):
            arcs = self.arcs(codes)
            alpha = self.forward(arcs, codes.shape, scores)
            beta = np.full_like(alpha, -np.inf)
            beta[-1] = 0.0
            total = alpha[-1]
            for start, stop, rows, piece in reversed(arcs):
                through = scores[piece] + beta[stop, rows]
                beta[start, rows] = np.logaddexp(beta[start, rows], through)
                share = np.exp(alpha[start, rows] + through - total[rows]) * weights[places][rows]
                counts += np.bincount(piece, share, minlength=self.size)
        return counts


_LATTICES: dict[str, tuple[Lattice, np.ndarray]] = {}


def lattice(model: str) -> tuple[Lattice, np.ndarray]:
    """The lattice of a vocabulary and its starting scores, kept by each Python worker."""
    if model not in _LATTICES:
        pieces, start = vocabulary(model)
        _LATTICES[model] = Lattice(pieces), start
    return _LATTICES[model]


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, c) of (held_out, text): how often each word occurs in training, 0 if in held-out texts only; null is the end."""
    trained: Counter = Counter()
    others: set[bytes] = set()
    ends = 0

    def handed() -> pa.RecordBatch:
        only = [w for w in others if w not in trained]
        words = pa.array([*trained, *only, None], pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([words, pa.array([*trained.values(), *([0] * len(only)), ends], pa.int64())], ["word", "c"])

    for batch in batches:
        for held_out, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()), strict=True):
            ends += not held_out
            for piece in text_pieces(text.as_py() or b""):
                (others if held_out else trained).update(piece.translate(LOWER_BYTES).split())
                if len(trained) + len(others) > HELD_WORDS:
                    yield handed()
                    trained.clear()
                    others.clear()
                    ends = 0
    yield handed()


@dataclass(frozen=True)
class CommonWords:
    """Scores of the commonest words, found by the 64-bit hashes of their bytes."""

    hashes: np.ndarray
    known: np.ndarray
    scores: np.ndarray  # base, mixed, spelled

    @staticmethod
    def of(rows: list) -> CommonWords:
        raw = [r["word"].encode() for r in rows]
        ends = np.cumsum([len(w) for w in raw], dtype=np.int64)
        lengths = np.array([len(w) for w in raw], dtype=np.int64)
        hashes = span_hashes(np.frombuffer(b"".join(raw), dtype=np.uint8), ends - lengths, ends) if raw else np.zeros(0, dtype=np.uint64)
        order = np.argsort(hashes)
        scores = np.array([[r[k] for k in SUMS[2:]] for r in rows], dtype=float).reshape(-1, 3)
        return CommonWords(hashes[order], np.array([r["c"] > 0 for r in rows], dtype=bool)[order], scores[order])

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each hash is one of them, and where."""
        if not len(self.hashes):
            return np.zeros(len(hashes), dtype=bool), np.zeros(len(hashes), dtype=np.int64)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return self.hashes[at] == hashes, at


def _text_words(common: CommonWords):
    """A row of each text with its tokens and the sums of its common words, and rows of its other distinct words.

    Words of one row are told apart by 64-bit hashes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column(3))
            for lo, hi in byte_steps(offsets):
                raw = LOWER[data[offsets[lo] : offsets[hi]]]
                starts, ends, rows = word_spans(raw, offsets[lo : hi + 1] - offsets[lo])
                hashes = span_hashes(raw, starts, ends)
                is_common, place = common.find(hashes)
                whose, where = rows[is_common], place[is_common]
                size = hi - lo
                sums = [np.bincount(rows, minlength=size).astype(np.int64), np.bincount(whose, common.known[where], size).astype(np.int64)]
                sums += [np.bincount(whose, common.scores[where, k], size).astype(float) for k in range(3)]
                part = batch.slice(lo, size)
                none = [pa.nulls(size, pa.string()), pa.nulls(size, pa.int64())]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], *none, *map(pa.array, sums)], NAMES)

                h, r, s, e = (x[~is_common] for x in (hashes, rows, starts, ends))
                order = np.lexsort((h, r))
                h, r = h[order], r[order]
                first = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (r[1:] != r[:-1]))) if len(h) else order
                n = np.diff(np.append(first, len(h)))
                at, row = order[first], pa.array(lo + r[first])
                lengths = e[at] - s[at]
                bounds = np.append(0, np.cumsum(lengths)).astype(np.int32)
                words = pa.StringArray.from_buffers(len(at), pa.py_buffer(bounds), pa.py_buffer(raw[gather(s[at], lengths)]))
                few = [pa.nulls(len(at), t) for t in (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64())]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(row), pa.nulls(len(at), pa.int64()), pa.nulls(len(at), pa.bool_()), words, pa.array(n), *few], NAMES
                )

    return run


def commonest(by_word: DataFrame, most: int) -> list:
    """The commonest words, ``most`` at most: all whose count reaches the lowest eighth of an octave that leaves so few."""
    step = F.floor(F.log2("c") * 8)
    sizes = by_word.filter("c > 0").groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect()
    lowest, held = None, 0
    for row in sizes:
        held += row["count"]
        if held > most:
            break
        lowest = row["step"]
    return [] if lowest is None else by_word.filter((F.col("c") > 0) & (step >= lowest)).collect()


def fit_pieces(words: DataFrame, model: str, rounds: int = ROUNDS) -> np.ndarray:
    """Log-probabilities of the pieces, fitted to the distinct training words (word, c > 0).

    Tasks return expected counts by piece; their sum has one row per piece of the
    vocabulary, whatever the size of the corpus.
    """
    size = lattice(model)[0].size
    real = words.filter("c > 0").select("word")
    scores = lattice(model)[1]

    def share(batches: Iterator[pa.RecordBatch], scores: np.ndarray) -> Iterator[pa.RecordBatch]:
        graph, counts = lattice(model)[0], np.zeros(size)
        for batch in batches:
            counts += graph.expected_counts(batch.column(0).to_pylist(), np.ones(batch.num_rows), scores)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], ["piece", "count"])

    for _ in range(rounds):
        summed = real.mapInArrow(lambda b, s=scores: share(b, s), "piece long, count double").groupBy("piece").agg(F.sum("count"))
        counts = np.full(size, PRIOR)
        for piece, count in summed.collect():
            counts[piece] += count
        scores = np.log(counts) - np.log(counts.sum())
    return scores


def lm_scores(
    docs: DataFrame, *, model: str = "piece_bpe_32k.model", rounds: int = ROUNDS, id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Each row's counts, its base score by smoothed words, and its lattice score, in log10.

    ``score`` is the model's, with learned words beside the lattice of pieces;
    ``lattice_score`` is that of the lattice alone. Rows of fold 0 are held out;
    all others train. A text is its lower-cased words and one end, which also
    counts as a token; a null or empty text is an end alone. Repeated rows are
    scored and counted each for itself; a null id is of fold 0. An empty table
    gives no rows. Tables of words grow with the corpus, while the driver sees
    one number per piece and the ``COMMON_WORDS`` commonest words, which are
    scored in the tasks that read the texts; how many there are changes no result.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    key = F.col(id_col).cast("long")
    rows = docs.select(
        F.monotonically_increasing_id().alias("part"), key.alias("doc_id"), (fold(key, FOLDS) == 0).alias("held_out"),
        F.col(text_col).alias("text"),
    )
    counts = rows.select("held_out", "text").mapInArrow(_count_words, "word string, c long")
    known = stored(counts.groupBy("word").agg(F.sum("c").alias("c")))
    word = F.col("word").isNotNull()
    totals = known.agg(
        F.sum("c").alias("n"), F.count(F.when(F.col("c") > 0, 1)).alias("v"), F.count(F.when(word & (F.col("c") > 0), 1)).alias("types"),
        F.count(F.when(word & (F.col("c") == 1), 1)).alias("once"), F.count(F.when(word & (F.col("c") == 2), 1)).alias("twice"),
        F.sum(F.when(~word, F.col("c"))).alias("ends"),
    ).first()
    n, v, ends = int(totals["n"] or 0), int(totals["v"]), int(totals["ends"] or 0)
    # The usual estimate of the discount; without any counts all weight is the lattice's.
    discount = (totals["once"] + 0.5) / (totals["once"] + 2 * totals["twice"] + 1.0)
    held_back = discount * totals["types"] if totals["types"] else 1.0
    mass = n if totals["types"] else n + 1.0
    scores = fit_pieces(known.filter(word), model, rounds)
    # An end is always seen where anything is; with no training at all it has an even chance.
    end_score = float(np.log10(ends / mass)) if ends else float(np.log10(0.5))
    # For the lattice alone: each word is one more token before the end.
    going_on = float(np.log1p(-min(ends / mass, 0.5))) if ends else float(np.log(0.5))

    def base(c):
        return np.log10((c + SMOOTHING) / (n + SMOOTHING * (v + 1)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph = lattice(model)[0]
        for batch in batches:
            c = batch.column(1).to_numpy()
            own = np.maximum(c - discount, 0.0) / mass
            alone = graph.log_probabilities(batch.column(0).to_pylist(), scores)
            with np.errstate(divide="ignore"):
                mixed = np.logaddexp(np.log(own), alone + np.log(held_back / mass))
            logs = (base(c), mixed / np.log(10), (alone + going_on) / np.log(10))
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, logs)], ["word", "c", *SUMS[2:]])

    by_word = stored(known.filter(word).mapInArrow(score, SCORED))
    common = CommonWords.of(commonest(by_word, COMMON_WORDS))
    # The row's number is made in one job only and read from there: another job may split the files otherwise.
    found = stored(rows.mapInArrow(_text_words(common), WORDS_SCHEMA))
    other = found.filter(word).select("part", "word", "n").join(by_word, "word")
    times = [F.sum(F.col("n") * F.col(k)).alias(f"o_{k}") for k in SUMS[2:]]
    sums = other.groupBy("part").agg(F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("o_known"), *times)
    zero = F.lit(0).cast("long")

    def total(k: str) -> Column:
        return F.col(k) + F.coalesce(F.col(f"o_{k}"), F.lit(0.0))

    return found.filter(~word).drop("word", "n").join(sums, "part", "left").select(
        "doc_id", "held_out",
        (F.col("words") + 1).alias("n_tokens"),
        (F.col("known_words") + F.coalesce("o_known", zero) + F.lit(int(ends > 0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (total("base") + F.lit(float(base(ends)))).alias("base_score"),
        (total("mixed") + F.lit(end_score)).alias("score"),
        (total("spelled") + F.lit(end_score)).alias("lattice_score"),
    )
