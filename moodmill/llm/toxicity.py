"""Operator 8: toxicity by multiple-instance learning from document labels.

A document is a bag of sentences. Each sentence gets a probability from its
words, and a document is toxic if any sentence is: noisy-or. Document labels
train the sentence model, which then also says where the offence is.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moodmill.llm.common import bounded_batches, fold, keyed_rows

FOLDS = 5
# Words the sentence model knows: those whose presence tells the classes best apart.
VOCABULARY = 1000
MIN_DOCS = 10
# Labelled documents of each class that the sentence model is fitted on, at most.
MAX_FIT = 20_000
STEPS, RATE, L2 = 300, 0.1, 3e-5
# 0 weighs documents alike, 1 the classes; between them false alarms and misses balance.
BALANCE = 0.5

# Beside itself a word has its beginnings of these lengths as features, since offensive stems take endings.
STEMS = (5, 6, 7)
# Words whose features a worker remembers.
REMEMBERED = 300_000

SENTENCE = re.compile(r"[^.!?\n]+[.!?]*|[.!?]+")
WORD = re.compile(r"[^\W\d_]+")


def word_features(word: str) -> list[str]:
    return [word, *(f"{word[:k]}*" for k in STEMS if len(word) > k)]


class Lookup:
    """The known features of words, remembered from text to text."""

    def __init__(self, known: dict[str, int] | dict[str, float]):
        self.known, self.seen = known, {}

    def of(self, text: str) -> set[str]:
        """Known features of the words of a lower-cased text."""
        found: set[str] = set()
        for word in set(WORD.findall(text)):
            mine = self.seen.get(word)
            if mine is None:
                if len(self.seen) >= REMEMBERED:
                    self.seen.clear()
                mine = self.seen[word] = tuple(f for f in word_features(word) if f in self.known)
            found.update(mine)
        return found


@dataclass(frozen=True)
class SentenceModel:
    """Log-odds of a sentence: bias plus the weights of its words' features, each once."""

    weights: dict[str, float]
    bias: float

    def document(self, text: str, lookup: Lookup) -> tuple[float, int, int, float]:
        """Score, span of the worst sentence in code points, and that sentence's score."""
        clean, at, end, worst = 0.0, 0, 0, -np.inf
        low = text.lower()
        if len(low) != len(text):  # a few letters grow when lower-cased
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        if not lookup.of(low):
            return _sigmoid(self.bias), 0, 0, _sigmoid(self.bias)
        for m in SENTENCE.finditer(low):
            known = lookup.of(m.group())
            if not known:
                continue
            score = self.bias + sum(self.weights[w] for w in sorted(known))
            clean -= np.logaddexp(0.0, score)
            if score > worst:
                at, end, worst = m.start(), m.end(), score
        # Sentences of unknown words only say nothing; together they count as one.
        clean -= np.logaddexp(0.0, self.bias)
        return float(-np.expm1(clean)), at, end, _sigmoid(worst)


def _sigmoid(x: float) -> float:
    return float(1 / (1 + np.exp(-x))) if x >= 0 else float(np.exp(x) / (1 + np.exp(x)))


def _stems(length: int) -> Column:
    longer = F.filter("found", lambda w: F.length(w) > length)
    return F.transform(longer, lambda w: F.concat(F.substring(w, 1, length), F.lit("*")))


def telling_words(docs: DataFrame, size: int = VOCABULARY) -> list[str]:
    """Words whose presence differs most between the classes, by the chi-square of all labelled documents.

    ``docs`` has text and label. Counting is a grouped sum over (word, label);
    only the ``size`` best words reach the driver.
    """
    found = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[\\p{L}]+"), F.lit(0)))
    stems = [_stems(k) for k in STEMS]
    words = docs.select("label", found.alias("found")).select(
        "label", F.explode(F.array_distinct(F.concat("found", *stems))).alias("word")
    )
    totals = docs.agg(F.sum("label").alias("n1"), F.count(F.lit(1)).alias("n")).first()
    n, n1 = float(totals["n"] or 0), float(totals["n1"] or 0)
    if not n1 or n1 == n:
        return []
    by_word = words.groupBy("word").agg(F.count(F.lit(1)).alias("df"), F.sum("label").alias("d1")).filter(F.col("df") >= MIN_DOCS)
    expected = F.col("df") * F.lit(n1 / n)
    lift = (F.col("d1") - expected) / F.sqrt(expected * F.lit(1 - n1 / n) * F.lit(n) / F.greatest(F.lit(1.0), F.lit(n) - F.col("df")))
    best = by_word.select("word", F.abs(lift).alias("z")).orderBy(F.desc("z"), "word").limit(size)
    return [r["word"] for r in best.collect()]


def _bags(vocabulary: list[str]):
    index = {w: i for i, w in enumerate(vocabulary)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = Lookup(index)
        for batch in batches:
            bags = []
            for text in batch.column("text").to_pylist():
                low = (text or "").lower()
                found = [sorted(index[f] for f in lookup.of(m.group())) for m in SENTENCE.finditer(low)]
                bags.append([x for x in found if x])
            yield pa.RecordBatch.from_arrays(
                [batch.column("label"), batch.column("place"), pa.array(bags, pa.list_(pa.list_(pa.int32())))], ["label", "place", "bags"]
            )

    return run


def fit_noisy_or(labels: np.ndarray, bags: list[list[list[int]]], size: int) -> tuple[np.ndarray, float]:
    """Weights and bias that maximise the likelihood of document labels under noisy-or, by Adam steps.

    Every document also holds one sentence without known words, as in scoring.
    """
    rows = [(i, s) for i, bag in enumerate(bags) for s in [[], *bag]]
    doc = np.array([i for i, _ in rows], dtype=np.int64)
    sentence = np.repeat(np.arange(len(rows)), [len(s) for _, s in rows])
    word = np.array([w for _, s in rows for w in s], dtype=np.int64)
    n_docs, weights, bias = len(labels), np.zeros(size), -4.0
    positive = labels.sum() / n_docs
    balance = np.where(labels == 1, positive**-BALANCE, (1 - positive) ** -BALANCE)
    balance /= balance.sum()
    m, v = np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, STEPS + 1):
        score = bias + np.bincount(sentence, weights[word], minlength=len(rows))
        log_clean = np.bincount(doc, -np.logaddexp(0.0, score), minlength=n_docs)
        p = np.clip(-np.expm1(log_clean), 1e-9, 1 - 1e-12)
        # d log-likelihood / d score of a sentence, from both classes of its document
        pull = np.where(labels == 1, (1 - p) / p, -1.0) * balance
        slope = pull[doc] / (1 + np.exp(-score))
        grad = np.append(np.bincount(word, slope[sentence], minlength=size) - L2 * weights, slope.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        weights, bias = weights + move[:-1], float(np.clip(bias + move[-1], -12.0, -2.0))
    return weights, bias


def train_sentence_model(labelled: DataFrame, *, size: int = VOCABULARY, max_fit: int = MAX_FIT) -> SentenceModel:
    """Fits on (text, label) rows; at most ``max_fit`` rows of each class, first in the order of a hash.

    The hash is that of doc_id, where there is one, and text, so copies of a text
    have the share of the sample that they have of the rows; a row that repeats
    another's id and text is in the sample once. Words are chosen from all
    labelled rows; only the fit uses the sample. With one class missing every
    text scores alike, on that class's side.
    """
    bounded_batches(labelled.sparkSession)
    text = F.coalesce("text", F.lit(""))
    place = F.xxhash64(*(["doc_id"] if "doc_id" in labelled.columns else []), text)
    rows = labelled.filter("label IS NOT NULL").select(text.alias("text"), F.col("label").cast("int").alias("label"), place.alias("place"))
    vocabulary = telling_words(rows, size)
    if not vocabulary:
        share = rows.agg(F.avg("label")).first()[0] or 0.0
        return SentenceModel({}, 4.0 if share == 1.0 else -4.0)
    # Only hashes are ordered; texts are then filtered by the last one of their class and stay where they are.
    chosen = F.lit(False)
    for y in (0, 1):
        first = rows.filter(F.col("label") == y).select("place").distinct().orderBy("place").limit(max_fit)
        chosen = chosen | ((F.col("label") == y) & (F.col("place") <= F.lit(first.agg(F.max("place")).first()[0])))
    found = rows.filter(chosen).mapInArrow(_bags(vocabulary), "label int, place long, bags array<array<int>>")
    bags = found.groupBy("label", "place").agg(F.min("bags").alias("bags")).toArrow()
    labels = bags.column("label").to_numpy().astype(np.float64)
    weights, bias = fit_noisy_or(labels, bags.column("bags").to_pylist(), len(vocabulary))
    return SentenceModel({w: float(x) for w, x in zip(vocabulary, weights, strict=True) if abs(x) > 1e-3}, bias)


def score_toxicity(docs: DataFrame, model: SentenceModel, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, worst_start, worst_end and worst_score of each row.

    The worst sentence is given in code points with an exclusive end, 0 and 0 if
    no sentence has a known word. Null and empty texts score as a sentence
    without words. No shuffle.
    """
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = Lookup(model.weights)
        for batch in batches:
            found = [model.document(text or "", lookup) for text in batch.column("text").to_pylist()]
            score, at, end, worst = zip(*found, strict=True) if found else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array(score, pa.float64()), pa.array(at, pa.int64()),
                    pa.array(end, pa.int64()), pa.array(worst, pa.float64()),
                ],
                ["doc_id", "score", "worst_start", "worst_end", "worst_score"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double, worst_start long, worst_end long, worst_score double")


def held_out(doc_id: Column) -> Column:
    return fold(doc_id, FOLDS) == 0


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learns from the labelled rows of all folds but 0 and scores every row of ``docs``.

    Columns: doc_id, held_out, score, predicted, and the worst sentence. Labels
    are read for training only. Ids that are null or have no or several labels
    are scored like others; a null label trains nothing. Repeated rows give a
    row each, an empty table none.
    """
    mine = labels.select("doc_id", F.col("toxic").alias("label")).filter(F.col("label").isin(0, 1) & ~held_out(F.col("doc_id")))
    known = mine.groupBy("doc_id").agg(F.max("label").alias("label"))
    model = train_sentence_model(keyed_rows(docs.select("doc_id", "text"), known, "doc_id", "inner"))
    scored = score_toxicity(docs, model)
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "worst_start", "worst_end", "worst_score",
    )
