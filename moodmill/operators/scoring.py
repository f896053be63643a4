"""Scoring documents and (document, aspect) pairs with a pluggable backend."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from moodmill.functions import scoring as S
from moodmill.functions.text import LABEL_SYNONYMS, aspect_window
from moodmill.operators.ranking import LONG_TEXT
from moodmill.schemas import PROBS

SCORE_COLUMNS = ("label", "confidence", "polarity", *PROBS)


class Backend(Protocol):
    """Adds the three probability columns to a DataFrame with a text column."""

    def probabilities(self, df: DataFrame, text: str, aspect: str | None = None) -> DataFrame: ...


@dataclass(frozen=True)
class LexiconBackend:
    """Word counts and a softmax: built-in expressions only."""

    lexicon: S.Lexicon = S.DEFAULT_LEXICON
    radius: int = 40

    def probabilities(self, df: DataFrame, text: str, aspect: str | None = None) -> DataFrame:
        source = aspect_window(text, aspect, self.radius) if aspect else F.col(text)
        words = df.withColumn("_words", S.tokens(source, self.lexicon.trimmed))
        counted = words.withColumns(
            {
                "_neg": S.count_in("_words", self.lexicon.negative),
                "_pos": S.count_in("_words", self.lexicon.positive),
            }
        )
        probs = S.probabilities(F.col("_neg"), F.col("_pos"))
        return counted.withColumns(dict(zip(PROBS, probs, strict=True))).drop("_words", "_neg", "_pos")


def _chunks(lengths: Sequence[int], size: int, long_text: int) -> Iterator[slice]:
    """Consecutive slices of at most ``size``, halved where a text is long."""
    for start in range(0, len(lengths), size):
        stop = min(start + size, len(lengths))
        middle = start + (stop - start) // 2
        if stop - start > 1 and max(lengths[start:stop]) > long_text:
            yield slice(start, middle)
            yield slice(middle, stop)
        else:
            yield slice(start, stop)


@dataclass(frozen=True)
class ModelBackend:
    """An external model.

    ``load`` runs once per task and returns ``classify(texts)``, or
    ``classify(texts, aspects)`` for pairs, giving one probability triple per
    text. Rows are spread by range of text length and sorted within each task,
    so a batch pads to texts of its own length. Each answer must have one triple
    per text: anything else is an error, never a silent misalignment.
    """

    load: Callable[[], Callable[..., Iterable[Sequence[float]]]]
    batch_size: int = 32
    partitions: int | None = None
    long_text: int = LONG_TEXT
    halve_long: bool = True
    keys: tuple[str, ...] = field(default=("platform", "doc_id"))

    def probabilities(self, df: DataFrame, text: str, aspect: str | None = None) -> DataFrame:
        sort = [F.length(text), *[F.col(k) for k in (*self.keys, *([aspect] if aspect else []))]]
        if self.partitions:
            spread = df.repartitionByRange(self.partitions, *sort)
        else:
            spread = df.repartitionByRange(*sort)
        schema = T.StructType(
            df.schema.fields + [T.StructField(p, T.DoubleType()) for p in PROBS]
        )
        load, size = self.load, self.batch_size
        long_text = self.long_text if self.halve_long else 2**31

        def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            classify = load()
            for frame in frames:
                texts = frame[text].fillna("").tolist()
                aspects = frame[aspect].tolist() if aspect else None
                triples = np.zeros((len(texts), 3))
                for part in _chunks([len(t) for t in texts], size, long_text):
                    args = (texts[part],) if aspects is None else (texts[part], aspects[part])
                    answer = list(classify(*args))
                    if len(answer) != len(texts[part]):
                        raise RuntimeError(
                            f"model returned {len(answer)} predictions for {len(texts[part])} texts"
                        )
                    triples[part] = np.asarray(answer, dtype=float).reshape(-1, 3)
                for i, name in enumerate(PROBS):
                    frame[name] = triples[:, i]
                yield frame

        return spread.sortWithinPartitions(*sort).mapInPandas(score, schema)


DEFAULT_BACKEND = LexiconBackend()


def with_scores(df: DataFrame) -> DataFrame:
    """Label, confidence and polarity from the probability columns."""
    return df.withColumns(
        {"label": S.label(), "confidence": S.confidence(), "polarity": S.polarity()}
    )


def score_documents(df: DataFrame, backend: Backend = DEFAULT_BACKEND, text: str = "text") -> DataFrame:
    return with_scores(backend.probabilities(df, text))


def aspect_pairs(df: DataFrame, aspects: Sequence[str] | str = "aspects") -> DataFrame:
    """One row per (document, aspect): a shared list, or each document's own
    array column. Documents without aspects yield none."""
    if isinstance(aspects, str):
        rest = [c for c in df.columns if c != aspects]
        return df.select(*rest, F.posexplode(aspects).alias("aspect_index", "aspect"))
    shared = F.array(*[F.lit(a) for a in aspects]) if aspects else F.array().cast("array<string>")
    return df.select("*", F.posexplode(shared).alias("aspect_index", "aspect"))


def score_aspects(df: DataFrame, aspects: Sequence[str] | str = "aspects",
                  backend: Backend = DEFAULT_BACKEND, text: str = "text") -> DataFrame:
    return with_scores(backend.probabilities(aspect_pairs(df, aspects), text, "aspect"))


def reorder_probabilities(df: DataFrame, raw: str, model_labels: Sequence[str]) -> DataFrame:
    """Probability columns from a model's own array, whose class order is given
    by its labels. An incomplete or unknown label set is an error."""
    wanted = {c: None for c in S.CLASSES}
    for i, name in enumerate(model_labels):
        for c in S.CLASSES:
            if name.lower() in LABEL_SYNONYMS[c]:
                wanted[c] = i
    if len(model_labels) != 3 or any(v is None for v in wanted.values()):
        raise ValueError(f"unexpected label set from model: {list(model_labels)}")
    return df.withColumns({f"p_{c}": F.element_at(raw, i + 1) for c, i in wanted.items()})


