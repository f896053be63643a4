"""A small student classifier trained on a teacher's soft labels.

The target is the teacher's tempered distribution alone; no hard labels. Each
row becomes three weighted rows, one per class, which makes multinomial logistic
regression minimise exactly the cross-entropy to the soft target. A student is
always fitted from teacher labels: nothing here takes an earlier student.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moodmill.functions.scoring import softmax, tempered
from moodmill.functions.text import SPACE, aspect_window, collapse_space
from moodmill.operators.sampling import seeded_budget
from moodmill.schemas import PROBS

ASPECT_PREFIX = "aspect="


@dataclass(frozen=True)
class DistillConfig:
    temperature: float = 3.0
    max_sequences: int = 1_840_000
    # Share of all training rows that are aspect pairs, if there are any.
    aspect_fraction: float = 0.25
    num_features: int = 1 << 18
    max_iter: int = 50
    reg: float = 1e-6
    seed: int = 13


def word_tokens(text: Column | str) -> Column:
    return F.split(F.lower(collapse_space(text)), rf"(?U){SPACE}+")


def doc_tokens(df: DataFrame) -> DataFrame:
    return df.withColumn("tokens", word_tokens("text"))


def aspect_tokens(df: DataFrame) -> DataFrame:
    """Words around the aspect, and the aspect's own words marked as such."""
    own = F.transform(word_tokens("aspect"), lambda w: F.concat(F.lit(ASPECT_PREFIX), w))
    return df.withColumn("tokens", F.concat(word_tokens(aspect_window("text", "aspect")), own))


def soft_rows(labeled: DataFrame, temperature: float) -> DataFrame:
    """Three rows per labelled row: class index and its tempered probability."""
    choices = F.array(
        *[
            F.struct(F.lit(float(i)).alias("target"), p.alias("weight"))
            for i, p in enumerate(tempered(temperature))
        ]
    )
    return labeled.withColumn("_c", F.explode(choices)).select("*", "_c.*").drop("_c")


def fit_student(tokenized: DataFrame, cfg: DistillConfig) -> PipelineModel:
    """Features are hashed, so the model's size is fixed whatever the corpus."""
    tf = HashingTF(inputCol="tokens", outputCol="tf", numFeatures=cfg.num_features)
    counted = tf.transform(tokenized.select("tokens", *PROBS)).drop("tokens").persist()
    try:
        idf = IDF(inputCol="tf", outputCol="features").fit(counted)
        # Words are hashed once per document, not once per class.
        rows = soft_rows(idf.transform(counted), cfg.temperature).select("features", "target", "weight")
        logistic = LogisticRegression(
            featuresCol="features", labelCol="target", weightCol="weight", family="multinomial",
            maxIter=cfg.max_iter, regParam=cfg.reg,
        )
        return PipelineModel([tf, idf, logistic.fit(rows)])
    finally:
        counted.unpersist()


def distill_student(labeled: DataFrame, cfg: DistillConfig = DistillConfig()) -> PipelineModel:
    """Student for whole documents, from (platform, doc_id, text, p_*)."""
    budget = seeded_budget(labeled, cfg.max_sequences, cfg.seed, ("platform", "doc_id"))
    return fit_student(doc_tokens(budget), cfg)


def aspect_budget(n_docs: int, n_pairs: int, fraction: float) -> int:
    """How many pairs make up ``fraction`` of documents and pairs together."""
    if not 0 < fraction <= 0.5:
        raise ValueError(f"aspect_fraction must be in (0, 0.5], got {fraction}")
    return min(n_pairs, int(n_docs * fraction / (1 - fraction)))


def distill_aspect_student(pairs: DataFrame, n_docs: int, cfg: DistillConfig = DistillConfig()) -> PipelineModel:
    """Student for (text, aspect), from (platform, doc_id, text, aspect, p_*)."""
    n = aspect_budget(min(n_docs, cfg.max_sequences), pairs.count(), cfg.aspect_fraction)
    budget = seeded_budget(pairs, n, cfg.seed + 1, ("platform", "doc_id", "aspect"))
    return fit_student(aspect_tokens(budget), cfg)


@dataclass(frozen=True)
class StudentBackend:
    """Scores with a fitted student. Its logits were fitted at the temperature,
    so they are scaled back by it."""

    model: PipelineModel
    temperature: float = 3.0

    def probabilities(self, df: DataFrame, text: str = "text", aspect: str | None = None) -> DataFrame:
        named = df.withColumnRenamed(text, "text") if text != "text" else df
        tokenized = aspect_tokens(named) if aspect else doc_tokens(named)
        raw = self.model.transform(tokenized).withColumn("_raw", vector_to_array("rawPrediction"))
        logits = [F.col("_raw")[i] * self.temperature for i in range(3)]
        out = raw.withColumns(dict(zip(PROBS, softmax(*logits), strict=True)))
        return out.select(*df.columns, *PROBS) if text == "text" else out.select(
            *[F.col("text").alias(text) if c == text else F.col(c) for c in df.columns], *PROBS
        )


def model_digest(model: PipelineModel) -> str:
    """Identity of a fitted student, from its weights."""
    last = model.stages[-1]
    digest = hashlib.sha256(last.coefficientMatrix.toArray().tobytes())
    digest.update(last.interceptVector.toArray().tobytes())
    return digest.hexdigest()
