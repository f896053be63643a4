"""Joins and splits between the training set and its label tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moodmill.functions.aspects import mine_aspects
from moodmill.operators.filters import version_pin
from moodmill.operators.sampling import hash_cap
from moodmill.schemas import PROBS

DOC_KEY = ("platform", "doc_id")
PAIR_KEY = ("platform", "doc_id", "aspect")

# Fixed value: aspects kept per document, unless a caller asks for all.
MAX_ASPECTS_PER_DOC = 2


def unlabeled(rows: DataFrame, labels: DataFrame, teacher_version: str,
              key: Sequence[str] = DOC_KEY) -> DataFrame:
    """Rows with no label of this version."""
    done = version_pin(labels, teacher_version).select(*key)
    return rows.join(done, list(key), "left_anti")


def unlabeled_docs(train: DataFrame, labels: DataFrame, teacher_version: str) -> DataFrame:
    return unlabeled(train, labels, teacher_version, DOC_KEY)


def unlabeled_pairs(pairs: DataFrame, labels: DataFrame, teacher_version: str) -> DataFrame:
    return unlabeled(pairs, labels, teacher_version, PAIR_KEY)


def label_stats(rows: DataFrame, labels: DataFrame, teacher_version: str,
                key: Sequence[str] = DOC_KEY) -> DataFrame:
    """total, already labelled and still to label, from one join."""
    done = version_pin(labels, teacher_version).select(*key).distinct().withColumn("_done", F.lit(1))
    joined = rows.select(*key).join(done, list(key), "left")
    return joined.agg(
        F.count("*").alias("total"),
        F.count("_done").alias("already_labeled"),
        (F.count("*") - F.count("_done")).alias("to_label"),
    )


def train_label_join(train: DataFrame, labels: DataFrame, teacher_version: str) -> DataFrame:
    """Documents with their soft labels of one version."""
    soft = version_pin(labels, teacher_version).select(*DOC_KEY, *PROBS)
    return train.select(*DOC_KEY, "text").join(soft, list(DOC_KEY))


def train_aspect_join(train: DataFrame, labels: DataFrame, teacher_version: str) -> DataFrame:
    """(document, aspect) pairs with their soft labels of one version."""
    soft = version_pin(labels, teacher_version).select(*PAIR_KEY, *PROBS)
    return train.select(*DOC_KEY, "text").join(soft, list(DOC_KEY))


def all_mined_pairs(train: DataFrame, mine=mine_aspects, docs_cap: int | None = None,
                    per_doc: int | None = MAX_ASPECTS_PER_DOC) -> DataFrame:
    """(document, aspect) pairs of all documents, or of a reproducible slice of
    them, cut before mining. ``mine`` maps a text column to an array column;
    ``per_doc`` None keeps all its aspects."""
    docs = train.select(*DOC_KEY, "text")
    if docs_cap is not None:
        docs = hash_cap(docs, docs_cap, DOC_KEY)
    kept = F.array_distinct(mine(F.col("text")))
    if per_doc is not None:
        kept = F.slice(kept, 1, per_doc)
    return docs.select(*DOC_KEY, "text", F.explode(kept).alias("aspect"))


def mined_pairs(train: DataFrame, mine=mine_aspects, docs_cap: int | None = None,
                max_pairs: int | None = None, per_doc: int | None = MAX_ASPECTS_PER_DOC) -> DataFrame:
    """The pair set; both caps are part of a labelling budget, if there is one."""
    pairs = all_mined_pairs(train, mine, docs_cap, per_doc)
    return pairs if max_pairs is None else hash_cap(pairs, max_pairs, PAIR_KEY)


def align_student_teacher(student: DataFrame, teacher: DataFrame,
                          key: Sequence[str] = DOC_KEY) -> DataFrame:
    """Student (s_*) and teacher (t_*) probabilities row by row."""
    s = student.select(*key, *[F.col(p).alias(f"s_{p}") for p in PROBS])
    t = teacher.select(*key, *[F.col(p).alias(f"t_{p}") for p in PROBS])
    return s.join(t, list(key))


def check_aligned(student: DataFrame, teacher: DataFrame, key: Sequence[str] = DOC_KEY) -> None:
    """Raise unless both sides hold exactly the same keys, once each."""
    side = lambda df, name: df.select(*key, F.lit(1).alias(name))
    off = (
        side(student, "s").unionByName(side(teacher, "t"), allowMissingColumns=True)
        .groupBy(*key).agg(F.count("s").alias("s"), F.count("t").alias("t"))
        .where((F.col("s") != 1) | (F.col("t") != 1))
    )
    if not off.isEmpty():
        raise ValueError("student and teacher rows must be aligned one to one")
