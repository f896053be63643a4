"""Incremental soft labels from a frozen teacher."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from moodmill.functions.aspects import mine_aspects
from moodmill.operators import labels as L
from moodmill.operators.sampling import hash_cap
from moodmill.operators.scoring import Backend
from moodmill.schemas import ASPECT_LABELS, LABELS, PROBS
from moodmill.session import checkpoint_dir
from moodmill.sinks.corpus import append_labels
from moodmill.sources.corpus import read_labels


def label_rows(todo: DataFrame, backend: Backend, teacher_version: str, schema: T.StructType,
               aspect: str | None = None) -> DataFrame:
    """Float probabilities for every row still to label."""
    scored = backend.probabilities(todo, "text", aspect)
    return scored.select(
        *[F.col(f.name) if f.name != "teacher_version" else F.lit(teacher_version).alias(f.name)
          for f in schema.fields if f.name not in PROBS],
        *[F.col(p).cast("float").alias(p) for p in PROBS],
    ).select(*schema.fieldNames())


def _label(rows: DataFrame, path: str, backend: Backend, teacher_version: str, schema: T.StructType,
           key: Sequence[str], flushes: int, aspect: str | None) -> dict[str, int]:
    spark = rows.sparkSession
    existing = read_labels(spark, path, teacher_version, schema)
    stats = L.label_stats(rows, existing, teacher_version, key).first()
    if stats["to_label"]:
        for flush in range(flushes):
            # Slices are fixed by key, so whatever an interrupted run committed
            # is exactly what the next one finds labelled.
            part = rows
            if flushes > 1:
                part = rows.where(F.pmod(F.xxhash64(*key), F.lit(flushes)) == flush)
            done = read_labels(spark, path, teacher_version, schema)
            todo = L.unlabeled(part, done, teacher_version, key)
            append_labels(label_rows(todo, backend, teacher_version, schema, aspect), path)
    return {
        "total": stats["total"],
        "already_labeled": stats["already_labeled"],
        "newly_labeled": stats["to_label"],
    }


def label_training_set(spark: SparkSession, train_path: str, labels_path: str, backend: Backend,
                       teacher_version: str, flushes: int = 1) -> dict[str, int]:
    """Label the rows of a training set that have no label of this version.

    Each flush is one committed append, so a failure loses at most the flush it
    happened in. More flushes mean less lost work and more scans.
    """
    train = spark.read.parquet(train_path).select("platform", "doc_id", "text")
    return _label(train, labels_path, backend, teacher_version, LABELS, L.DOC_KEY, flushes, None)


def label_aspect_pairs(spark: SparkSession, train_path: str, labels_path: str, backend: Backend,
                       teacher_version: str, mine=mine_aspects, docs_cap: int | None = None,
                       max_pairs: int | None = None, flushes: int = 1,
                       per_doc: int | None = L.MAX_ASPECTS_PER_DOC) -> dict[str, int]:
    """Mine aspects from the training set, or a fixed slice of it, and label the pairs."""
    train = spark.read.parquet(train_path).select("platform", "doc_id", "text")
    checkpoint_dir(spark)
    # Stored once, so that capping, counting and labelling do not mine again.
    mined = L.all_mined_pairs(train, mine, docs_cap, per_doc).checkpoint()
    pairs = mined if max_pairs is None else hash_cap(mined, max_pairs, L.PAIR_KEY)
    return _label(pairs, labels_path, backend, teacher_version, ASPECT_LABELS, L.PAIR_KEY, flushes, "aspect")
