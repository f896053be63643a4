"""Corpus, label and training-set writers."""

from __future__ import annotations

import datetime as dt
import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moodmill.functions.hashing import HASH_VERSION, content_sha256
from moodmill.functions.times import now_literal, rfc3339, utc_now
from moodmill.schemas import CORPUS, TOMBSTONE


def _with_columns_of(df: DataFrame, schema) -> DataFrame:
    missing = {f.name: F.lit(None).cast(f.dataType) for f in schema.fields if f.name not in df.columns}
    return df.withColumns(missing) if missing else df


def stamped_documents(docs: DataFrame, now: dt.datetime | str) -> DataFrame:
    """Corpus rows with harvest time, content hash and hash version filled, and
    the write day ``dt`` unless the rows bring their own."""
    out = _with_columns_of(docs, CORPUS).withColumns(
        {
            "harvested_at": rfc3339(now_literal(now)),
            "content_sha256": content_sha256("text"),
            "hash_version": F.lit(HASH_VERSION),
        }
    )
    if "dt" not in docs.columns:
        out = out.withColumn("dt", F.to_date(now_literal(now)))
    return out.select(*CORPUS.fieldNames(), "dt")


def stamped_tombstones(tombs: DataFrame, now: dt.datetime | str) -> DataFrame:
    out = _with_columns_of(tombs, TOMBSTONE).withColumn("deleted_at", rfc3339(now_literal(now)))
    if "dt" not in tombs.columns:
        out = out.withColumn("dt", F.to_date(now_literal(now)))
    return out.select(*TOMBSTONE.fieldNames(), "dt")


def write_partitioned(df: DataFrame, base: str, batch: str | None = None) -> None:
    """Gzipped JSON lines under dt/platform, which the folder names carry.

    Without a batch the rows are appended. With one they live under
    ``batch=<name>`` and replace an earlier run of that batch, so a retried
    write leaves no second copy.
    """
    path = f"{base}/batch={batch}" if batch else base
    # Rebalancing gathers each folder's rows into files of the advisory size: no
    # file per task and folder, and a platform with most rows is still split.
    df = df.hint("rebalance", "dt", "platform")
    writer = df.write.mode("overwrite" if batch else "append").partitionBy("dt", "platform")
    writer.option("compression", "gzip").json(path)


def write_corpus(docs: DataFrame, root: str, now: dt.datetime | str | None = None,
                 batch: str | None = None) -> None:
    write_partitioned(stamped_documents(docs, now or utc_now()), f"{root}/documents", batch)


def write_tombstones(tombs: DataFrame, root: str, now: dt.datetime | str | None = None,
                     batch: str | None = None) -> None:
    write_partitioned(stamped_tombstones(tombs, now or utc_now()), f"{root}/tombstones", batch)


def append_labels(labels: DataFrame, path: str) -> None:
    """Append soft labels; each version has its own folder, nothing is rewritten."""
    labels.write.mode("append").partitionBy("teacher_version").parquet(path)


def write_json_report(spark: SparkSession, report: dict[str, Any], path: str) -> None:
    """One small JSON object as a single-row text dataset, replaced on re-run."""
    text = json.dumps(report, ensure_ascii=False, default=str)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_json_report(spark: SparkSession, path: str) -> dict[str, Any]:
    return json.loads(spark.read.text(path).first()["value"])


def write_training_set(train: DataFrame, out: str, rows_per_file: int = 1_000_000) -> None:
    train.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).parquet(out)
