"""Archive months -> corpus rows, resumable."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moodmill.functions.times import utc_now
from moodmill.session import local_table
from moodmill.sinks.corpus import write_partitioned
from moodmill.sources.archive import archive_rows, corpus_rows, pending_months

DONE_SCHEMA = "month string, is_partial boolean, rows long"


def done_months(spark: SparkSession, root: str) -> DataFrame:
    """Months ingested so far; a later full ingest of a month outranks a
    limited one."""
    try:
        return spark.read.schema(DONE_SCHEMA).json(f"{root}/backfill_done")
    except PySparkException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return local_table(spark, [], DONE_SCHEMA)


def backfill_month(archive: DataFrame, root: str, month: str, *, low: int = 40, high: int = 2000,
                   limit: int | None = None, now: dt.datetime | str | None = None) -> int:
    """Write one month's rows and record it. Returns the rows kept.

    The month is one batch folder, so a full run replaces what a limited run
    left. A limited run is a trial: it takes the lowest ids and is recorded as
    partial; over a month that is complete it is refused.
    """
    spark = archive.sparkSession
    if limit and not done_months(spark, root).where((F.col("month") == month) & ~F.col("is_partial")).isEmpty():
        raise ValueError(f"{month} is complete; a limited run would replace it")
    rows = archive_rows(archive)
    if limit:
        rows = rows.orderBy("id").limit(limit)
    docs = corpus_rows(rows, now or utc_now(), low, high)
    batch = f"backfill-{month}"
    write_partitioned(docs, f"{root}/documents", batch)
    kept = spark.read.schema("doc_id string").json(f"{root}/documents/batch={batch}").count()
    record = local_table(spark, [(month, bool(limit), kept)], DONE_SCHEMA)
    record.coalesce(1).write.mode("append").json(f"{root}/backfill_done")
    return kept


def ingest_months(spark: SparkSession, root: str, first: str, last: str | None,
                  read_month: Callable[[str], DataFrame], *, low: int = 40, high: int = 2000,
                  limit: int | None = None, today: dt.date | None = None,
                  log: Callable[[str], None] = print) -> int:
    """Ingest a range of months, skipping complete ones. A month that fails is
    logged and skipped; the total of rows kept is returned."""
    due = pending_months(spark, first, last, done_months(spark, root), today)
    total = 0
    for month in [r["month"] for r in due.collect()]:
        try:
            kept = backfill_month(read_month(month), root, month, low=low, high=high, limit=limit)
        except Exception as e:  # noqa: BLE001 - whatever a reader raises, the other months go on
            reason = e.getCondition() if isinstance(e, PySparkException) else None
            log(f"{month}: failed: {reason or type(e).__name__}")
            continue
        total += kept
        log(f"{month}: {kept} documents")
    return total


def month_counts(docs: DataFrame) -> DataFrame:
    """Rows per month of creation, from created_at."""
    month = F.substring("created_at", 1, 7)
    return docs.groupBy(month.alias("month")).agg(F.count("*").alias("rows"))


