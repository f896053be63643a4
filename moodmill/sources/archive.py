"""The monthly forum archive: which months are due, and its rows."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moodmill.functions.hashing import HASH_VERSION, content_sha256
from moodmill.functions.text import clean_html, strip_space
from moodmill.functions.times import now_literal, rfc3339
from moodmill.operators.filters import MAX_CHARS, MIN_CHARS, within_chars

STORY, COMMENT = 1, 2


def archive_rows(archive: DataFrame) -> DataFrame:
    """Live stories and comments with their raw text: a comment's body or a
    story's title. Plain comparisons, so they reach the parquet scan."""
    raw = F.when(F.col("type") == COMMENT, F.col("text")).otherwise(F.col("title"))
    alive = lambda c: F.col(c).isNull() | (F.col(c) == 0)
    return (
        archive.where(F.col("type").isin(STORY, COMMENT) & alive("deleted") & alive("dead"))
        .select("id", "type", F.col("by").alias("author"), "time", raw.alias("raw"))
        .where(F.col("raw").isNotNull())
    )


def read_hn_archive(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    paths = [paths] if isinstance(paths, str) else paths
    return archive_rows(spark.read.parquet(*paths))


def corpus_rows(rows: DataFrame, now: dt.datetime | str, low: int = MIN_CHARS, high: int = MAX_CHARS) -> DataFrame:
    """Archive rows as corpus rows, dated by the item's own UTC day."""
    is_comment = F.col("type") == COMMENT
    # Titles are plain text; sending NULL for them skips their clean-up.
    text = F.coalesce(clean_html(F.when(is_comment, F.col("raw"))), strip_space("raw"))
    return (
        rows.withColumn("text", text)
        .where(within_chars("text", low, high))
        .select(
            F.lit("hackernews").alias("platform"),
            F.concat(F.lit("hn-"), F.col("id").cast("string")).alias("doc_id"),
            F.coalesce("author", F.lit("")).alias("author"),
            "text",
            rfc3339(F.col("time").cast("timestamp")).alias("created_at"),
            rfc3339(now_literal(now)).alias("harvested_at"),
            content_sha256("text").alias("content_sha256"),
            F.lit(HASH_VERSION).alias("hash_version"),
            F.to_date(F.col("time").cast("timestamp")).alias("dt"),
        )
    )


def last_full_month(today: dt.date) -> str:
    return (today.replace(day=1) - dt.timedelta(days=1)).strftime("%Y-%m")


def month_series(spark: SparkSession, first: str, last: str) -> DataFrame:
    """Inclusive months as ``yyyy-MM``; none when ``first`` is after ``last``."""
    start, stop = F.lit(f"{first}-01").cast("date"), F.lit(f"{last}-01").cast("date")
    months = F.when(start <= stop, F.sequence(start, stop, F.expr("interval 1 month")))
    one = spark.range(1)
    return one.select(F.explode(months).alias("day")).select(F.date_format("day", "yyyy-MM").alias("month"))


def pending_months(spark: SparkSession, first: str, last: str | None, done: DataFrame,
                   today: dt.date | None = None) -> DataFrame:
    """Months still to ingest. ``done`` has (month, is_partial); a partial
    ingest does not count."""
    last = last or last_full_month(today or dt.date.today())
    complete = done.where(~F.col("is_partial")).select("month").distinct()
    return month_series(spark, first, last).join(complete, "month", "left_anti").orderBy("month")
