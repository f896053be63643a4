"""Removing repeats, by content or by id.

All of these keep the first row per key with ``row_number() = 1``: Spark applies
that limit inside each map task before the shuffle, so a key that holds a large
share of all rows sends one row per task.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CONTENT_KEY = ("hash_version", "content_sha256")


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") == 1).drop("_rank")


def earliest_first(df: DataFrame, created_at: str = "created_at") -> list[Column]:
    """Chronological, unknown times last, then doc_id and platform."""
    moment = F.col(created_at)
    if dict(df.dtypes)[created_at] == "string":
        moment = F.try_to_timestamp(moment)
    return [moment.asc_nulls_last(), F.col("doc_id"), F.col("platform")]


def dedupe_content(df: DataFrame, created_at: str = "created_at") -> DataFrame:
    """The earliest copy of each content; hash versions never mix."""
    return keep_first(df, CONTENT_KEY, earliest_first(df, created_at))


def dedupe_by_id(df: DataFrame, order: Sequence[Column | str] = ("ordinal",)) -> DataFrame:
    """The first row of each (platform, doc_id) in source order."""
    return keep_first(
        df, ("platform", "doc_id"), [F.col(c) if isinstance(c, str) else c for c in order]
    )


def union_sources(*frames: DataFrame) -> DataFrame:
    """Rows of all frames under one schema; absent columns become NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def distinct_aspects(df: DataFrame, aspects: str = "aspects", per_doc: int = 2) -> DataFrame:
    """Order-preserving distinct aspects, then the first ``per_doc``."""
    return df.withColumn(aspects, F.slice(F.array_distinct(aspects), 1, per_doc))
