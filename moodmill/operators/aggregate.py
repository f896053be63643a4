"""Roll-ups of scored rows. Everything is built from additive moments, so all
aggregates combine per map task first and hot keys cost nothing extra."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moodmill.schemas import CLASSES, PROBS

COUNTS = tuple(f"n_{c}" for c in CLASSES)
AGGREGATE_COLUMNS = ("sample_size", "mean_polarity", *COUNTS, "modal_label")


def _moments() -> list[Column]:
    return [
        F.count("*").alias("sample_size"),
        F.sum(F.col("polarity").cast("double")).alias("sum_polarity"),
        *[F.count_if(F.col("label") == c).alias(n) for c, n in zip(CLASSES, COUNTS, strict=True)],
    ]


def _combined() -> list[Column]:
    return [F.sum(c).alias(c) for c in ("sample_size", "sum_polarity", *COUNTS)]


def modal_label(counts: Sequence[str] = COUNTS) -> Column:
    """Most frequent class; ties prefer neutral, then positive. '' for no rows."""
    neg, neu, pos = (F.coalesce(F.col(c), F.lit(0)) for c in counts)
    return (
        F.when(neg + neu + pos == 0, F.lit(""))
        .when((neu >= pos) & (neu >= neg), F.lit("neutral"))
        .when(pos >= neg, F.lit("positive"))
        .otherwise(F.lit("negative"))
    )


def mean_or_zero(total: str, n: str) -> Column:
    """total / n, and 0 where there is nothing to average or it is NaN."""
    mean = F.try_divide(F.col(total), F.col(n))
    return F.coalesce(F.nanvl(mean, F.lit(0.0)), F.lit(0.0))


def _finish(moments: DataFrame, keys: Sequence[str]) -> DataFrame:
    zero = F.lit(0).cast("long")
    return moments.select(
        *keys,
        F.coalesce("sample_size", zero).alias("sample_size"),
        mean_or_zero("sum_polarity", "sample_size").alias("mean_polarity"),
        *[F.coalesce(F.col(c), zero).alias(c) for c in COUNTS],
        modal_label().alias("modal_label"),
    )


def sentiment_aggregate(scored: DataFrame, *keys: str) -> DataFrame:
    """Sample size, mean polarity, class counts and modal label, per ``keys`` or
    overall. With no keys and no rows: one row of zeros and an empty label."""
    grouped = scored.groupBy(*keys) if keys else scored.groupBy()
    return _finish(grouped.agg(*_moments()), keys)


def by_platform(scored: DataFrame) -> DataFrame:
    return sentiment_aggregate(scored, "platform")


def by_aspect(aspect_scores: DataFrame) -> DataFrame:
    return sentiment_aggregate(aspect_scores, "aspect")


def topic_rollup(scored: DataFrame) -> DataFrame:
    """Per platform and overall (``scope`` says which) from one scan: grouping
    sets run over the per-platform moments, not over the rows."""
    moments = scored.groupBy("platform").agg(*_moments())
    sets = moments.groupingSets([[F.col("platform")], []], "platform").agg(
        F.grouping_id().alias("_all"), *_combined()
    )
    scope = F.when(F.col("_all") == 0, F.lit("platform")).otherwise(F.lit("overall"))
    # An empty input has no grouping-set rows at all, not even the overall one.
    return _finish(sets.withColumn("scope", scope), ["scope", "platform"])


def per_platform_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("platform").agg(F.count("*").alias("rows"))


def label_integrity(labels: DataFrame, *keys: str) -> DataFrame:
    """One row to judge a label table by: rows, distinct keys, range of the
    probability sums, number of versions."""
    keys = keys or ("platform", "doc_id")
    total = F.lit(0.0)
    for p in PROBS:
        total = total + F.col(p).cast("double")
    return labels.withColumn("_sum", total).agg(
        F.count("*").alias("rows"),
        F.count_distinct(F.struct(*keys)).alias("distinct_keys"),
        F.min("_sum").alias("min_sum"),
        F.max("_sum").alias("max_sum"),
        F.count_distinct("teacher_version").alias("versions"),
    )


def outcome_stats(df: DataFrame, outcome: str = "outcome") -> DataFrame:
    """Rows per outcome of a harvest (documents, tombstones, skipped, failed)."""
    return df.groupBy(outcome).agg(F.count("*").alias("rows"))


def one_row(*frames: DataFrame) -> DataFrame:
    """Several one-row frames side by side, without joining them."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return stacked.agg(*[F.first(c, ignorenulls=True).alias(c) for c in stacked.columns])
