"""Daily sentiment series: additive moments, exact roll-ups, trends, alerts.

A series row holds sums, never derived statistics, so any coarser interval or
wider scope is another sum. Averages, deviations and modal labels are computed
last.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moodmill.operators.aggregate import COUNTS, modal_label
from moodmill.operators.dedupe import keep_first
from moodmill.operators.sampling import hash_cap
from moodmill.schemas import CLASSES

MOMENTS = ("sample_size", "sum_polarity", "sum_sq_polarity", "sum_confidence", *COUNTS)
ALL_PLATFORMS = "_all"

MIN_SAMPLE = 20
MAX_STALE_DAYS = 3
REFUSE_STALE_DAYS = 7


def daily_moments() -> list[Column]:
    """Aggregates of scored rows; the streaming job uses the same list."""
    pol, conf = F.col("polarity").cast("double"), F.col("confidence").cast("double")
    return [
        F.count("*").alias("sample_size"),
        F.sum(pol).alias("sum_polarity"),
        F.sum(pol * pol).alias("sum_sq_polarity"),
        F.sum(conf).alias("sum_confidence"),
        *[F.count_if(F.col("label") == c).alias(n) for c, n in zip(CLASSES, COUNTS, strict=True)],
    ]


def topic_daily(scored: DataFrame, posted_at: str = "posted_at",
                keys: Sequence[str] = ("topic", "platform")) -> DataFrame:
    """Moments per (topic, platform, UTC day), with the day's mean and modal label."""
    daily = scored.groupBy(*keys, F.to_date(posted_at).alias("day")).agg(*daily_moments())
    return with_statistics(daily)


def with_statistics(series: DataFrame) -> DataFrame:
    """Mean, exact population deviation, mean confidence and modal label."""
    n = F.col("sample_size")
    mean = F.try_divide(F.col("sum_polarity"), n)
    variance = F.try_divide(F.col("sum_sq_polarity"), n) - mean * mean
    return series.withColumns(
        {
            "mean_polarity": mean,
            "stddev_polarity": F.sqrt(F.greatest(variance, F.lit(0.0))),
            "mean_confidence": F.try_divide(F.col("sum_confidence"), n),
            "modal_label": modal_label(),
        }
    )


def counts_disagree(series: DataFrame) -> DataFrame:
    """Rows whose class counts do not sum to their sample size: must be empty."""
    total = F.lit(0)
    for c in COUNTS:
        total = total + F.col(c)
    return series.where(total != F.col("sample_size"))


def rollup_series(series: DataFrame, interval: str, keys: Sequence[str] = ("topic", "platform")) -> DataFrame:
    """Day moments to ``week`` (Monday start) or ``month``, by summing them."""
    bucket = F.to_date(F.date_trunc(interval, F.col("day")))
    summed = series.groupBy(*keys, bucket.alias("day")).agg(*[F.sum(m).alias(m) for m in MOMENTS])
    return with_statistics(summed)


def topic_daily_all(scored: DataFrame, posted_at: str = "posted_at", topic: str = "topic") -> DataFrame:
    """The cross-platform series. A crosspost is one document, so copies of one
    content within a topic are removed before counting: summing the platform
    series would count them twice."""
    first = keep_first(
        scored,
        [topic, "hash_version", "content_sha256"],
        [F.col(posted_at).asc_nulls_last(), F.col("doc_id"), F.col("platform")],
    )
    return topic_daily(first.withColumn("platform", F.lit(ALL_PLATFORMS)), posted_at, (topic, "platform"))


def staleness(series: DataFrame, today: dt.date | str, keys: Sequence[str] = ("topic", "platform")) -> DataFrame:
    """Last day present, days since, and whether that is stale or too old for
    a trend."""
    at = F.lit(str(today)).cast("date")
    seen = series.groupBy(*keys).agg(F.max("day").alias("as_of"))
    days = seen.withColumn("stale_days", F.date_diff(at, F.col("as_of")))
    return days.withColumns(
        {
            "stale": F.col("stale_days") > MAX_STALE_DAYS,
            "refused": F.col("stale_days") > REFUSE_STALE_DAYS,
        }
    )


def trend(series: DataFrame, today: dt.date | str, window: int = 7, baseline: int = 28,
          keys: Sequence[str] = ("topic", "platform"), flat: float = 0.0) -> DataFrame:
    """Current window against the baseline period before it.

    delta is the difference of the two pooled means; z divides it by the
    deviation of the baseline's daily means. Both are 0 and the direction is
    UNSPECIFIED if the current window is empty, the baseline has fewer than
    three days or no spread, or the series ends more than a window ago. ``flat``
    is the |delta| up to which a direction is STABLE.
    """
    at = F.lit(str(today)).cast("date")
    age = F.date_diff(at, F.col("day"))
    now, before = (age >= 0) & (age < window), (age >= window) & (age < window + baseline)

    def pooled(mask: Column, name: str) -> Column:
        return F.sum(F.when(mask, F.col(name)))

    rows = series.where((age >= 0) & (age < window + baseline))
    summed = rows.groupBy(*keys).agg(
        F.max("day").alias("as_of"),
        F.coalesce(pooled(now, "sample_size"), F.lit(0)).alias("current_sample_size"),
        F.coalesce(pooled(before, "sample_size"), F.lit(0)).alias("baseline_sample_size"),
        F.try_divide(pooled(now, "sum_polarity"), pooled(now, "sample_size")).alias("_current"),
        F.try_divide(pooled(before, "sum_polarity"), pooled(before, "sample_size")).alias("_baseline"),
        F.count_if(before).alias("baseline_days"),
        F.stddev_samp(F.when(before, F.col("mean_polarity"))).alias("_spread"),
        *[pooled(now, c).alias(f"now_{c}") for c in COUNTS],
        *[pooled(before, c).alias(f"before_{c}") for c in COUNTS],
    )
    return _judged(summed, at, keys, window, flat)


def rolling_trend(series: DataFrame, window: int = 7, baseline: int = 28,
                  keys: Sequence[str] = ("topic", "platform"), flat: float = 0.0) -> DataFrame:
    """``trend`` as of every day from a series' first to its last, with that ``day`` as a column.

    Both periods are frames over dates, so a series is shuffled once however many
    days it has, and days without documents have a trend too. A day with nothing
    in either period has no row, as ``trend`` has none then.
    """
    span = series.groupBy(*keys).agg(F.min("day").alias("_first"), F.max("day").alias("_last"))
    calendar = span.select(*keys, F.explode(F.sequence("_first", "_last")).alias("day"))
    marked = series.select(*keys, "day", *MOMENTS, "mean_polarity", F.lit(0).alias("_gap"))
    # The calendar as rows without moments: a union needs no join, and sums skip NULL.
    gaps = calendar.withColumn("_gap", F.lit(1))
    filled = marked.unionByName(gaps, allowMissingColumns=True)
    by_date = Window.partitionBy(*keys).orderBy(F.unix_date("day"))
    whole = by_date.rangeBetween(1 - window - baseline, 0)
    now, before = by_date.rangeBetween(1 - window, 0), by_date.rangeBetween(1 - window - baseline, -window)

    def pooled(frame, name: str) -> Column:
        return F.sum(name).over(frame)

    summed = filled.select(
        *keys, "day", "_gap",
        F.max(F.when(F.col("_gap") == 0, F.col("day"))).over(whole).alias("as_of"),
        F.coalesce(pooled(now, "sample_size"), F.lit(0)).alias("current_sample_size"),
        F.coalesce(pooled(before, "sample_size"), F.lit(0)).alias("baseline_sample_size"),
        F.try_divide(pooled(now, "sum_polarity"), pooled(now, "sample_size")).alias("_current"),
        F.try_divide(pooled(before, "sum_polarity"), pooled(before, "sample_size")).alias("_baseline"),
        F.count("sample_size").over(before).alias("baseline_days"),
        F.stddev_samp("mean_polarity").over(before).alias("_spread"),
        *[pooled(now, c).alias(f"now_{c}") for c in COUNTS],
        *[pooled(before, c).alias(f"before_{c}") for c in COUNTS],
    )
    days = summed.where((F.col("_gap") == 1) & F.col("as_of").isNotNull())
    return _judged(days, F.col("day"), (*keys, "day"), window, flat)


def _judged(summed: DataFrame, at: Column, keys: Sequence[str], window: int, flat: float) -> DataFrame:
    """Trends from the sums of both periods, as of ``at``."""
    def modal(prefix: str) -> Column:
        return modal_label([f"{prefix}_{c}" for c in COUNTS])

    stale_days = F.date_diff(at, F.col("as_of"))
    defined = (
        (F.col("current_sample_size") > 0)
        & (F.col("baseline_days") >= 3)
        & (F.coalesce("_spread", F.lit(0.0)) > 1e-9)
        & (stale_days <= window)
    )
    delta = F.when(defined, F.col("_current") - F.col("_baseline")).otherwise(F.lit(0.0))
    out = summed.withColumns({"stale_days": stale_days, "_defined": defined, "delta": delta})
    return out.select(
        *keys,
        "as_of",
        "stale_days",
        "current_sample_size",
        "baseline_sample_size",
        "baseline_days",
        F.coalesce("_current", F.lit(0.0)).alias("current_mean_polarity"),
        F.coalesce("_baseline", F.lit(0.0)).alias("baseline_mean_polarity"),
        "delta",
        F.when(F.col("_defined"), F.col("delta") / F.col("_spread")).otherwise(F.lit(0.0)).alias("z_score"),
        modal("now").alias("current_modal_label"),
        modal("before").alias("baseline_modal_label"),
        (F.col("_defined") & (modal("now") != modal("before"))).alias("label_flipped"),
        F.when(~F.col("_defined"), F.lit("UNSPECIFIED"))
        .when(F.col("delta") > flat, F.lit("IMPROVING"))
        .when(F.col("delta") < -flat, F.lit("DECLINING"))
        .otherwise(F.lit("STABLE"))
        .alias("direction"),
    )


@dataclass(frozen=True)
class AlertRule:
    """``kind`` is POLARITY_SWING (|z| threshold), VOLUME_SPIKE (ratio of daily
    volume to the baseline's) or LABEL_FLIP (no threshold)."""

    kind: str
    threshold: float = 0.0
    window_days: int = 7
    min_sample_size: int = MIN_SAMPLE


def alerts(series: DataFrame, today: dt.date | str, rules: Sequence[AlertRule],
           keys: Sequence[str] = ("topic", "platform"), baseline: int = 28) -> DataFrame:
    """One row per rule a series breaks."""
    out = None
    for rule in rules:
        t = trend(series, today, rule.window_days, baseline, keys).where(
            F.col("current_sample_size") >= rule.min_sample_size
        )
        if rule.kind == "POLARITY_SWING":
            value, hit = F.col("z_score"), F.abs("z_score") >= rule.threshold
        elif rule.kind == "VOLUME_SPIKE":
            daily = F.col("current_sample_size") / rule.window_days
            value = F.try_divide(daily, F.col("baseline_sample_size") / F.lit(float(baseline)))
            hit = value >= rule.threshold
        elif rule.kind == "LABEL_FLIP":
            value, hit = F.col("label_flipped").cast("double"), F.col("label_flipped")
        else:
            raise ValueError(f"unknown alert kind: {rule.kind}")
        fired = t.where(hit).select(
            *keys, F.lit(rule.kind).alias("kind"), value.cast("double").alias("value"),
            "current_sample_size",
        )
        out = fired if out is None else out.unionByName(fired)
    if out is None:
        raise ValueError("no alert rules")
    return out


def density(series: DataFrame, first: dt.date | str, last: dt.date | str,
            keys: Sequence[str] = ("topic", "platform"), min_sample: int = MIN_SAMPLE) -> DataFrame:
    """How well a period is covered: empty days, thin days (1 to 9 documents),
    median documents per day, and the interval that carries enough of them."""
    days = F.explode(F.sequence(F.lit(str(first)).cast("date"), F.lit(str(last)).cast("date")))
    calendar = series.select(*keys).distinct().select(*keys, days.alias("day"))
    filled = calendar.join(series.select(*keys, "day", "sample_size"), [*keys, "day"], "left")
    n = F.coalesce("sample_size", F.lit(0))
    covered = filled.groupBy(*keys).agg(
        F.count("*").alias("days"),
        F.sum(n).alias("docs"),
        F.count_if(n == 0).alias("zero_days"),
        F.count_if((n >= 1) & (n <= 9)).alias("thin_days"),
        F.percentile(n, F.lit(0.5)).alias("median_per_day"),
    )
    return covered.withColumn(
        "interval", F.when(F.col("median_per_day") < min_sample, F.lit("week")).otherwise(F.lit("day"))
    )


def widened(series: DataFrame, keys: Sequence[str] = ("topic", "platform"), min_sample: int = MIN_SAMPLE,
            z: float = 1.96) -> DataFrame:
    """Neighbouring days merged until each bin holds ``min_sample`` documents, with an interval for each mean.

    Bins are filled from the oldest day on, so one that is full stays as it is
    when days are added. Days left at the end join the last full bin; a series
    that never fills one is a single bin. The interval is the mean plus and minus
    ``z`` standard errors from the bin's own moments; a bin of one document has
    none. A series is one row a day, so its days fit into one array.
    """
    days = series.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("day", *MOMENTS))).alias("_days"))
    start = F.struct(F.lit(0).alias("bin"), F.lit(0).cast("long").alias("held"), F.array().cast("array<int>").alias("bins"))

    def put(state: Column, day: Column) -> Column:
        held = state["held"] + day["sample_size"]
        full = held >= min_sample
        return F.struct(
            F.when(full, state["bin"] + 1).otherwise(state["bin"]).alias("bin"),
            F.when(full, F.lit(0).cast("long")).otherwise(held).alias("held"),
            F.concat(state["bins"], F.array(state["bin"])).alias("bins"),
        )

    placed = days.withColumn("_s", F.aggregate("_days", start, put))
    # Numbers past the last full bin are those of the days left over.
    last = F.greatest(F.col("_s.bin") - 1, F.lit(0))
    binned = placed.select(*keys, last.alias("_last"), F.explode(F.arrays_zip("_days", F.col("_s.bins").alias("bins"))).alias("_d"))
    merged = binned.groupBy(*keys, F.least(F.col("_d.bins"), F.col("_last")).alias("bin")).agg(
        F.min("_d._days.day").alias("day"), F.max("_d._days.day").alias("last_day"), F.count("*").alias("days"),
        *(F.sum(F.col(f"_d._days.{m}")).alias(m) for m in MOMENTS),
    )
    n, mean = F.col("sample_size"), F.col("mean_polarity")
    squares = F.greatest(F.col("sum_sq_polarity") - n * mean * mean, F.lit(0.0))
    error = F.when(n > 1, z * F.sqrt(squares / (n - 1) / n))
    return with_statistics(merged).withColumns({"low": mean - error, "high": mean + error})


# Thresholds of the data-sanity gate.
MIN_NEW_DOCS, MIN_VS_MEDIAN, MAX_SHARE = 2_000, 0.5, 0.95


def data_sanity(per_day: DataFrame, today: dt.date | str, min_new: int = MIN_NEW_DOCS,
                min_ratio: float = MIN_VS_MEDIAN, max_share: float = MAX_SHARE) -> DataFrame:
    """One row judging a day's harvest, from rows (platform, day, docs): enough
    new documents, not far below the median of the seven days before, and no
    single platform making up nearly all of it."""
    at = F.lit(str(today)).cast("date")
    age = F.date_diff(at, F.col("day"))
    # At most eight days times the number of platforms reach these sums.
    recent = per_day.where((age >= 0) & (age <= 7)).withColumn("_age", age)
    daily = recent.groupBy("_age").agg(
        F.sum("docs").alias("docs"), F.max("docs").alias("largest")
    )
    judged = daily.agg(
        F.coalesce(F.max(F.when(F.col("_age") == 0, F.col("docs"))), F.lit(0)).alias("n_new_docs"),
        F.coalesce(
            F.percentile(F.when(F.col("_age") > 0, F.col("docs")), F.lit(0.5)), F.lit(0.0)
        ).alias("median_7d"),
        F.max(F.when(F.col("_age") == 0, F.col("largest"))).alias("_largest"),
    )
    ratio = F.try_divide(F.col("n_new_docs").cast("double"), F.col("median_7d"))
    share = F.try_divide(F.col("_largest").cast("double"), F.col("n_new_docs"))
    out = judged.withColumns({"corpus_vs_7d_median": ratio, "max_platform_share": share}).drop("_largest")
    reasons = F.array_compact(
        F.array(
            F.when(F.col("n_new_docs") < min_new, F.lit("n_new_docs")),
            F.when(F.col("corpus_vs_7d_median") < min_ratio, F.lit("corpus_vs_7d_median")),
            F.when(F.col("max_platform_share") > max_share, F.lit("max_platform_share")),
        )
    )
    return out.withColumn("reasons", reasons).withColumn("passed", F.size("reasons") == 0)


def newest_documents(df: DataFrame, n: int, created_at: str = "created_at") -> DataFrame:
    """A training window in documents, not days: the ``n`` newest rows.

    Whole days are kept newest first while they fit; inside the day the limit
    falls into, rows are taken in hash order. Days are counted first, so no
    sort of the input is needed.
    """
    day = F.to_date(created_at)
    per_day = df.groupBy(day.alias("day")).agg(F.count("*").alias("rows"))
    # One task, but over one row per day.
    newest = Window.orderBy(F.col("day").desc_nulls_last())
    edge = (
        per_day.withColumn("upto", F.sum("rows").over(newest))
        .where(F.col("upto") >= n).orderBy("upto").limit(1).first()
    )
    if edge is None:
        return df
    inside = n - (edge["upto"] - edge["rows"])
    if edge["day"] is None:
        newer, boundary = df.where(day.isNotNull()), df.where(day.isNull())
    else:
        newer, boundary = df.where(day > F.lit(edge["day"])), df.where(day == F.lit(edge["day"]))
    return newer.unionByName(hash_cap(boundary, inside))
