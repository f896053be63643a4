"""Daily series, roll-ups, trends and data-quality queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from moodmill.catalog.registry import query
from moodmill.catalog.tables import BACKEND, CORPUS, TODAY, corpus, longs, rounded, scored_sql, with_
from moodmill.operators import trend as T
from moodmill.operators.aggregate import COUNTS
from moodmill.operators.scoring import score_documents
from moodmill.plans.history import tagged_with_topics
from moodmill.plans.history import topic_history as history

TOPICS = {"french": "les", "english": "the"}
_KEYS = ("topic", "platform")

_TAGGED = [
    CORPUS,
    scored_sql("corpus"),
    """
tagged AS (
  SELECT *, unnest(list_filter([CASE WHEN contains(lower(text), 'les') THEN 'french' END,
    CASE WHEN contains(lower(text), 'the') THEN 'english' END], lambda t: t IS NOT NULL)) AS topic FROM scored
)""",
]
_MOMENTS = """count(*) AS sample_size, sum(polarity) AS sum_polarity, sum(polarity * polarity) AS sum_sq_polarity,
  sum(confidence) AS sum_confidence, count(*) FILTER (label = 'negative') AS n_negative,
  count(*) FILTER (label = 'neutral') AS n_neutral, count(*) FILTER (label = 'positive') AS n_positive"""
_DAILY = f"""
daily AS (
  SELECT topic, platform, posted_at::DATE AS day, {_MOMENTS} FROM tagged GROUP BY ALL
)"""


def _modal(prefix: str = "n_") -> str:
    n, u, p = (f"{prefix}{c}" for c in ("negative", "neutral", "positive"))
    return (
        f"CASE WHEN coalesce({n} + {u} + {p}, 0) = 0 THEN '' WHEN {u} >= {p} AND {u} >= {n} THEN 'neutral' "
        f"WHEN {p} >= {n} THEN 'positive' ELSE 'negative' END"
    )


_STATS = f"""topic, platform, strftime(day, '%Y-%m-%d') AS day, sample_size::BIGINT AS sample_size,
  n_negative::BIGINT AS n_negative, n_neutral::BIGINT AS n_neutral, n_positive::BIGINT AS n_positive,
  round(sum_polarity / sample_size, 6) AS mean_polarity,
  round(sum_confidence / sample_size, 6) AS mean_confidence,
  round(greatest(sum_sq_polarity / sample_size - (sum_polarity / sample_size) * (sum_polarity / sample_size), 0), 6) AS variance,
  {_modal()} AS modal_label"""


def _series_out(series):
    return rounded(
        series.select(
            *_KEYS, F.date_format("day", "yyyy-MM-dd").alias("day"), "sample_size", *COUNTS,
            "mean_polarity", "mean_confidence",
            (F.col("stddev_polarity") * F.col("stddev_polarity")).alias("variance"), "modal_label",
        ),
        "mean_polarity", "mean_confidence", "variance",
    )


def _daily(spark, d):
    return history(corpus(spark, d, spread=True), TOPICS, BACKEND)


@query(with_(*_TAGGED, _DAILY, f"SELECT {_STATS} FROM daily"))
def topic_daily(spark, d):
    return _series_out(_daily(spark, d))


def _rolled(unit: str) -> str:
    sums = ", ".join(f"sum({m}) AS {m}" for m in T.MOMENTS)
    return f"rolled AS (SELECT topic, platform, date_trunc('{unit}', day)::DATE AS day, {sums} FROM daily GROUP BY 1, 2, 3)"


@query(with_(*_TAGGED, _DAILY, _rolled("week"), f"SELECT {_STATS} FROM rolled"))
def topic_weekly(spark, d):
    return _series_out(T.rollup_series(_daily(spark, d), "week"))


@query(with_(*_TAGGED, _DAILY, _rolled("month"), f"SELECT {_STATS} FROM rolled"))
def topic_monthly(spark, d):
    return _series_out(T.rollup_series(_daily(spark, d), "month"))


@query(
    with_(
        *_TAGGED,
        """
firsts AS (
  SELECT * FROM tagged QUALIFY row_number() OVER (
    PARTITION BY topic, hash_version, content_sha256 ORDER BY posted_at, doc_id, platform) = 1
)""",
        f"daily AS (SELECT topic, '_all' AS platform, posted_at::DATE AS day, {_MOMENTS} FROM firsts GROUP BY 1, 2, 3)",
        f"SELECT {_STATS} FROM daily",
    )
)
def topic_daily_all_platforms(spark, d):
    return _series_out(T.topic_daily_all(tagged_with_topics(score_documents(corpus(spark, d, spread=True), BACKEND), TOPICS)))


@query(with_(*_TAGGED, _DAILY, "SELECT topic, platform FROM daily WHERE n_negative + n_neutral + n_positive <> sample_size"))
def series_count_check(spark, d):
    return T.counts_disagree(_daily(spark, d)).select(*_KEYS)


# Trends per topic over all platforms together.
_BY_TOPIC = f"byday AS (SELECT topic, posted_at::DATE AS day, {_MOMENTS} FROM tagged GROUP BY ALL)"


def _trend_sql(window: int = 7, baseline: int = 28) -> list[str]:
    now = f"age BETWEEN 0 AND {window - 1}"
    before = f"age BETWEEN {window} AND {window + baseline - 1}"
    split = ", ".join(
        f"sum({c}) FILTER ({cond}) AS {p}_{c[2:]}" for c in COUNTS for p, cond in (("now", now), ("before", before))
    )
    return [
        f"aged AS (SELECT *, DATE '{TODAY}' - day AS age FROM byday WHERE DATE '{TODAY}' - day BETWEEN 0 AND {window + baseline - 1})",
        f"""sums AS (
  SELECT topic, max(day) AS as_of, coalesce(sum(sample_size) FILTER ({now}), 0)::BIGINT AS current_sample_size,
    coalesce(sum(sample_size) FILTER ({before}), 0)::BIGINT AS baseline_sample_size,
    count(*) FILTER ({before}) AS baseline_days,
    sum(sum_polarity) FILTER ({now}) / sum(sample_size) FILTER ({now}) AS cur,
    sum(sum_polarity) FILTER ({before}) / sum(sample_size) FILTER ({before}) AS base,
    stddev_samp(sum_polarity / sample_size) FILTER ({before}) AS spread, {split}
  FROM aged GROUP BY topic)""",
        f"""judged AS (
  SELECT *, current_sample_size > 0 AND baseline_days >= 3 AND coalesce(spread, 0) > 1e-9
    AND DATE '{TODAY}' - as_of <= {window} AS defined,
    {_modal("now_")} AS now_label, {_modal("before_")} AS before_label FROM sums)""",
    ]


@query(
    with_(
        *_TAGGED, _BY_TOPIC, *_trend_sql(),
        f"""SELECT topic, strftime(as_of, '%Y-%m-%d') AS as_of, (DATE '{TODAY}' - as_of)::BIGINT AS stale_days,
  current_sample_size, baseline_sample_size, baseline_days, round(coalesce(cur, 0), 6) AS current_mean_polarity,
  round(coalesce(base, 0), 6) AS baseline_mean_polarity, round(CASE WHEN defined THEN cur - base ELSE 0 END, 6) AS delta,
  round(CASE WHEN defined THEN (cur - base) / spread ELSE 0 END, 5) AS z_score, now_label AS current_modal_label,
  before_label AS baseline_modal_label, (defined AND now_label <> before_label)::BIGINT AS label_flipped,
  CASE WHEN NOT defined THEN 'UNSPECIFIED' WHEN cur > base THEN 'IMPROVING' WHEN cur < base THEN 'DECLINING' ELSE 'STABLE' END AS direction
FROM judged""",
    )
)
def topic_trend(spark, d):
    t = T.trend(_by_topic(spark, d), TODAY, keys=("topic",))
    t = t.withColumn("as_of", F.date_format("as_of", "yyyy-MM-dd")).withColumn("z_score", F.round("z_score", 5))
    return longs(
        rounded(t, "current_mean_polarity", "baseline_mean_polarity", "delta"), "stale_days", "label_flipped"
    )


@query(
    with_(
        *_TAGGED, _BY_TOPIC,
        """
span AS (SELECT topic, min(day) AS first, max(day) AS last FROM byday GROUP BY topic)""",
        "calendar AS (SELECT topic, unnest(generate_series(first, last, INTERVAL 1 DAY))::DATE AS asked FROM span)",
        f"""
sums AS (
  SELECT c.topic, c.asked, max(b.day) AS as_of, coalesce(sum(sample_size) FILTER (c.asked - b.day < 7), 0)::BIGINT AS current_sample_size,
    coalesce(sum(sample_size) FILTER (c.asked - b.day >= 7), 0)::BIGINT AS baseline_sample_size,
    count(*) FILTER (c.asked - b.day >= 7) AS baseline_days,
    sum(sum_polarity) FILTER (c.asked - b.day < 7) / sum(sample_size) FILTER (c.asked - b.day < 7) AS cur,
    sum(sum_polarity) FILTER (c.asked - b.day >= 7) / sum(sample_size) FILTER (c.asked - b.day >= 7) AS base,
    stddev_samp(sum_polarity / sample_size) FILTER (c.asked - b.day >= 7) AS spread,
    {", ".join(f"sum({c}) FILTER (c.asked - b.day {op} 7) AS {p}_{c[2:]}" for c in COUNTS for p, op in (("now", "<"), ("before", ">=")))}
  FROM calendar c JOIN byday b ON b.topic = c.topic AND c.asked - b.day BETWEEN 0 AND 34 GROUP BY ALL)""",
        f"""
judged AS (
  SELECT *, current_sample_size > 0 AND baseline_days >= 3 AND coalesce(spread, 0) > 1e-9 AND asked - as_of <= 7 AS defined,
    {_modal("now_")} AS now_label, {_modal("before_")} AS before_label FROM sums)""",
        """SELECT topic, strftime(asked, '%Y-%m-%d') AS day, strftime(as_of, '%Y-%m-%d') AS as_of, (asked - as_of)::BIGINT AS stale_days,
  current_sample_size, baseline_sample_size, baseline_days, round(coalesce(cur, 0), 6) AS current_mean_polarity,
  round(coalesce(base, 0), 6) AS baseline_mean_polarity, round(CASE WHEN defined THEN cur - base ELSE 0 END, 6) AS delta,
  round(CASE WHEN defined THEN (cur - base) / spread ELSE 0 END, 5) AS z_score, now_label AS current_modal_label,
  before_label AS baseline_modal_label, (defined AND now_label <> before_label)::BIGINT AS label_flipped,
  CASE WHEN NOT defined THEN 'UNSPECIFIED' WHEN cur - base > 0.001 THEN 'IMPROVING' WHEN cur - base < -0.001 THEN 'DECLINING'
    ELSE 'STABLE' END AS direction
FROM judged""",
    )
)
def topic_trend_daily(spark, d):
    t = T.rolling_trend(_by_topic(spark, d), keys=("topic",), flat=0.001)
    for c in ("day", "as_of"):
        t = t.withColumn(c, F.date_format(c, "yyyy-MM-dd"))
    t = t.withColumn("z_score", F.round("z_score", 5))
    return longs(
        rounded(t, "current_mean_polarity", "baseline_mean_polarity", "delta"), "stale_days", "label_flipped"
    )


def _by_topic(spark, d):
    tagged = tagged_with_topics(score_documents(corpus(spark, d, spread=True), BACKEND), TOPICS)
    return T.topic_daily(tagged, keys=("topic",))


_RULES = (
    T.AlertRule("POLARITY_SWING", 0.1), T.AlertRule("VOLUME_SPIKE", 0.5), T.AlertRule("LABEL_FLIP"),
)


@query(
    with_(
        *_TAGGED, _BY_TOPIC, *_trend_sql(),
        """SELECT * FROM (
  SELECT topic, 'POLARITY_SWING' AS kind, round(CASE WHEN defined THEN (cur - base) / spread ELSE 0 END, 5) AS value,
    current_sample_size FROM judged WHERE abs(CASE WHEN defined THEN (cur - base) / spread ELSE 0 END) >= 0.1
  UNION ALL SELECT topic, 'VOLUME_SPIKE', round((current_sample_size / 7.0::DOUBLE) / (baseline_sample_size / 28.0::DOUBLE), 5), current_sample_size
    FROM judged WHERE (current_sample_size / 7.0::DOUBLE) / (baseline_sample_size / 28.0::DOUBLE) >= 0.5
  UNION ALL SELECT topic, 'LABEL_FLIP', 1.0::DOUBLE, current_sample_size FROM judged WHERE defined AND now_label <> before_label
) WHERE current_sample_size >= 20""",
    )
)
def topic_alerts(spark, d):
    fired = T.alerts(_by_topic(spark, d), TODAY, _RULES, keys=("topic",))
    return fired.withColumn("value", F.round("value", 5))


@query(
    with_(
        *_TAGGED, _DAILY,
        f"""SELECT topic, platform, strftime(max(day), '%Y-%m-%d') AS as_of, (DATE '{TODAY}' - max(day))::BIGINT AS stale_days,
  (DATE '{TODAY}' - max(day) > 3)::BIGINT AS stale, (DATE '{TODAY}' - max(day) > 7)::BIGINT AS refused
FROM daily GROUP BY topic, platform""",
    )
)
def series_staleness(spark, d):
    s = T.staleness(_daily(spark, d), TODAY).withColumn("as_of", F.date_format("as_of", "yyyy-MM-dd"))
    return longs(s, "stale_days", "stale", "refused")


@query(
    with_(
        *_TAGGED, _DAILY,
        """calendar AS (SELECT unnest(generate_series(DATE '2024-01-01', DATE '2024-02-11', INTERVAL 1 DAY))::DATE AS day),
filled AS (
  SELECT k.topic, k.platform, coalesce(s.sample_size, 0) AS n
  FROM (SELECT DISTINCT topic, platform FROM daily) k CROSS JOIN calendar c
  LEFT JOIN daily s ON s.topic = k.topic AND s.platform = k.platform AND s.day = c.day)""",
        """SELECT topic, platform, count(*) AS days, sum(n)::BIGINT AS docs, count(*) FILTER (n = 0) AS zero_days,
  count(*) FILTER (n BETWEEN 1 AND 9) AS thin_days, quantile_cont(n, 0.5)::DOUBLE AS median_per_day,
  CASE WHEN quantile_cont(n, 0.5) < 20 THEN 'week' ELSE 'day' END AS interval FROM filled GROUP BY topic, platform""",
    )
)
def series_density(spark, d):
    return T.density(_daily(spark, d), "2024-01-01", "2024-02-11")


@query(
    with_(
        *_TAGGED, _DAILY,
        "numbered AS (SELECT *, row_number() OVER (PARTITION BY topic, platform ORDER BY day) AS nth FROM daily)",
        """walk AS (
  WITH RECURSIVE w AS (
    SELECT topic, platform, nth, 0 AS bin, sample_size::BIGINT AS held FROM numbered WHERE nth = 1
    UNION ALL SELECT s.topic, s.platform, s.nth, w.bin + (w.held >= 20)::INTEGER,
      s.sample_size + CASE WHEN w.held >= 20 THEN 0 ELSE w.held END
    FROM w JOIN numbered s ON s.topic = w.topic AND s.platform = w.platform AND s.nth = w.nth + 1)
  SELECT * FROM w)""",
        "ends AS (SELECT topic, platform, max(bin) AS top, arg_max(held, nth) AS held FROM walk GROUP BY ALL)",
        """bins AS (
  SELECT topic, platform, CASE WHEN bin = top AND ends.held < 20 THEN greatest(bin - 1, 0) ELSE bin END AS bin, min(day) AS day,
    max(day) AS last_day, count(*) AS days, sum(sample_size)::BIGINT AS n, sum(sum_polarity) AS s1, sum(sum_sq_polarity) AS s2
  FROM walk JOIN numbered USING (topic, platform, nth) JOIN ends USING (topic, platform) GROUP BY ALL)""",
        """SELECT topic, platform, strftime(day, '%Y-%m-%d') AS day, strftime(last_day, '%Y-%m-%d') AS last_day, days, n AS sample_size,
  round(s1 / n, 6) AS mean_polarity,
  round(s1 / n - 1.96 * sqrt(greatest(s2 - s1 * s1 / n, 0) / (CASE WHEN n > 1 THEN n - 1 END) / n), 6) AS low,
  round(s1 / n + 1.96 * sqrt(greatest(s2 - s1 * s1 / n, 0) / (CASE WHEN n > 1 THEN n - 1 END) / n), 6) AS high FROM bins""",
    )
)
def series_widened(spark, d):
    w = T.widened(_daily(spark, d))
    return w.select(
        "topic", "platform", *(F.date_format(c, "yyyy-MM-dd").alias(c) for c in ("day", "last_day")), "days", "sample_size",
        *(F.round(c, 6).alias(c) for c in ("mean_polarity", "low", "high")),
    )


@query(
    with_(
        CORPUS,
        f"""recent AS (SELECT DATE '{TODAY}' - 7 - posted_at::DATE AS age, platform FROM corpus
  WHERE DATE '{TODAY}' - 7 - posted_at::DATE BETWEEN 0 AND 7)""",
        "perday AS (SELECT age, count(*) AS docs FROM recent GROUP BY age)",
        "shares AS (SELECT age, platform, count(*) AS docs FROM recent GROUP BY ALL)",
        """judged AS (SELECT coalesce(max(docs) FILTER (age = 0), 0) AS n_new_docs,
  coalesce(quantile_cont(docs, 0.5) FILTER (age > 0), 0)::DOUBLE AS median_7d,
  (SELECT max(docs) FROM shares WHERE age = 0) AS largest FROM perday)""",
        """SELECT n_new_docs, median_7d, round(n_new_docs / nullif(median_7d, 0), 6) AS corpus_vs_7d_median,
  round(largest / nullif(n_new_docs, 0)::DOUBLE, 6) AS max_platform_share,
  concat_ws(',', CASE WHEN n_new_docs < 2000 THEN 'n_new_docs' END,
    CASE WHEN n_new_docs / nullif(median_7d, 0) < 0.5 THEN 'corpus_vs_7d_median' END,
    CASE WHEN largest / nullif(n_new_docs, 0)::DOUBLE > 0.95 THEN 'max_platform_share' END) AS reasons FROM judged""",
    )
)
def data_sanity(spark, d):
    per_day = corpus(spark, d).groupBy("platform", F.to_date("posted_at").alias("day")).agg(F.count("*").alias("docs"))
    judged = T.data_sanity(per_day, "2024-02-05")
    return rounded(judged, "corpus_vs_7d_median", "max_platform_share").select(
        "n_new_docs", "median_7d", "corpus_vs_7d_median", "max_platform_share",
        F.array_join("reasons", ",").alias("reasons"),
    )
