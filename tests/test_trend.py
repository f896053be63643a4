import datetime as dt

import pytest
from pyspark.sql import functions as F

from moodmill.operators import filters as flt
from moodmill.operators import trend as T
from moodmill.operators.ranking import length_order_batches, length_rank

KEYS = ("topic", "platform")


def series(spark, days, topic="t"):
    """days: {age in days before 2026-08-31: [polarity, ...]}"""
    rows = []
    for age, values in days.items():
        day = dt.date(2026, 8, 31) - dt.timedelta(days=age)
        for v in values:
            label = "positive" if v > 0.2 else "negative" if v < -0.2 else "neutral"
            rows.append((topic, "rss", f"{day}T10:00:00Z", v, 0.5, label))
    df = spark.createDataFrame(rows, "topic string, platform string, posted_at string, polarity double, confidence double, label string")
    return T.topic_daily(df.withColumn("posted_at", F.col("posted_at").cast("timestamp")))


def test_moments_roll_up_exactly(spark):
    s = series(spark, {0: [0.5, -0.5, 0.1], 1: [0.3], 40: [-1.0]})
    assert T.counts_disagree(s).count() == 0
    month = {str(r["day"]): r for r in T.rollup_series(s, "month").collect()}
    aug = month["2026-08-01"]
    values = [0.5, -0.5, 0.1, 0.3]
    mean = sum(values) / 4
    assert aug["mean_polarity"] == pytest.approx(mean)
    assert aug["stddev_polarity"] == pytest.approx((sum(v * v for v in values) / 4 - mean**2) ** 0.5)
    assert aug["modal_label"] == "positive" and month["2026-07-01"]["modal_label"] == "negative"


def trend(spark, days, **kw):
    return T.trend(series(spark, days), "2026-08-31", **kw).first()


def test_trend(spark):
    base = {a: [0.1 * (a % 3)] for a in range(7, 35)}
    up = trend(spark, {**base, 0: [0.9] * 5, 3: [0.8]})
    assert up["direction"] == "IMPROVING" and up["z_score"] > 0 and up["current_sample_size"] == 6
    assert up["label_flipped"] and up["baseline_modal_label"] == "neutral"
    down = trend(spark, {**base, 0: [-0.9]})
    assert down["direction"] == "DECLINING" and down["delta"] < 0


def test_undefined_trends(spark):
    base = {a: [0.1 * (a % 3)] for a in range(7, 35)}
    for days in (base, {0: [0.5], 8: [0.1], 9: [0.2]}, {0: [0.5], **{a: [0.25] for a in range(7, 20)}}):
        r = trend(spark, days)
        assert (r["direction"], r["delta"], r["z_score"], r["label_flipped"]) == ("UNSPECIFIED", 0.0, 0.0, False)


def test_rolling_trend_is_the_trend_of_every_day(spark):
    # Gaps of a week, of more than both periods, and days of one and of many documents.
    ages = [0, 1, 2, 5, 14, 15, 16, 17, 30, 31, 33, 80, 81, 83, 84]
    s = series(spark, {a: [((a * 7 + i * 3) % 11 - 5) / 5 for i in range(1 + a % 4)] for a in ages}).unionByName(
        series(spark, {3: [0.4], 4: [-0.4]}, "other")
    ).cache()
    got = {(r["topic"], r["day"]): r.asDict() for r in T.rolling_trend(s, flat=0.01).collect()}
    first = dt.date(2026, 8, 31) - dt.timedelta(days=84)
    want = {}
    for n in range(0, 85, 4):
        at = first + dt.timedelta(days=n)
        for r in T.trend(s, at, flat=0.01).collect():
            want[r["topic"], at] = r.asDict()
    own = {k: r for k, r in got.items() if (k[1] - first).days % 4 == 0}
    # A series has rows from its first to its last day only.
    want = {k: r for k, r in want.items() if k[0] == "t" or k[1] <= dt.date(2026, 8, 28)}
    assert own.keys() == want.keys() and len(own) < 22 + 1
    for key, r in want.items():
        assert own[key].pop("day") == key[1]
        assert own[key] == {k: pytest.approx(v, abs=1e-9) if isinstance(v, float) else v for k, v in r.items()}
    assert sum(k[0] == "other" for k in got) == 2


def test_alerts(spark):
    s = series(spark, {**{a: [0.1 * (a % 3)] for a in range(7, 35)}, **{a: [0.9] * 4 for a in range(7)}})
    rules = [T.AlertRule("POLARITY_SWING", 2.0), T.AlertRule("VOLUME_SPIKE", 3.0), T.AlertRule("LABEL_FLIP")]
    fired = {r["kind"]: r["value"] for r in T.alerts(s, "2026-08-31", rules).collect()}
    assert set(fired) == {"POLARITY_SWING", "VOLUME_SPIKE", "LABEL_FLIP"} and fired["VOLUME_SPIKE"] == pytest.approx(4.0)
    few = [T.AlertRule("LABEL_FLIP", min_sample_size=29)]
    assert T.alerts(s, "2026-08-31", few).count() == 0
    with pytest.raises(ValueError, match="unknown alert"):
        T.alerts(s, "2026-08-31", [T.AlertRule("X")])


def test_staleness_and_density(spark):
    s = series(spark, {5: [0.1] * 30, 9: [0.2]})
    r = T.staleness(s, "2026-08-31").first()
    assert (r["stale_days"], r["stale"], r["refused"]) == (5, True, False)
    d = T.density(s, "2026-08-20", "2026-08-29").first()
    assert (d["days"], d["docs"], d["zero_days"], d["thin_days"], d["median_per_day"], d["interval"]) == (10, 31, 8, 1, 0.0, "week")


def test_crossposts_count_once_in_the_whole_series(spark):
    rows = [("t", p, "1", dt.datetime(2026, 8, 1, h), 0.5, 0.5, "positive", 1, "same") for p, h in (("hn", 3), ("rss", 1))]
    df = spark.createDataFrame(rows, "topic string, platform string, doc_id string, posted_at timestamp, polarity double, confidence double, label string, hash_version int, content_sha256 string")
    assert T.topic_daily(df).agg(F.sum("sample_size")).first()[0] == 2
    r = T.topic_daily_all(df).first()
    assert (r["platform"], r["sample_size"]) == ("_all", 1)


def test_data_sanity(spark):
    day = lambda a: dt.date(2026, 8, 31) - dt.timedelta(days=a)
    ok = [("a", day(0), 1500), ("b", day(0), 1500)] + [("a", day(a), 2000) for a in range(1, 8)]
    schema = "platform string, day date, docs long"
    assert T.data_sanity(spark.createDataFrame(ok, schema), "2026-08-31").first()["passed"]
    bad = [("a", day(0), 900)] + [("a", day(a), 2000) for a in range(1, 8)]
    r = T.data_sanity(spark.createDataFrame(bad, schema), "2026-08-31").first()
    assert r["reasons"] == ["n_new_docs", "corpus_vs_7d_median", "max_platform_share"] and not r["passed"]
    assert T.data_sanity(spark.createDataFrame([], schema), "2026-08-31").first()["n_new_docs"] == 0


def test_newest_documents(spark):
    df = spark.range(100).select(
        F.lit("p").alias("platform"), F.col("id").cast("string").alias("doc_id"),
        F.timestamp_seconds(F.col("id") * 43_200).alias("created_at"),
    )
    kept = {int(r["doc_id"]) for r in T.newest_documents(df, 10).collect()}
    assert kept == set(range(90, 100))
    odd = {int(r["doc_id"]) for r in T.newest_documents(df, 11).collect()}
    assert len(odd) == 11 and kept < odd and odd - kept <= {88, 89}
    assert T.newest_documents(df, 1000).count() == 100


def test_text_expires_by_the_best_known_time(spark):
    rows = [
        ("old", "2026-01-01T00:00:00Z", "2026-08-01T00:00:00Z"), ("new", "2026-08-01T00:00:00Z", None), ("none", None, None),
        ("blank, old", " ", "2026-01-01T00:00:00Z"), ("broken, new", "soon", "2026-08-01T00:00:00Z"),
    ]
    df = spark.createDataFrame(rows, "doc_id string, created_at string, harvested_at string")
    assert sorted(r[0] for r in flt.expire_text(df, "2026-08-31T00:00:00Z").collect()) == ["broken, new", "new"]


def test_length_batches(spark):
    rows = [("p", f"{i:02d}", "x" * (50 + i) if i < 8 else "y" * (1500 + i)) for i in range(16)]
    df = spark.createDataFrame(rows, "platform string, doc_id string, text string")
    got = length_order_batches(df, 8).groupBy("batch_id", "half").count().orderBy("batch_id", "half").collect()
    assert [r["count"] for r in got] == [8, 4, 4]
    flushed = length_order_batches(df, 8, flush_every=12).groupBy("flush_id", "batch_id", "half").count()
    assert sorted(r["count"] for r in flushed.collect()) == [2, 2, 2, 2, 8]
    hot = spark.range(3_000).select(F.lit("p").alias("platform"), F.col("id").cast("string").alias("doc_id"), F.lit("same").alias("text"))
    assert sorted(r["rank"] for r in length_rank(hot).select("rank").collect()) == list(range(1, 3_001))


def test_thin_days_are_merged_until_there_is_enough(spark):
    thin = series(spark, {9: [0.1] * 12, 8: [0.3] * 9, 7: [0.2] * 25, 3: [-0.4] * 5, 2: [0.6] * 14})
    rows = T.widened(thin).orderBy("day").collect()
    # Nineteen documents are left at the end and join the bin before them.
    assert [(str(r["day"])[5:], str(r["last_day"])[5:], r["days"], r["sample_size"]) for r in rows] == [("08-22", "08-23", 2, 21), ("08-24", "08-29", 3, 44)]
    values = [0.1] * 12 + [0.3] * 9
    mean = sum(values) / 21
    error = 1.96 * (sum((v - mean) ** 2 for v in values) / 20 / 21) ** 0.5
    assert (rows[0]["low"], rows[0]["high"]) == (pytest.approx(mean - error), pytest.approx(mean + error))
    (single,) = T.widened(series(spark, {1: [0.5]})).collect()
    assert single["sample_size"] == 1 and single["mean_polarity"] == 0.5 and single["low"] is None
    assert T.widened(thin.limit(0)).count() == 0
