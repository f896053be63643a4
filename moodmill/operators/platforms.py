"""The platform table: what each source is, and what may be kept of it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moodmill.operators.countries import COUNTRIES
from moodmill.session import local_table

# Fixed values: (id, display name, durable, backfillable, why it is not durable).
PLATFORMS = (
    ("bluesky", "Bluesky", True, True, ""),
    ("gdelt", "GDELT (world news headlines)", True, True, ""),
    ("hackernews", "Hacker News", True, True, ""),
    ("mastodon", "Mastodon", False, False, "operators opted out of AI use"),
    ("mock", "Mock", False, False, "synthetic content"),
    ("reddit", "Reddit", False, False, "data terms withhold training rights"),
    ("rss", "RSS / Atom feeds", True, False, ""),
    ("stocktwits", "StockTwits (cashtags)", False, False, "no approved extraction path"),
    ("twitter", "Twitter / X", False, False, "developer agreement bans training"),
    ("youtube", "YouTube", False, False, "retention cap and derived-data ban"),
)


def platform_table(spark: SparkSession, disabled: Sequence[str] = ()) -> DataFrame:
    """id, display_name, durable, backfillable, reason, enabled."""
    rows = [(*p, p[0] not in set(disabled)) for p in PLATFORMS]
    return local_table(
        spark,
        rows,
        "platform string, display_name string, durable boolean, backfillable boolean, "
        "reason string, enabled boolean",
    )


def select_platforms(table: DataFrame, wanted: Sequence[str] = ()) -> DataFrame:
    """Enabled platforms named in ``wanted`` (all for none). Unknown and
    disabled names are skipped; nothing usable is an error."""
    names = sorted({w.strip().lower() for w in wanted})
    usable = table.where(F.col("enabled"))
    if names:
        usable = usable.where(F.lower("platform").isin(*names))
    if usable.isEmpty():
        raise ValueError("no platforms enabled")
    return usable


def corpus_eligible(docs: DataFrame, table: DataFrame) -> DataFrame:
    """Documents of platforms whose content may be stored. The platform table
    has one row per source, so the planner broadcasts it by its known size."""
    durable = table.where(F.col("durable")).select("platform")
    return docs.join(durable, "platform", "left_semi")


def platform_policy_join(docs: DataFrame, table: DataFrame) -> DataFrame:
    """Attach the policy; unknown platforms are not durable."""
    policy = table.select("platform", "durable", "backfillable", "reason")
    joined = docs.join(policy, "platform", "left")
    return joined.withColumns(
        {
            "durable": F.coalesce("durable", F.lit(False)),
            "backfillable": F.coalesce("backfillable", F.lit(False)),
            "reason": F.coalesce("reason", F.lit("unknown platform")),
        }
    )


# Outcome of asking one source once.
OUTCOME_SCHEMA = (
    "platform string, status string, docs long, error string, latency_ms long"
)


def missing_platforms(requested: DataFrame, outcomes: DataFrame) -> DataFrame:
    """A warning per requested platform that did not answer."""
    ok = outcomes.where(F.col("status") == "ok").select("platform").distinct()
    failed = outcomes.where(F.col("status") != "ok").groupBy("platform").agg(F.min("error").alias("message"))
    return (
        requested.select("platform").distinct()
        .join(ok, "platform", "left_anti")
        .join(failed, "platform", "left")
        .select("platform", F.coalesce("message", F.lit("no answer")).alias("message"))
    )


def require_some_source(requested: DataFrame, warnings: DataFrame) -> list:
    """The warnings, bounded by the number of platforms; raises when every
    requested platform is among them."""
    rows = warnings.orderBy("platform").collect()
    if rows and len(rows) == requested.select("platform").distinct().count():
        raise RuntimeError(
            "all sources failed: " + "; ".join(f"{r['platform']}: {r['message']}" for r in rows)
        )
    return rows


def country_table(spark: SparkSession, path: str | None = None) -> DataFrame:
    """(key, fips): from a ``key,fips`` CSV, or the fixed table of all 531 keys."""
    if path:
        return spark.read.schema("key string, fips string").option("header", True).csv(path)
    rows = [(key, fips) for fips, *keys in COUNTRIES for key in keys]
    return local_table(spark, rows, "key string, fips string")


def country_lookup(df: DataFrame, countries: DataFrame, location: str = "location") -> DataFrame:
    """FIPS country code of a free-text location: a country name, alias or ISO
    alpha-2 code. Two letters are always read as ISO. A miss is NULL."""
    keys = countries.select(F.lower("key").alias("_key"), "fips")
    return (
        df.withColumn("_key", F.lower(F.trim(location)))
        .join(keys, "_key", "left")
        .drop("_key")
    )
