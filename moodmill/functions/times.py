"""Parsing, formatting and bucketing of time. ``now`` is always a parameter."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from moodmill.functions.text import as_col

RFC3339 = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def now_literal(now: dt.datetime | str) -> Column:
    """A timestamp literal from an aware/naive-UTC datetime or RFC 3339 text."""
    if isinstance(now, dt.datetime):
        if now.tzinfo is not None:
            now = now.astimezone(dt.timezone.utc).replace(tzinfo=None)
        now = now.isoformat(sep=" ") + "Z"
    return F.lit(now).cast("timestamp")


def utc_now() -> dt.datetime:
    return dt.datetime.now(dt.timezone.utc)


def parse_timestamp(text: Column | str) -> Column:
    """RFC 3339 text to timestamp, NULL when it does not parse."""
    return F.try_to_timestamp(as_col(text))


def parse_seendate(text: Column | str) -> Column:
    """``20260807T130000Z`` to timestamp, NULL when it does not parse."""
    return F.try_to_timestamp(as_col(text), F.lit("yyyyMMdd'T'HHmmssX"))


def rfc3339(moment: Column | str) -> Column:
    """UTC text of a timestamp; NULL stays NULL. Sessions run in UTC."""
    return F.date_format(as_col(moment), RFC3339)


def utc_day(moment: Column | str) -> Column:
    return F.to_date(as_col(moment))


# Named look-back windows and their length in seconds.
RECENCY = (
    ("hour", 60 * 60),
    ("day", 24 * 60 * 60),
    ("week", 7 * 24 * 60 * 60),
    ("month", 30 * 24 * 60 * 60),
    ("year", 365 * 24 * 60 * 60),
)


def recency_bucket(moment: Column | str, now: dt.datetime | str) -> Column:
    """The smallest named window before ``now`` that holds ``moment``."""
    age = now_literal(now).cast("long") - as_col(moment).cast("timestamp").cast("long")
    out = F.lit("all")
    for name, seconds in reversed(RECENCY):
        out = F.when(age <= seconds, F.lit(name)).otherwise(out)
    return out
