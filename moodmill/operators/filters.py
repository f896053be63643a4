"""Row filters. Each takes a document DataFrame and returns one."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moodmill.functions.hashing import in_sample
from moodmill.functions.text import as_col, extract_symbol, is_blank
from moodmill.functions.times import now_literal

MIN_CHARS, MAX_CHARS = 40, 2000


def within_chars(text: Column | str, low: int = MIN_CHARS, high: int = MAX_CHARS) -> Column:
    """Length in characters; a high bound of 0 is no bound."""
    n = F.length(as_col(text))
    keep = n >= low
    return keep & (n <= high) if high else keep


def within_bytes(text: Column | str, low: int = 0, high: int = 0) -> Column:
    """Length in UTF-8 bytes; a bound of 0 is no bound."""
    n = F.octet_length(as_col(text))
    keep = F.lit(True)
    if low > 0:
        keep = keep & (n >= low)
    if high > 0:
        keep = keep & (n <= high)
    return keep


def allows_langs(langs: Column | str, wanted: Iterable[str]) -> Column:
    """True if any declared language, region stripped, is wanted. Documents
    declaring none pass only when nothing is asked for."""
    wanted = sorted({w.lower() for w in wanted})
    if not wanted:
        return F.lit(True)
    declared = F.exists(
        as_col(langs), lambda tag: F.substring_index(F.lower(tag), "-", 1).isin(*wanted)
    )
    return F.coalesce(declared, F.lit(False))


def length_between(df: DataFrame, low: int = MIN_CHARS, high: int = MAX_CHARS, text: str = "text") -> DataFrame:
    return df.where(within_chars(text, low, high))


def bytes_between(df: DataFrame, low: int = 0, high: int = 0, text: str = "text") -> DataFrame:
    return df.where(within_bytes(text, low, high))


def lang_allow(df: DataFrame, wanted: Iterable[str], langs: str = "langs") -> DataFrame:
    return df.where(allows_langs(langs, wanted))


def hash_sample(df: DataFrame, rate: float, key: Column | str = "doc_id") -> DataFrame:
    return df.where(in_sample(key, rate))


def drop_blank_text(df: DataFrame, text: str = "text") -> DataFrame:
    return df.where(~is_blank(text))


def _plain(needle: str | None) -> str:
    return (needle or "").replace('"', "").strip().lower()


def topic_match(df: DataFrame, topic: str, *haystack: str) -> DataFrame:
    """Case-insensitive substring search over the joined haystack columns.
    NULL columns count as empty."""
    return df.where(F.contains(_haystack(haystack or ("text",)), F.lit(topic.lower())))


def location_match(df: DataFrame, location: str | None, *haystack: str) -> DataFrame:
    """A second substring over the same haystack; blank is no filter."""
    needle = _plain(location)
    if not needle:
        return df
    return df.where(F.contains(_haystack(haystack or ("text",)), F.lit(needle)))


def _haystack(columns: Iterable[str]) -> Column:
    return F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in columns]))


def since(df: DataFrame, seconds: int, now: dt.datetime | str, posted_at: str = "posted_at",
          keep_unknown: bool = True) -> DataFrame:
    """Drop what was posted more than ``seconds`` before ``now``; rows without
    a time stay if ``keep_unknown``. No limit when seconds is not positive."""
    if not seconds or seconds <= 0:
        return df
    cutoff = now_literal(now) - F.make_dt_interval(secs=F.lit(seconds))
    fresh = F.col(posted_at) >= cutoff
    return df.where(F.coalesce(fresh, F.lit(keep_unknown)))


def language_match(df: DataFrame, language: str | None, column: str = "language") -> DataFrame:
    if not language:
        return df
    return df.where(F.col(column) == language)


def cashtag_match(df: DataFrame, topic: str, text: str = "text") -> DataFrame:
    """Documents about the ticker a topic names; none when it names no ticker."""
    wanted = extract_symbol(F.lit(topic))
    return df.where((wanted != "") & (extract_symbol(text) == wanted))


def version_pin(labels: DataFrame, teacher_version: str) -> DataFrame:
    return labels.where(F.col("teacher_version") == teacher_version)


def purge_source(df: DataFrame, platform: str) -> DataFrame:
    """Everything but one source's rows: its standing revocation."""
    return df.where(F.col("platform") != platform)


def expire_text(df: DataFrame, now: dt.datetime | str, days: int = 180, at: str = "created_at") -> DataFrame:
    """Documents young enough for their text to be kept. Labels are separate
    tables and are never expired.

    Where a document has no readable time of its own, the time it was harvested
    counts, then its day; one without any of these is not kept.
    """
    kinds = dict(df.dtypes)
    moments = [
        F.try_to_timestamp(F.col(c)) if kinds[c] == "string" else F.col(c).cast("timestamp")
        for c in (at, "harvested_at", "dt") if c in kinds
    ]
    cutoff = now_literal(now) - F.make_dt_interval(days=F.lit(days))
    return df.where(F.coalesce(F.coalesce(*moments) >= cutoff, F.lit(False)))
