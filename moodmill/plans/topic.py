"""Sentiment of inline documents, and of a topic across platforms."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moodmill.functions.times import now_literal, utc_now
from moodmill.operators import aggregate as A
from moodmill.operators import filters as flt
from moodmill.operators.dedupe import dedupe_by_id
from moodmill.operators.platforms import missing_platforms, require_some_source, select_platforms
from moodmill.operators.ranking import limit_per_platform, newest_first
from moodmill.operators.scoring import DEFAULT_BACKEND, Backend, score_aspects, score_documents
from moodmill.session import local_table


@dataclass
class TextAnalysis:
    results: DataFrame
    aggregate: DataFrame
    aspect_scores: DataFrame | None = None


@dataclass
class TopicAnalysis:
    topic: str
    results: DataFrame
    aggregate: DataFrame
    by_platform: DataFrame
    by_aspect: DataFrame
    aspect_scores: DataFrame
    warnings: DataFrame
    partial: bool


def analyze_text(docs: DataFrame, include_aspects: bool = False, backend: Backend = DEFAULT_BACKEND,
                 now: dt.datetime | str | None = None) -> TextAnalysis:
    """Scores of inline documents (``index``, ``text``, optional ``aspects``)
    and their aggregate. No documents give the empty aggregate."""
    scored = score_documents(docs, backend).withColumn("analyzed_at", now_literal(now or utc_now()))
    pairs = None
    if include_aspects and "aspects" in docs.columns:
        pairs = score_aspects(docs, "aspects", backend)
    return TextAnalysis(scored, A.sentiment_aggregate(scored), pairs)


def matching_documents(docs: DataFrame, topic: str, *, location: str | None = None,
                       language: str | None = None, since_seconds: int = 0,
                       now: dt.datetime | str | None = None,
                       haystack: Sequence[str] = ("text",)) -> DataFrame:
    """What a search for the topic finds in landed documents."""
    found = flt.topic_match(docs, topic, *haystack)
    found = flt.location_match(found, location, *haystack)
    found = flt.language_match(found, language)
    return flt.since(found, since_seconds, now or utc_now())


def topic_documents(docs: DataFrame, topic: str, limit: int | None = None,
                    order: Sequence[Column] | None = None, **search) -> DataFrame:
    """Search, limit per platform if asked to, then keep the first row per document id."""
    order = order or newest_first()
    found = limit_per_platform(matching_documents(docs, topic, **search), limit, order=order)
    return dedupe_by_id(found, order)


def analyze_topic(docs: DataFrame, topic: str, *, platforms: DataFrame, wanted: Sequence[str] = (),
                  outcomes: DataFrame | None = None, limit: int | None = None,
                  aspects: Sequence[str] = (), backend: Backend = DEFAULT_BACKEND,
                  now: dt.datetime | str | None = None, **search) -> TopicAnalysis:
    """Sentiment on a topic: select platforms, search, limit, dedupe, score and
    aggregate overall, by platform and by aspect.

    ``outcomes`` says which platforms answered; those that did not become
    warnings and make the analysis partial, and if none did it is an error.
    """
    if not topic.strip():
        raise ValueError("topic is required")
    now = now or utc_now()
    asked = select_platforms(platforms, wanted)
    spark = docs.sparkSession
    dropped = []
    if outcomes is not None:
        dropped = require_some_source(asked, missing_platforms(asked, outcomes))
    # A handful of names from the platform table: as a plain filter they reach
    # the scan and prune platform folders.
    silent = {r["platform"] for r in dropped}
    answered = sorted({r["platform"] for r in asked.select("platform").collect()} - silent)
    usable = docs.where(F.col("platform").isin(*answered))
    chosen = topic_documents(usable, topic, limit, now=now, **search)
    scored = score_documents(chosen, backend).withColumn("analyzed_at", now_literal(now))
    pairs = score_aspects(chosen, aspects, backend)
    return TopicAnalysis(
        topic=topic,
        results=scored,
        aggregate=A.sentiment_aggregate(scored),
        by_platform=A.by_platform(scored),
        by_aspect=A.by_aspect(pairs),
        aspect_scores=pairs,
        warnings=local_table(spark, [tuple(r) for r in dropped], "platform string, message string"),
        partial=bool(dropped),
    )


def ordered_results(analysis: TopicAnalysis) -> DataFrame:
    """Results in export order."""
    return analysis.results.orderBy("platform", F.col("posted_at").desc_nulls_last(), "doc_id")
