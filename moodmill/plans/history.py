"""Sentiment of a topic over time, from scored documents."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moodmill.operators.filters import topic_match
from moodmill.operators.scoring import DEFAULT_BACKEND, Backend, score_documents
from moodmill.operators.trend import topic_daily, topic_daily_all


def tagged_with_topics(docs: DataFrame, topics: Mapping[str, str], text: str = "text") -> DataFrame:
    """One row per (document, tracked topic it mentions). The topic list is part
    of the query, so documents are read once for all topics."""
    lowered = F.lower(text)
    named = F.array_compact(
        F.array(*[
            F.when(F.contains(lowered, F.lit(needle.lower())), F.lit(slug))
            for slug, needle in topics.items()
        ])
    )
    return docs.withColumn("topic", F.explode(named))


def topic_history(docs: DataFrame, topics: Mapping[str, str], backend: Backend = DEFAULT_BACKEND,
                  with_all: bool = False) -> DataFrame:
    """Daily series per topic and platform; ``with_all`` adds the deduplicated
    cross-platform series, which needs the content hash columns."""
    scored = tagged_with_topics(score_documents(docs, backend), topics)
    series = topic_daily(scored)
    return series.unionByName(topic_daily_all(scored)) if with_all else series


def one_topic(docs: DataFrame, slug: str, needle: str, backend: Backend = DEFAULT_BACKEND) -> DataFrame:
    matching = topic_match(docs, needle).withColumn("topic", F.lit(slug))
    return topic_daily(score_documents(matching, backend))
