"""Aggregation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from moodmill.catalog.registry import query
from moodmill.catalog.scoring import _PAIRS, ASPECTS
from moodmill.catalog.tables import (
    ALIVE,
    BACKEND,
    CORPUS,
    TOMBSTONES,
    aggregate_sql,
    corpus,
    rounded,
    scored_sql,
    soft_labels,
    table,
    tombstones,
    with_,
)
from moodmill.operators import aggregate as A
from moodmill.operators.scoring import score_aspects, score_documents
from moodmill.plans.training import prep_stats as stats


def _scored(spark, d):
    return score_documents(corpus(spark, d, spread=True), BACKEND)


@query(with_(CORPUS, scored_sql("corpus"), f"SELECT {aggregate_sql()} FROM scored"))
def sentiment_overall(spark, d):
    return rounded(A.sentiment_aggregate(_scored(spark, d)), "mean_polarity")


@query(with_(CORPUS, scored_sql("corpus"), f"SELECT {aggregate_sql()} FROM scored WHERE text = 'nothing has this text'"))
def sentiment_of_nothing(spark, d):
    none = corpus(spark, d).where("text = 'nothing has this text'")
    return rounded(A.sentiment_aggregate(score_documents(none, BACKEND)), "mean_polarity")


@query(with_(CORPUS, scored_sql("corpus"), f"SELECT {aggregate_sql('platform,')} FROM scored GROUP BY platform"))
def sentiment_by_platform(spark, d):
    return rounded(A.by_platform(_scored(spark, d)), "mean_polarity")


@query(with_(CORPUS, _PAIRS, scored_sql("windows"), f"SELECT {aggregate_sql('aspect,')} FROM scored GROUP BY aspect"))
def sentiment_by_aspect(spark, d):
    return rounded(A.by_aspect(score_aspects(corpus(spark, d, spread=True), ASPECTS, BACKEND)), "mean_polarity")


@query(
    with_(
        CORPUS, scored_sql("corpus"),
        f"""SELECT {aggregate_sql("'platform' AS scope, platform,")} FROM scored GROUP BY platform
UNION ALL SELECT {aggregate_sql("'overall', NULL,")} FROM scored""",
    )
)
def topic_rollup(spark, d):
    return rounded(A.topic_rollup(_scored(spark, d)), "mean_polarity")


@query(
    with_(
        CORPUS, TOMBSTONES, ALIVE,
        """SELECT (SELECT count(*) FROM corpus) AS raw_documents,
  (SELECT count(*) FROM doc_tombs) AS doc_tombstones, (SELECT count(*) FROM account_tombs) AS account_tombstones,
  (SELECT count(*) FROM corpus) - (SELECT count(*) FROM alive) AS dropped_by_tombstone,
  (SELECT count(*) FROM alive) - (SELECT count(*) FROM sized) AS dropped_by_length,
  (SELECT count(*) FROM sized) - (SELECT count(*) FROM deduped) AS dropped_as_duplicate,
  (SELECT count(*) FROM deduped) AS deduped""",
    )
)
def prep_stats(spark, d):
    return stats(corpus(spark, d, spread=True), tombstones(spark, d))


@query(with_(CORPUS, "SELECT platform, count(*) AS rows FROM corpus GROUP BY platform"))
def per_platform_counts(spark, d):
    return A.per_platform_counts(corpus(spark, d))


@query(
    with_(
        CORPUS, scored_sql("corpus"),
        """SELECT count(*) AS rows, count(DISTINCT (platform, doc_id)) AS distinct_keys,
  round(min(p_negative + p_neutral + p_positive), 6) AS min_sum,
  round(max(p_negative + p_neutral + p_positive), 6) AS max_sum, 1::BIGINT AS versions FROM scored""",
    )
)
def label_integrity(spark, d):
    return rounded(A.label_integrity(soft_labels(corpus(spark, d, spread=True), BACKEND)), "min_sum", "max_sum")


@query(
    """
SELECT CASE WHEN html = '' THEN 'failed' WHEN length(html) < 2000 THEN 'skipped' ELSE 'documents' END AS outcome,
  count(*) AS rows FROM pages GROUP BY 1"""
)
def harvest_stats(spark, d):
    outcome = F.when(F.col("html") == "", F.lit("failed")).when(F.length("html") < 2000, F.lit("skipped"))
    return A.outcome_stats(table(spark, d, "pages").withColumn("outcome", outcome.otherwise(F.lit("documents"))))
