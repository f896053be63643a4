"""Ranking, batching and ordering queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from moodmill.catalog.registry import query
from moodmill.catalog.tables import CORPUS, PLATFORMED, by_real_platform, corpus, longs, table, with_
from moodmill.functions.text import normalize_text
from moodmill.operators import ranking as R
from moodmill.operators.ranking import SOURCE_CAPS

_KEY = "md5(platform || chr(31) || doc_id)"


@query(
    with_(
        CORPUS,
        f"SELECT platform, doc_id, row_number() OVER (ORDER BY length(text), {_KEY}) AS rank FROM corpus",
    )
)
def length_rank(spark, d):
    return R.length_rank(corpus(spark, d)).select("platform", "doc_id", "rank")


_BATCHES = f"""
ranked AS (SELECT *, row_number() OVER (ORDER BY length(text), {_KEY}) - 1 AS r FROM corpus),
batched AS (SELECT *, r // 500 AS flush_id, (r % 500) // 32 AS batch_id, (r % 500) % 32 AS slot FROM ranked),
halved AS (
  SELECT *, CASE WHEN max(length(text)) OVER b > 1200 AND count(*) OVER b > 1
    AND slot >= count(*) OVER b // 2 THEN 1 ELSE 0 END AS half
  FROM batched WINDOW b AS (PARTITION BY flush_id, batch_id)
)"""


@query(with_(CORPUS, _BATCHES, "SELECT platform, doc_id, flush_id::BIGINT AS flush_id, batch_id::BIGINT AS batch_id, half::BIGINT AS half FROM halved"))
def length_order_batches(spark, d):
    batched = R.length_order_batches(corpus(spark, d), 32, flush_every=500)
    return longs(batched.select("platform", "doc_id", "flush_id", "batch_id", "half"), "half")


@query(
    with_(
        CORPUS, _BATCHES,
        """SELECT flush_id::BIGINT AS flush_id, batch_id::BIGINT AS batch_id, half::BIGINT AS half, count(*) AS rows,
  max(length(text)) AS longest, sum(length(text))::BIGINT AS real_chars, (count(*) * max(length(text)))::BIGINT AS padded_chars
FROM halved GROUP BY 1, 2, 3""",
    )
)
def batch_padding_cost(spark, d):
    batched = R.length_order_batches(corpus(spark, d), 32, flush_every=500)
    return longs(R.batch_padding_cost(batched), "half", "longest")


_CAPS = "CASE platform " + " ".join(f"WHEN '{p}' THEN {c}" for p, c in SOURCE_CAPS.items()) + " ELSE 60 END"


@query(
    with_(
        CORPUS, PLATFORMED,
        f"""SELECT platform, doc_id FROM platformed
QUALIFY row_number() OVER (PARTITION BY platform ORDER BY posted_at DESC, doc_id) <= least(60, {_CAPS})""",
    )
)
def limit_per_platform(spark, d):
    return R.limit_per_platform(by_real_platform(corpus(spark, d)), 60, SOURCE_CAPS).select("platform", "doc_id")


@query(
    r"""
SELECT doc_id, unnest(ws) AS word, (generate_subscripts(ws, 1) - 1)::BIGINT AS position FROM (
  SELECT doc_id, string_split(lower(trim(regexp_replace(text, '\s+', ' ', 'g'))), ' ') AS ws FROM documents)"""
)
def with_index(spark, d):
    words = table(spark, d, "documents").select("doc_id", F.split(normalize_text("text"), " ").alias("word"))
    return longs(R.with_index(words, "word", "position"), "position")


@query(
    with_(
        CORPUS, PLATFORMED,
        "SELECT platform, doc_id, row_number() OVER (PARTITION BY platform ORDER BY n) AS place FROM platformed",
    )
)
def platform_order(spark, d):
    # The order itself is checked in the tests; here, each row's place in it.
    docs = by_real_platform(corpus(spark, d)).withColumn("ordinal", F.substring("doc_id", 3, 20).cast("long"))
    place = F.row_number().over(Window.partitionBy("platform").orderBy("ordinal"))
    return longs(R.platform_order(docs).select("platform", "doc_id", place.alias("place")), "place")
