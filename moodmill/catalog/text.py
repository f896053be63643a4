"""Text function queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from moodmill.catalog.registry import query
from moodmill.catalog.sources import PAGE_TEXT
from moodmill.catalog.tables import CORPUS, NORM, corpus, longs, table, with_
from moodmill.functions import hashing as H
from moodmill.functions import text as X
from moodmill.functions import times as TM
from moodmill.functions.aspects import STOP_WORDS, candidate_phrases, mine_aspects, rank_aspects
from moodmill.session import spread_small


@query(f"SELECT page_id, {PAGE_TEXT} AS text FROM pages")
def strip_html(spark, d):
    return spread_small(table(spark, d, "pages")).select("page_id", X.strip_html("html").alias("text"))


@query(
    r"""
SELECT page_id, regexp_replace(replace(replace(replace(replace(
  regexp_replace(replace(html, '<p>', chr(10)), '<[^>]+>', '', 'g'),
  '&quot;', chr(34)), '&middot;', '·'), '&copy;', '©'), '&amp;', '&'), '^\s+|\s+$', '', 'g') AS text FROM pages"""
)
def clean_html(spark, d):
    return spread_small(table(spark, d, "pages")).select("page_id", X.clean_html("html").alias("text"))


@query(f"SELECT doc_id, {NORM} AS normalized FROM documents")
def normalize_text(spark, d):
    return spread_small(table(spark, d, "documents")).select("doc_id", X.normalize_text("text").alias("normalized"))


@query(f"SELECT doc_id, sha256({NORM}) AS content_sha256, 1::BIGINT AS hash_version FROM documents")
def content_sha256(spark, d):
    return spread_small(table(spark, d, "documents")).select(
        "doc_id", H.content_sha256("text").alias("content_sha256"), F.lit(H.HASH_VERSION).cast("long").alias("hash_version")
    )


@query("SELECT page_id, substr(sha256(url), 1, 16) AS harvest_id, substr(sha1(url), 1, 16) AS search_id FROM pages")
def doc_hash(spark, d):
    return table(spark, d, "pages").select(
        "page_id", H.doc_hash("url").alias("harvest_id"), H.search_hash("url").alias("search_id")
    )


@query("SELECT doc_id, length(text[1:2000]) AS chars, text[1:2000] AS text FROM documents")
def truncate_text(spark, d):
    # The scoring service's request limit, an operator of its own.
    cut = X.truncate_text("text", 2000)
    return longs(table(spark, d, "documents").select("doc_id", F.length(cut).alias("chars"), cut.alias("text")), "chars")


@query(
    """
WITH hits AS (SELECT doc_id, text, strpos(lower(text), 'la ') AS hit FROM documents)
SELECT doc_id, CASE WHEN hit = 0 THEN text
  ELSE substr(text, greatest(hit - 40, 1), hit + 3 + 40 - greatest(hit - 40, 1)) END AS around FROM hits"""
)
def aspect_window(spark, d):
    return table(spark, d, "documents").select("doc_id", X.aspect_window("text", F.lit("LA ")).alias("around"))


_STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)
_PHRASES = rf"""
bounded AS (
  SELECT doc_id, string_split(trim(regexp_replace(
    regexp_replace(regexp_replace(lower(text), '\s+', ' ', 'g'), '[^\p{{L}}\p{{Nl}}\p{{No}} ]', ' | ', 'g'),
    '\s+', ' ', 'g')), ' ') AS words FROM documents
),
marked AS (
  SELECT doc_id, array_to_string(list_transform(words, lambda w: CASE WHEN w IN ({_STOPS}) THEN '|' ELSE w END), ' ') AS m
  FROM bounded
),
pieces AS (SELECT doc_id, list_transform(string_split(m, '|'), lambda p: string_split(trim(p), ' ')) AS ps FROM marked),
kept AS (
  SELECT doc_id, list_filter(ps, lambda p: len(p) <= 3 AND len(list_filter(p, lambda w: length(w) < 3)) = 0) AS ps FROM pieces
),
phrases AS (SELECT doc_id, unnest(ps) AS p, generate_subscripts(ps, 1) AS pos FROM kept)"""
_RANKED = f"""
{_PHRASES.strip()},
words AS (SELECT doc_id, unnest(p) AS w, len(p) AS n FROM phrases),
weights AS (SELECT doc_id, w, sum(n)::DOUBLE / count(*) AS weight FROM words GROUP BY doc_id, w),
firsts AS (SELECT doc_id, p, min(pos) AS pos FROM phrases GROUP BY doc_id, p),
parts AS (SELECT doc_id, p, pos, unnest(p) AS w FROM firsts),
scores AS (
  SELECT doc_id, p, pos, sum(weight) AS score FROM parts JOIN weights USING (doc_id, w) GROUP BY doc_id, p, pos
),
ranked AS (
  SELECT doc_id, array_to_string(p, ' ') AS aspect,
    row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, pos) - 1 AS rank
  FROM scores
)"""


@query(with_(_PHRASES, "SELECT doc_id, array_to_string(p, ' ') AS phrase, count(*) AS times FROM phrases GROUP BY ALL"))
def candidate_phrase_counts(spark, d):
    docs = spread_small(table(spark, d, "documents"))
    phrases = docs.select("doc_id", F.explode(candidate_phrases("text")).alias("phrase"))
    return phrases.groupBy("doc_id", "phrase").agg(F.count("*").alias("times"))


@query(with_(_RANKED, "SELECT doc_id, aspect, rank FROM ranked WHERE rank < 2"))
def mine_aspects_top2(spark, d):
    mined = spread_small(table(spark, d, "documents")).select("doc_id", F.posexplode(mine_aspects("text")).alias("rank", "aspect"))
    return longs(mined, "rank")


@query(with_(_RANKED, "SELECT doc_id, count(*) AS aspects, min(aspect) FILTER (rank = 0) AS best FROM ranked GROUP BY doc_id"))
def rank_all_aspects(spark, d):
    docs = spread_small(table(spark, d, "documents"))
    ranked = docs.select("doc_id", F.posexplode(rank_aspects(candidate_phrases("text"))).alias("rank", "aspect"))
    return ranked.groupBy("doc_id").agg(
        F.count("*").alias("aspects"), F.min(F.when(F.col("rank") == 0, F.col("aspect"))).alias("best")
    )


@query(
    """
SELECT CASE WHEN age <= 3600 THEN 'hour' WHEN age <= 86400 THEN 'day' WHEN age <= 604800 THEN 'week'
  WHEN age <= 2592000 THEN 'month' WHEN age <= 31536000 THEN 'year' ELSE 'all' END AS bucket, count(*) AS rows
FROM (SELECT epoch(TIMESTAMP '2024-01-31 00:00:00')::BIGINT - floor(epoch(ts))::BIGINT AS age FROM events) GROUP BY 1"""
)
def recency_bucket(spark, d):
    bucket = TM.recency_bucket(F.col("ts").cast("timestamp"), "2024-01-31T00:00:00Z")
    return table(spark, d, "events").groupBy(bucket.alias("bucket")).agg(F.count("*").alias("rows"))


@query(
    """
SELECT event_id, CASE WHEN event_id % 4 = 0 THEN '' ELSE strftime(ts, '%Y-%m-%dT%H:%M:%SZ') END AS formatted FROM events"""
)
def parse_seendate(spark, d):
    # Written as a feed writes it, read back, printed; every fourth is broken.
    raw = F.when(F.col("event_id") % 4 == 0, F.lit("20240133")).otherwise(
        F.date_format(F.col("ts").cast("timestamp"), "yyyyMMdd'T'HHmmss'Z'")
    )
    return table(spark, d, "events").select(
        "event_id", F.coalesce(TM.rfc3339(TM.parse_seendate(raw)), F.lit("")).alias("formatted")
    )


@query(
    """
SELECT CASE doc_id % 3 WHEN 0 THEN 'negative' WHEN 1 THEN 'neutral' ELSE 'positive' END AS label, count(*) AS rows
FROM documents GROUP BY 1"""
)
def canonical_label(spark, d):
    spellings = F.array(*[F.lit(s) for s in ("LABEL_0", "neu", "Positive", "Neg", "label_1", "pos")])
    raw = F.element_at(spellings, (F.col("doc_id") % 6).cast("int") + 1)
    return table(spark, d, "documents").groupBy(X.canonical_label(raw).alias("label")).agg(F.count("*").alias("rows"))


@query(
    """
SELECT doc_id, coalesce(nullif(CASE WHEN doc_id % 2 = 0 THEN '' ELSE lang END, ''),
  nullif(CASE WHEN doc_id % 3 = 0 THEN NULL ELSE source END, ''), '') AS first FROM documents"""
)
def first_non_empty(spark, d):
    return table(spark, d, "documents").select(
        "doc_id",
        X.first_non_empty(
            F.when(F.col("doc_id") % 2 == 0, F.lit("")).otherwise(F.col("lang")),
            F.when(F.col("doc_id") % 3 != 0, F.col("source")),
        ).alias("first"),
    )


@query("SELECT event_id, regexp_replace((value / 100)::FLOAT::VARCHAR, '\\.0$', '') AS shown FROM events")
def float32_text(spark, d):
    return table(spark, d, "events").select("event_id", X.float32_text(F.col("value") / 100).alias("shown"))


@query(with_(CORPUS, "SELECT platform, count(DISTINCT content_sha256) AS contents FROM corpus GROUP BY platform"))
def contents_per_platform(spark, d):
    return corpus(spark, d, spread=True).groupBy("platform").agg(F.count_distinct("content_sha256").alias("contents"))


