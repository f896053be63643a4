"""Deduplication and set-operation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from moodmill.catalog.registry import query
from moodmill.catalog.tables import BACKEND, CORPUS, TEACHER, corpus, longs, soft_labels, table, with_
from moodmill.functions.text import normalize_text
from moodmill.operators import dedupe as D
from moodmill.operators.dedupe import union_sources


@query(
    with_(
        CORPUS,
        """SELECT platform, doc_id, content_sha256 FROM corpus QUALIFY row_number() OVER (
  PARTITION BY hash_version, content_sha256 ORDER BY posted_at, doc_id, platform) = 1""",
    )
)
def dedupe_content(spark, d):
    return D.dedupe_content(corpus(spark, d, spread=True)).select("platform", "doc_id", "content_sha256")


@query(
    with_(
        CORPUS,
        """SELECT platform, doc_id, version FROM (
  SELECT *, 1 AS version FROM corpus UNION ALL SELECT *, 2 FROM corpus WHERE language = 'en'
  UNION ALL SELECT *, 0 FROM corpus WHERE language = 'de')
QUALIFY row_number() OVER (PARTITION BY platform, doc_id ORDER BY version) = 1""",
    )
)
def dedupe_by_id(spark, d):
    # Some documents were found by two searches; the earlier one counts.
    docs = corpus(spark, d).withColumn("version", F.lit(1))
    seen = union_sources(
        docs,
        docs.where("language = 'en'").withColumn("version", F.lit(2)),
        docs.where("language = 'de'").withColumn("version", F.lit(0)),
    )
    return longs(D.dedupe_by_id(seen, ["version"]).select("platform", "doc_id", "version"), "version")


@query(
    """
SELECT 'documents' AS kind, count(*) AS rows, count(lang) AS langs, 0::BIGINT AS urls FROM documents
UNION ALL SELECT 'pages', count(*), 0, count(url) FROM pages"""
)
def union_by_name(spark, d):
    docs = table(spark, d, "documents").select(F.lit("documents").alias("kind"), "lang", "text")
    pages = table(spark, d, "pages").select("url", F.lit("pages").alias("kind"))
    return union_sources(docs, pages).groupBy("kind").agg(
        F.count("*").alias("rows"), F.count("lang").alias("langs"), F.count("url").alias("urls")
    )


@query(
    with_(
        CORPUS,
        f"""SELECT CASE WHEN language = 'en' THEN 'older' ELSE '{TEACHER}' END AS teacher_version, count(*) AS rows
FROM corpus GROUP BY 1""",
    )
)
def union_all_labels(spark, d):
    docs = corpus(spark, d)
    older = soft_labels(docs.where("language = 'en'"), BACKEND).withColumn("teacher_version", F.lit("older"))
    newer = soft_labels(docs.where("language <> 'en'"), BACKEND)
    return older.union(newer).groupBy("teacher_version").agg(F.count("*").alias("rows"))


@query(
    r"""
WITH words AS (
  SELECT doc_id, w, min(i) AS i FROM (
    SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i
    FROM (SELECT doc_id, string_split(lower(trim(regexp_replace(text, '\s+', ' ', 'g'))), ' ') AS ws FROM documents))
  GROUP BY doc_id, w)
SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS first_two FROM (
  SELECT * FROM words QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY i) <= 2) GROUP BY doc_id"""
)
def distinct_aspects(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.split(normalize_text("text"), " ").alias("aspects"))
    return D.distinct_aspects(docs).select("doc_id", F.array_join("aspects", " ").alias("first_two"))


@query(
    with_(
        CORPUS,
        """SELECT platform, doc_id, content_sha256 FROM corpus QUALIFY row_number() OVER (
  PARTITION BY content_sha256, platform ORDER BY posted_at DESC, doc_id) = 1""",
    )
)
def latest_copy_per_platform(spark, d):
    order = [F.col("posted_at").desc(), F.col("doc_id")]
    return D.keep_first(corpus(spark, d, spread=True), ["content_sha256", "platform"], order).select(
        "platform", "doc_id", "content_sha256"
    )
