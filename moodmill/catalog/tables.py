"""The engine's tables derived from the shared test tables, in Spark and in SQL.

Both derivations state the same mapping; neither drops a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from moodmill.functions.hashing import HASH_VERSION, content_sha256
from moodmill.functions.scoring import Lexicon
from moodmill.functions.times import RFC3339
from moodmill.operators.platforms import PLATFORMS
from moodmill.operators.scoring import LexiconBackend
from moodmill.session import spread_small

NOW = "2024-03-01T00:00:00Z"
TODAY = "2024-02-12"
TEACHER = "teacher@v1"

# Words frequent in the test prose, so that all three classes occur.
LEXICON = Lexicon(positive=("the", "and", "la", "der"), negative=("of", "de", "que", "is"))
STUDENT_LEXICON = Lexicon(positive=("the", "la", "der"), negative=("of", "de", "que"))
BACKEND = LexiconBackend(LEXICON)
STUDENT = LexiconBackend(STUDENT_LEXICON)

PLATFORM_NAMES = tuple(p[0] for p in PLATFORMS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def created(doc_id: Column) -> Column:
    return F.timestamp_seconds(F.lit(1704067200) + doc_id * 3600)


def corpus(spark: SparkSession, sf_dir: str, spread: bool = False) -> DataFrame:
    """Documents as corpus rows; ``spread`` for CPU-bound queries."""
    docs = table(spark, sf_dir, "documents")
    if spread:
        docs = spread_small(docs)
    posted = created(F.col("doc_id"))
    return docs.select(
        F.col("source").alias("platform"),
        F.concat(F.lit("d-"), F.col("doc_id").cast("string")).alias("doc_id"),
        F.concat(F.lit("u-"), (F.col("doc_id") % 150).cast("string")).alias("author_did"),
        F.lit("").alias("author"),
        "text",
        F.array("lang").alias("langs"),
        F.col("lang").alias("language"),
        F.lit("").alias("url"),
        posted.alias("posted_at"),
        F.date_format(posted, RFC3339).alias("created_at"),
        content_sha256("text").alias("content_sha256"),
        F.lit(HASH_VERSION).alias("hash_version"),
    )


NORM = r"lower(trim(regexp_replace(text, '\s+', ' ', 'g')))"
CORPUS = rf"""
corpus AS (
  SELECT source AS platform, 'd-' || doc_id AS doc_id, 'u-' || (doc_id % 150) AS author_did,
         text, lang AS language, doc_id AS n,
         TIMESTAMP '2024-01-01 00:00:00' + to_hours(doc_id::INTEGER) AS posted_at,
         sha256({NORM}) AS content_sha256, 1 AS hash_version
  FROM documents
)"""


def by_real_platform(docs: DataFrame) -> DataFrame:
    """The corpus spread over the ten real platform ids, by document number."""
    number = F.substring("doc_id", 3, 20).cast("long")
    names = F.array(*[F.lit(p) for p in PLATFORM_NAMES])
    return docs.withColumn("platform", F.element_at(names, (number % len(PLATFORM_NAMES)).cast("int") + 1))


_NAMES_SQL = ", ".join(f"'{p}'" for p in PLATFORM_NAMES)
PLATFORMED = f"""
platformed AS (
  SELECT * EXCLUDE (platform), ([{_NAMES_SQL}])[(n % {len(PLATFORM_NAMES)})::INTEGER + 1] AS platform FROM corpus
)"""


def tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxic documents are deleted; some users' accounts are."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    doc_scope = (
        table(spark, sf_dir, "labels").where("toxic = 1").join(docs, "doc_id")
        .select(
            F.col("source").alias("platform"), F.lit("doc").alias("scope"),
            F.concat(F.lit("d-"), F.col("doc_id").cast("string")).alias("doc_id"),
            F.concat(F.lit("u-"), (F.col("doc_id") % 150).cast("string")).alias("author_did"),
        )
    )
    users = (
        table(spark, sf_dir, "events").where("event_type = 'error' AND user_id % 10 = 0")
        .select(F.concat(F.lit("u-"), F.col("user_id").cast("string")).alias("author_did")).distinct()
    )
    # An account exists on every platform its author posted to.
    owned = docs.select(
        F.col("source").alias("platform"),
        F.concat(F.lit("u-"), (F.col("doc_id") % 150).cast("string")).alias("author_did"),
    ).distinct()
    account_scope = owned.join(users, "author_did").select(
        "platform", F.lit("account").alias("scope"), F.lit(None).cast("string").alias("doc_id"), "author_did"
    )
    return doc_scope.unionByName(account_scope).withColumn("deleted_at", F.lit(NOW))


TOMBSTONES = """
doc_tombs AS (
  SELECT d.source AS platform, 'd-' || d.doc_id AS doc_id
  FROM labels l JOIN documents d USING (doc_id) WHERE l.toxic = 1
),
account_tombs AS (
  SELECT DISTINCT d.source AS platform, 'u-' || (d.doc_id % 150) AS author_did
  FROM documents d
  WHERE 'u-' || (d.doc_id % 150) IN (
    SELECT 'u-' || user_id FROM events WHERE event_type = 'error' AND user_id % 10 = 0)
)"""

ALIVE = """
alive AS (
  SELECT c.* FROM corpus c
  WHERE NOT EXISTS (SELECT 1 FROM doc_tombs t WHERE t.platform = c.platform AND t.doc_id = c.doc_id)
    AND NOT EXISTS (SELECT 1 FROM account_tombs t WHERE t.platform = c.platform AND t.author_did = c.author_did)
),
sized AS (SELECT * FROM alive WHERE length(text) BETWEEN 40 AND 2000),
deduped AS (
  SELECT * FROM sized
  QUALIFY row_number() OVER (
    PARTITION BY hash_version, content_sha256 ORDER BY posted_at, doc_id, platform) = 1
)"""


def words_sql(words: tuple[str, ...]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def scored_sql(source: str, out: str = "scored", text: str = "text", lexicon: Lexicon = LEXICON) -> str:
    """CTEs adding p_*, label, confidence and polarity to ``source``."""
    toks = f"regexp_extract_all({text}, '[A-Za-z][A-Za-z'']+')"
    hits = lambda ws: f"len(list_filter({toks}, lambda w: lower(w) IN ({words_sql(ws)})))"
    return f"""
{out}_counted AS (
  SELECT *, {hits(lexicon.negative)}::DOUBLE AS neg_, {hits(lexicon.positive)}::DOUBLE AS pos_ FROM {source}
),
{out}_powers AS (
  SELECT *, exp(neg_ - greatest(neg_, 0.5, pos_)) AS e0, exp(0.5 - greatest(neg_, 0.5, pos_)) AS e1,
         exp(pos_ - greatest(neg_, 0.5, pos_)) AS e2 FROM {out}_counted
),
{out}_probs AS (
  SELECT * EXCLUDE (neg_, pos_, e0, e1, e2), e0 / (e0 + e1 + e2) AS p_negative,
         e1 / (e0 + e1 + e2) AS p_neutral, e2 / (e0 + e1 + e2) AS p_positive FROM {out}_powers
),
{out} AS (
  SELECT *, CASE WHEN p_negative > p_neutral AND p_negative > p_positive THEN 'negative'
                 WHEN p_positive > p_neutral AND p_positive > p_negative THEN 'positive'
                 ELSE 'neutral' END AS label,
         greatest(p_negative, p_neutral, p_positive) AS confidence,
         p_positive - p_negative AS polarity FROM {out}_probs
)"""


def with_(*parts: str) -> str:
    """WITH a, b, ... SELECT: the last part is the final statement."""
    return "WITH " + ",\n".join(p.strip() for p in parts[:-1]) + "\n" + parts[-1]


def aggregate_sql(keys: str = "") -> str:
    """Select list of sentiment_aggregate; ``keys`` ends with a comma or is ''."""
    return f"""{keys} count(*) AS sample_size,
  round(coalesce(avg(polarity), 0), 6) AS mean_polarity,
  count(*) FILTER (label = 'negative') AS n_negative,
  count(*) FILTER (label = 'neutral') AS n_neutral,
  count(*) FILTER (label = 'positive') AS n_positive,
  CASE WHEN count(*) = 0 THEN ''
       WHEN count(*) FILTER (label = 'neutral') >= count(*) FILTER (label = 'positive')
        AND count(*) FILTER (label = 'neutral') >= count(*) FILTER (label = 'negative') THEN 'neutral'
       WHEN count(*) FILTER (label = 'positive') >= count(*) FILTER (label = 'negative') THEN 'positive'
       ELSE 'negative' END AS modal_label"""


SCORES_OUT = (
    "label, round(confidence, 6) AS confidence, round(polarity, 6) AS polarity, "
    "round(p_negative, 6) AS p_negative, round(p_neutral, 6) AS p_neutral, round(p_positive, 6) AS p_positive"
)


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def longs(df: DataFrame, *columns: str) -> DataFrame:
    """Counts and positions as 64-bit integers, which SQL gives for them."""
    return df.withColumns({c: F.col(c).cast("long") for c in columns})


SCORE_DOUBLES = ("confidence", "polarity", "p_negative", "p_neutral", "p_positive")


def soft_labels(docs: DataFrame, backend: LexiconBackend = BACKEND) -> DataFrame:
    """A label table of one teacher version over all documents."""
    probs = backend.probabilities(docs.select("platform", "doc_id", "text"), "text")
    return probs.select(
        "platform", "doc_id", "p_negative", "p_neutral", "p_positive", F.lit(TEACHER).alias("teacher_version")
    )
