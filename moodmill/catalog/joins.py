"""Revocation, label and alignment joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from moodmill.catalog.registry import query
from moodmill.catalog.tables import (
    ALIVE,
    BACKEND,
    CORPUS,
    PLATFORMED,
    STUDENT,
    STUDENT_LEXICON,
    TEACHER,
    TOMBSTONES,
    by_real_platform,
    corpus,
    rounded,
    scored_sql,
    soft_labels,
    table,
    tombstones,
    with_,
)
from moodmill.operators import labels as L
from moodmill.operators import revocation as R
from moodmill.operators.platforms import missing_platforms as missing
from moodmill.schemas import PROBS


def _ids(df):
    return df.select("platform", "doc_id")


_NOT_DOC = "NOT EXISTS (SELECT 1 FROM doc_tombs t WHERE t.platform = c.platform AND t.doc_id = c.doc_id)"
_NOT_ACCOUNT = "NOT EXISTS (SELECT 1 FROM account_tombs t WHERE t.platform = c.platform AND t.author_did = c.author_did)"


@query(with_(CORPUS, TOMBSTONES, f"SELECT c.platform, c.doc_id FROM corpus c WHERE {_NOT_DOC}"))
def revoke_docs(spark, d):
    return _ids(R.revoke_docs(corpus(spark, d), tombstones(spark, d)))


@query(with_(CORPUS, TOMBSTONES, f"SELECT c.platform, c.doc_id FROM corpus c WHERE c.language = 'es' OR {_NOT_ACCOUNT}"))
def revoke_accounts(spark, d):
    # Spanish documents come without an author, so no account can revoke them.
    docs = corpus(spark, d).withColumn("author_did", F.when(F.col("language") != "es", F.col("author_did")))
    return _ids(R.revoke_accounts(docs, tombstones(spark, d)))


@query(with_(CORPUS, TOMBSTONES, ALIVE, "SELECT platform, doc_id FROM alive"))
def revoke_all(spark, d):
    return _ids(R.revoke(corpus(spark, d), tombstones(spark, d)))


@query(
    with_(
        CORPUS, TOMBSTONES, ALIVE,
        """SELECT c.platform, count(*) AS rows, count(*) - count(a.doc_id) AS revoked
FROM corpus c LEFT JOIN alive a USING (platform, doc_id) GROUP BY c.platform""",
    )
)
def mark_revoked(spark, d):
    marked = R.mark_revoked(corpus(spark, d), tombstones(spark, d))
    return marked.groupBy("platform").agg(F.count("*").alias("rows"), F.count_if("revoked").alias("revoked"))


# Documents in two languages are labelled already.
_LABELED = "language IN ('en', 'fr')"


def _existing(spark, d):
    return soft_labels(corpus(spark, d).where(_LABELED), BACKEND)


@query(with_(CORPUS, f"SELECT platform, doc_id FROM corpus WHERE NOT ({_LABELED})"))
def unlabeled_docs(spark, d):
    return _ids(L.unlabeled_docs(corpus(spark, d), _existing(spark, d), TEACHER))


@query(
    with_(
        CORPUS,
        f"SELECT count(*) AS total, count(*) FILTER ({_LABELED}) AS already_labeled, "
        f"count(*) FILTER (NOT ({_LABELED})) AS to_label FROM corpus",
    )
)
def label_stats(spark, d):
    return L.label_stats(corpus(spark, d), _existing(spark, d), TEACHER)


_PAIR_ASPECTS = ("the", "la")


@query(
    with_(
        CORPUS,
        f"""SELECT platform, doc_id, aspect FROM (SELECT *, unnest(['the', 'la']) AS aspect FROM corpus)
WHERE NOT ({_LABELED} AND aspect = 'the')""",
    )
)
def unlabeled_pairs(spark, d):
    pairs = corpus(spark, d).select("platform", "doc_id", F.explode(F.array(*[F.lit(a) for a in _PAIR_ASPECTS])).alias("aspect"))
    done = _existing(spark, d).withColumn("aspect", F.lit("the"))
    return L.unlabeled_pairs(pairs, done, TEACHER).select("platform", "doc_id", "aspect")


_P3 = "round(p_negative, 6) AS p_negative, round(p_neutral, 6) AS p_neutral, round(p_positive, 6) AS p_positive"


@query(with_(CORPUS, scored_sql("corpus"), f"SELECT platform, doc_id, {_P3} FROM scored WHERE {_LABELED}"))
def train_label_join(spark, d):
    joined = L.train_label_join(corpus(spark, d), _existing(spark, d), TEACHER)
    return rounded(joined.select("platform", "doc_id", *PROBS), *PROBS)


@query(
    with_(
        CORPUS, scored_sql("corpus"),
        f"SELECT platform, doc_id, aspect, {_P3} FROM (SELECT *, unnest(['the', 'la']) AS aspect FROM scored) WHERE {_LABELED}",
    )
)
def train_aspect_join(spark, d):
    labels = _existing(spark, d).withColumn("aspect", F.explode(F.array(F.lit("the"), F.lit("la"))))
    joined = L.train_aspect_join(corpus(spark, d), labels, TEACHER)
    return rounded(joined.select("platform", "doc_id", "aspect", *PROBS), *PROBS)


@query(
    with_(
        CORPUS,
        scored_sql("corpus", "teacher"),
        scored_sql("corpus", "student", lexicon=STUDENT_LEXICON),
        """SELECT doc_id, platform, round(s.p_negative, 6) AS s_p_negative, round(s.p_neutral, 6) AS s_p_neutral,
  round(s.p_positive, 6) AS s_p_positive, round(t.p_negative, 6) AS t_p_negative,
  round(t.p_neutral, 6) AS t_p_neutral, round(t.p_positive, 6) AS t_p_positive
FROM student s JOIN teacher t USING (platform, doc_id)""",
    )
)
def align_student_teacher(spark, d):
    docs = corpus(spark, d)
    aligned = L.align_student_teacher(soft_labels(docs, STUDENT), soft_labels(docs, BACKEND))
    return rounded(aligned, *[f"{s}_{p}" for s in "st" for p in PROBS])


@query(
    with_(
        CORPUS,
        PLATFORMED,
        """SELECT p.platform, CASE WHEN count(o.n) = 0 THEN 'no answer' ELSE 'unexpected response' END AS message
FROM (SELECT DISTINCT platform FROM platformed) p
LEFT JOIN (SELECT * FROM platformed WHERE platform IN ('rss', 'reddit')) o USING (platform)
WHERE p.platform IN ('rss', 'reddit', 'youtube') GROUP BY p.platform""",
    )
)
def missing_platforms(spark, d):
    # Two platforms failed, one was never heard of, the rest answered.
    docs = by_real_platform(corpus(spark, d))
    requested = docs.select("platform").distinct()
    status = F.when(F.col("platform").isin("rss", "reddit"), F.lit("failed")).otherwise(F.lit("ok"))
    outcomes = docs.where("platform <> 'youtube'").groupBy("platform").agg(F.count("*").alias("docs")).withColumns(
        {"status": status, "error": F.when(status == "failed", F.lit("unexpected response"))}
    )
    return missing(requested, outcomes)


@query(
    """
SELECT event_type, count(*) AS rows, count(n_docs) AS known FROM events
LEFT JOIN (SELECT 'u-' || (doc_id % 150) AS author, count(*) AS n_docs FROM documents GROUP BY 1)
  ON author = 'u-' || user_id GROUP BY event_type"""
)
def author_join(spark, d):
    authors = corpus(spark, d).groupBy("author_did").agg(F.count("*").alias("n_docs"))
    events = table(spark, d, "events").select(
        "event_type", F.concat(F.lit("u-"), F.col("user_id").cast("string")).alias("author_did")
    )
    return events.join(authors, "author_did", "left").groupBy("event_type").agg(
        F.count("*").alias("rows"), F.count("n_docs").alias("known")
    )


