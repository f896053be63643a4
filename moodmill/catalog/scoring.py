"""Scoring queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from moodmill.catalog.registry import query
from moodmill.catalog.tables import (
    BACKEND,
    CORPUS,
    LEXICON,
    SCORE_DOUBLES,
    SCORES_OUT,
    corpus,
    longs,
    rounded,
    scored_sql,
    table,
    with_,
    words_sql,
)
from moodmill.functions import scoring as S
from moodmill.operators import scoring as K
from moodmill.operators.scoring import ModelBackend, score_aspects, score_documents

ASPECTS = ("the", "la", "battery")


def _hits(tokens: str, words: tuple[str, ...]) -> str:
    return f"len(list_filter({tokens}, lambda w: lower(w) IN ({words_sql(words)})))"


_TOKENS = "regexp_extract_all(text, '[A-Za-z][A-Za-z'']+')"


@query(
    f"SELECT doc_id, {_hits(_TOKENS, LEXICON.positive)} AS positive, {_hits(_TOKENS, LEXICON.negative)} AS negative FROM documents"
)
def lexicon_counts(spark, d):
    words = table(spark, d, "documents").withColumn("w", S.tokens("text"))
    return longs(
        words.select(
            "doc_id",
            S.count_in("w", LEXICON.positive).alias("positive"),
            S.count_in("w", LEXICON.negative).alias("negative"),
        ),
        "positive", "negative",
    )


_TRIMMED = r"list_transform(regexp_split_to_array(lower(text), '\s+'), lambda w: trim(w, '.,!?;:''\"()'))".replace('\\"', '"')


@query(
    f"SELECT doc_id, {_hits(_TRIMMED, LEXICON.positive)} AS positive, {_hits(_TRIMMED, LEXICON.negative)} AS negative FROM documents"
)
def lexicon_counts_trim(spark, d):
    words = table(spark, d, "documents").withColumn("w", S.tokens("text", trimmed=True))
    return longs(
        words.select(
            "doc_id",
            S.count_in("w", LEXICON.positive).alias("positive"),
            S.count_in("w", LEXICON.negative).alias("negative"),
        ),
        "positive", "negative",
    )


@query(with_(CORPUS, scored_sql("corpus"), f"SELECT platform, doc_id, {SCORES_OUT} FROM scored"))
def score_all_documents(spark, d):
    scored = score_documents(corpus(spark, d, spread=True), BACKEND)
    return rounded(scored.select("platform", "doc_id", *K.SCORE_COLUMNS), *SCORE_DOUBLES)


@query(
    with_(
        CORPUS,
        scored_sql("corpus"),
        """SELECT doc_id, 'negative' AS class, round(p_negative, 6) AS p FROM scored
UNION ALL SELECT doc_id, 'neutral', round(p_neutral, 6) FROM scored
UNION ALL SELECT doc_id, 'positive', round(p_positive, 6) FROM scored""",
    )
)
def probability_map(spark, d):
    scored = score_documents(corpus(spark, d, spread=True), BACKEND)
    return scored.select("doc_id", F.explode(S.prob_map()).alias("class", "p")).withColumn("p", F.round("p", 6))


_T = "CASE WHEN {p} > 1e-9 THEN ln({p}) ELSE ln(1e-9) END / 3"
_POW = {c: f"exp({_T.format(p='p_' + c)})" for c in ("negative", "neutral", "positive")}
_SUM = " + ".join(_POW.values())


@query(
    with_(
        CORPUS,
        scored_sql("corpus"),
        "SELECT doc_id, " + ", ".join(f"round({e} / ({_SUM}), 6) AS t_{c}" for c, e in _POW.items()) + " FROM scored",
    )
)
def tempered_probabilities(spark, d):
    scored = score_documents(corpus(spark, d, spread=True), BACKEND)
    names = [f"t_{c}" for c in S.CLASSES]
    return rounded(
        scored.select("doc_id", *[p.alias(n) for p, n in zip(S.tempered(3.0), names, strict=True)]), *names
    )


_PAIRS = f"""
pairs AS (
  SELECT platform, doc_id, text AS full_text, unnest([{words_sql(ASPECTS)}]) AS aspect FROM corpus
),
windows AS (
  SELECT platform, doc_id, aspect, CASE WHEN strpos(lower(full_text), aspect) = 0 THEN full_text
    ELSE substr(full_text, greatest(strpos(lower(full_text), aspect) - 40, 1),
      strpos(lower(full_text), aspect) + length(aspect) + 40 - greatest(strpos(lower(full_text), aspect) - 40, 1)) END AS text
  FROM pairs
)"""


@query(with_(CORPUS, _PAIRS, scored_sql("windows"), f"SELECT platform, doc_id, aspect, {SCORES_OUT} FROM scored"))
def score_shared_aspects(spark, d):
    scored = score_aspects(corpus(spark, d, spread=True), ASPECTS, BACKEND)
    return rounded(scored.select("platform", "doc_id", "aspect", *K.SCORE_COLUMNS), *SCORE_DOUBLES)


_OWN = """
pairs AS (
  SELECT platform, doc_id, text AS full_text, unnest(CASE WHEN language = 'en' THEN ['the', 'and']
    WHEN language = 'fr' THEN ['la'] ELSE [] END) AS aspect FROM corpus
),"""


@query(
    with_(
        CORPUS,
        _OWN + _PAIRS[_PAIRS.index("windows AS"):],
        scored_sql("windows"),
        f"SELECT platform, doc_id, aspect, {SCORES_OUT} FROM scored",
    )
)
def score_own_aspects(spark, d):
    # English documents ask for two aspects, French for one, others for none.
    own = F.when(F.col("language") == "en", F.array(F.lit("the"), F.lit("and"))).when(
        F.col("language") == "fr", F.array(F.lit("la"))
    ).otherwise(F.array().cast("array<string>"))
    scored = score_aspects(corpus(spark, d).withColumn("aspects", own), "aspects", BACKEND)
    return rounded(scored.select("platform", "doc_id", "aspect", *K.SCORE_COLUMNS), *SCORE_DOUBLES)


def length_model():
    """A stand-in for an external model: the class is the text length modulo 3."""

    def classify(texts):
        return [[0.9 if len(t) % 3 == c else 0.05 for c in range(3)] for t in texts]

    return classify


@query(
    """
SELECT source AS platform, ['negative', 'neutral', 'positive'][(length(text) % 3)::INTEGER + 1] AS label,
  count(*) AS rows FROM documents GROUP BY 1, 2"""
)
def score_with_external_model(spark, d):
    docs = corpus(spark, d).select("platform", "doc_id", "text")
    scored = score_documents(docs, ModelBackend(length_model, batch_size=64))
    return scored.groupBy("platform", "label").agg(F.count("*").alias("rows"))


@query(
    """
SELECT doc_id, round(CASE WHEN doc_id % 2 = 0 THEN 0.2 ELSE 0.7 END, 6) AS p_negative, 0.1::DOUBLE AS p_neutral,
  round(CASE WHEN doc_id % 2 = 0 THEN 0.7 ELSE 0.2 END, 6) AS p_positive FROM documents"""
)
def reorder_probabilities(spark, d):
    docs = table(spark, d, "documents")
    even = F.col("doc_id") % 2 == 0
    raw = docs.select(
        "doc_id",
        F.array(F.lit(0.1), F.when(even, F.lit(0.7)).otherwise(F.lit(0.2)), F.when(even, F.lit(0.2)).otherwise(F.lit(0.7))).alias("raw"),
    )
    return K.reorder_probabilities(raw, "raw", ["Neutral", "LABEL_2", "neg"]).drop("raw")
