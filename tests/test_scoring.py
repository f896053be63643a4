import math

import pytest
from pyspark.sql import functions as F

from moodmill.functions import scoring as S
from moodmill.operators import aggregate as A
from moodmill.operators.scoring import (
    LexiconBackend,
    ModelBackend,
    reorder_probabilities,
    score_aspects,
    score_documents,
)

DOCS = "platform string, doc_id string, text string"


def docs(spark, *texts):
    return spark.createDataFrame([("p", str(i), t) for i, t in enumerate(texts)], DOCS)


def scores(spark, *texts, backend=None):
    out = score_documents(docs(spark, *texts), backend or LexiconBackend())
    return sorted(out.collect(), key=lambda r: int(r["doc_id"]))


def test_labels(spark):
    pos, neg, neu, mixed, empty = scores(
        spark, "I love this app, it is amazing", "This is the worst, terrible experience", "It is a chair",
        "great but terrible", "",
    )
    assert [r["label"] for r in (pos, neg, neu, mixed, empty)] == ["positive", "negative", "neutral", "neutral", "neutral"]
    assert neu["polarity"] == 0
    e = [math.exp(-2), math.exp(0.5 - 2), 1]
    assert pos["p_positive"] == pytest.approx(1 / sum(e))
    assert pos["confidence"] == pos["p_positive"]


def test_tokens_need_two_letters_and_keep_apostrophes(spark):
    got = docs(spark, "Good's a 'GOOD' x upbeat up").select(S.tokens("text").alias("t")).first()["t"]
    assert got == ["good's", "good'", "upbeat", "up"]
    trimmed = docs(spark, "(Good) good's.  bad!").select(S.tokens("text", trimmed=True).alias("t")).first()["t"]
    assert trimmed == ["good", "good's", "bad"]


def test_gateway_lexicon_variant(spark):
    row = scores(spark, "'great' gains", backend=LexiconBackend(S.GATEWAY_LEXICON))[0]
    assert row["label"] == "positive"


def test_aspects_flip_by_window(spark):
    far = "the screen is great" + " " * 60 + "word " * 20 + "but the battery is terrible"
    out = score_aspects(docs(spark, far), ["screen", "battery", "camera"])
    labels = {r["aspect"]: r["label"] for r in out.collect()}
    assert labels == {"screen": "positive", "battery": "negative", "camera": "neutral"}
    own = docs(spark, "great screen", "x").withColumn(
        "aspects", F.when(F.col("doc_id") == "0", F.array(F.lit("screen"))).otherwise(F.array().cast("array<string>"))
    )
    assert [r["doc_id"] for r in score_aspects(own).collect()] == ["0"]


def sizes():
    def classify(texts):
        return [[len(texts) / 1000, 0.0, 0.0]] * len(texts)

    return classify


def test_model_batches_by_length_and_halves_long_ones(spark):
    texts = ["x" * (50 + i) for i in range(8)] + ["y" * (1500 + i) for i in range(8)]
    out = ModelBackend(sizes, batch_size=8, partitions=1).probabilities(docs(spark, *texts), "text")
    by_size = {}
    for r in out.collect():
        by_size.setdefault(round(r["p_negative"] * 1000), []).append(len(r["text"]))
    assert {k: len(v) for k, v in by_size.items()} == {8: 8, 4: 8}
    assert max(by_size[8]) < 100


def test_model_must_answer_every_text(spark):
    backend = ModelBackend(lambda: lambda texts: [[1, 0, 0]] * (len(texts) - 1))
    with pytest.raises(Exception, match="predictions for"):
        backend.probabilities(docs(spark, "a", "b"), "text").collect()


def test_model_gets_aspects(spark):
    backend = ModelBackend(lambda: lambda texts, aspects: [[len(a), len(t), 0] for t, a in zip(texts, aspects, strict=True)])
    out = score_aspects(docs(spark, "abc"), ["x", "yy"], backend)
    assert {(r["aspect"], r["p_negative"], r["p_neutral"]) for r in out.collect()} == {("x", 1, 3), ("yy", 2, 3)}


def test_unknown_label_set(spark):
    df = spark.createDataFrame([([0.1, 0.2, 0.7],)], "raw array<double>")
    with pytest.raises(ValueError, match="unexpected label set"):
        reorder_probabilities(df, "raw", ["neg", "neu", "joy"])
    row = reorder_probabilities(df, "raw", ["POS", "label_0", "neutral"]).first()
    assert (row["p_negative"], row["p_neutral"], row["p_positive"]) == (0.2, 0.7, 0.1)


def scored(spark, *labels):
    polarity = {"negative": -0.5, "neutral": 0.0, "positive": 0.5}
    return spark.createDataFrame(
        [("a" if i % 2 else "b", v, polarity[v]) for i, v in enumerate(labels)],
        "platform string, label string, polarity double",
    )


def test_aggregate_ties_and_empty(spark):
    tie = A.sentiment_aggregate(scored(spark, "negative", "positive", "neutral")).first()
    assert tie["modal_label"] == "neutral"
    two = A.sentiment_aggregate(scored(spark, "negative", "positive")).first()
    assert two["modal_label"] == "positive"
    empty = A.sentiment_aggregate(scored(spark, "negative").where("false")).first()
    assert (empty["sample_size"], empty["mean_polarity"], empty["modal_label"]) == (0, 0.0, "")


def test_rollup_is_one_pass_over_platform_moments(spark):
    rows = {(r["scope"], r["platform"]): r["sample_size"] for r in A.topic_rollup(scored(spark, "negative", "positive", "neutral")).collect()}
    assert rows == {("platform", "a"): 1, ("platform", "b"): 2, ("overall", None): 3}
