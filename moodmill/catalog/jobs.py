"""Whole-job queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from moodmill.catalog.exports import _TOPIC, scratch, topic_analysis
from moodmill.catalog.registry import query
from moodmill.catalog.scoring import _PAIRS
from moodmill.catalog.tables import (
    ALIVE,
    BACKEND,
    CORPUS,
    NOW,
    STUDENT,
    TEACHER,
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
from moodmill.catalog.text import _RANKED
from moodmill.operators import labels as L
from moodmill.operators.gate import GateConfig, evaluate_gate
from moodmill.plans import distill as KD
from moodmill.plans.evaluate import split_docs
from moodmill.plans.labeling import label_aspect_pairs as label_pairs
from moodmill.plans.labeling import label_training_set as label_docs
from moodmill.plans.run import RunConfig, run_training
from moodmill.plans.topic import analyze_text as analyze
from moodmill.plans.training import PrepConfig
from moodmill.plans.training import build_training_set as build
from moodmill.plans.training import training_set as training
from moodmill.schemas import ASPECT_LABELS, LABELS, PROBS
from moodmill.sinks.corpus import write_partitioned
from moodmill.sources.corpus import read_labels

_INLINE = "inline AS (SELECT role, text FROM conversations)"


@query(with_(_INLINE, scored_sql("inline"), f"SELECT {aggregate_sql()} FROM scored"))
def analyze_text(spark, d):
    docs = table(spark, d, "conversations").select(
        F.concat_ws("-", "conv_id", "turn").alias("id"), "text", F.col("turn").alias("index")
    )
    return rounded(analyze(docs, backend=BACKEND, now=NOW).aggregate, "mean_polarity")


@query(with_(*_TOPIC, f"SELECT {aggregate_sql('platform,')} FROM scored GROUP BY platform"))
def analyze_topic(spark, d):
    return rounded(topic_analysis(spark, d).by_platform, "mean_polarity")


@query(
    with_(
        *_TOPIC[:3],
        _PAIRS.replace("FROM corpus", "FROM found").replace("'the', 'la', 'battery'", "'la', 'the'"),
        scored_sql("windows"),
        f"SELECT {aggregate_sql('aspect,')} FROM scored GROUP BY aspect",
    )
)
def analyze_topic_aspects(spark, d):
    return rounded(topic_analysis(spark, d).by_aspect, "mean_polarity")


_IDS = "SELECT platform, doc_id, content_sha256 FROM deduped"
_CAP = "ORDER BY md5(platform || '|' || doc_id), platform, doc_id LIMIT 200"


@query(with_(CORPUS, TOMBSTONES, ALIVE, _IDS))
def training_set(spark, d):
    return training(corpus(spark, d, spread=True), tombstones(spark, d)).select("platform", "doc_id", "content_sha256")


@query(with_(CORPUS, TOMBSTONES, ALIVE, f"{_IDS} {_CAP}"))
def training_set_capped(spark, d):
    return training(corpus(spark, d, spread=True), tombstones(spark, d), 200).select("platform", "doc_id", "content_sha256")


def _stored_corpus(spark, d, name: str) -> str:
    root = scratch(spark, name)
    rows = corpus(spark, d).withColumn("dt", F.lit("2024-03-01").cast("date")).drop("language", "url", "posted_at")
    # The folder is the platform, as a harvester writes it.
    write_partitioned(rows, f"{root}/documents")
    write_partitioned(tombstones(spark, d).withColumn("dt", F.lit("2024-03-01").cast("date")), f"{root}/tombstones")
    return root


@query(
    with_(
        CORPUS, TOMBSTONES, ALIVE,
        "SELECT platform, count(*) AS rows, min(doc_id) AS first_id, max(doc_id) AS last_id FROM deduped GROUP BY platform",
    )
)
def build_training_set(spark, d):
    root = _stored_corpus(spark, d, "training-set")
    build(spark, PrepConfig(root, f"{root}/train"))
    return spark.read.parquet(f"{root}/train").groupBy("platform").agg(
        F.count("*").alias("rows"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id")
    )


def _stored_train(spark, d, root: str) -> str:
    docs = corpus(spark, d, spread=True).select("platform", "doc_id", "text")
    docs.write.parquet(f"{root}/train")
    return f"{root}/train"


_P = ", ".join(f"round({p}::FLOAT::DOUBLE, 5) AS {p}" for p in PROBS)


def _floats(df):
    return df.withColumns({p: F.round(F.col(p).cast("double"), 5) for p in PROBS})


@query(with_(CORPUS, scored_sql("corpus"), f"SELECT platform, doc_id, {_P} FROM scored"))
def label_training_set(spark, d):
    # French rows were labelled before; the run adds only the others.
    root = scratch(spark, "labels")
    train = _stored_train(spark, d, root)
    first = corpus(spark, d).where("language = 'fr'").select("platform", "doc_id", "text")
    first.write.parquet(f"{root}/first")
    label_docs(spark, f"{root}/first", f"{root}/labels", BACKEND, TEACHER)
    label_docs(spark, train, f"{root}/labels", BACKEND, TEACHER, flushes=2)
    labels = read_labels(spark, f"{root}/labels", TEACHER, LABELS)
    return _floats(labels.select("platform", "doc_id", *PROBS))


_MINED = """
mined AS (
  SELECT source AS platform, 'd-' || r.doc_id AS doc_id, text AS full_text, aspect
  FROM ranked r JOIN documents USING (doc_id) WHERE rank < 2
)"""
_WINDOWS = _PAIRS[_PAIRS.index("windows AS"):].replace("FROM pairs", "FROM mined")


@query(
    with_(
        _RANKED, _MINED, _WINDOWS, scored_sql("windows"),
        f"SELECT platform, doc_id, aspect, {_P} FROM scored",
    )
)
def label_aspect_pairs(spark, d):
    root = scratch(spark, "aspect-labels")
    label_pairs(spark, _stored_train(spark, d, root), f"{root}/labels", BACKEND, TEACHER)
    labels = read_labels(spark, f"{root}/labels", TEACHER, ASPECT_LABELS)
    return _floats(labels.select("platform", "doc_id", "aspect", *PROBS))


_DISTILL = KD.DistillConfig(num_features=1 << 14, max_iter=20)
_GATE = GateConfig(min_agreement=0.5, min_class_recall=0.1, min_eval_rows=10)


@query()
def distill_student(spark, d):
    """Gate of a student trained on the head of the labelled documents and
    judged on their tail. Iterative, so there is no SQL for it."""
    docs = corpus(spark, d, spread=True)
    joined = L.train_label_join(docs, soft_labels(docs, BACKEND), TEACHER)
    train, held = split_docs(joined, floor=100)
    student = KD.StudentBackend(KD.distill_student(train, _DISTILL), _DISTILL.temperature)
    scored = student.probabilities(held.select("platform", "doc_id", "text"))
    return evaluate_gate(L.align_student_teacher(scored, held), _GATE).withColumn(
        "reasons", F.array_join("reasons", "; ")
    )


@query()
def run_full_training(spark, d):
    """Corpus files to verdict: every stage, twice, the second time from what
    the first left behind."""
    root = _stored_corpus(spark, d, "full-run")
    cfg = RunConfig(
        corpus_root=root, out_root=f"{root}/out", run_id="check", teacher_version=TEACHER,
        aspect_teacher_version="aspects@v1", min_labeled=50,
        distill=_DISTILL, doc_gate=_GATE, aspect_gate=_GATE,
    )
    run_training(spark, cfg, BACKEND, STUDENT)
    summary = run_training(spark, cfg, BACKEND, STUDENT)
    stages = [
        ("prep kept", float(summary["prep"]["kept"])),
        ("label total", float(summary["label"]["total"])),
        ("label again", float(summary["label"]["newly_labeled"])),
        ("aspect pairs", float(summary["label_aspects"]["total"])),
        ("aspect pairs again", float(summary["label_aspects"]["newly_labeled"])),
        ("agreement", float(summary["eval"]["agreement"])),
    ]
    return spark.createDataFrame(stages, "stage string, value double")
