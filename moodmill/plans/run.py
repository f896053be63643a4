"""One full run: training set, labels, aspect labels, student, verdict.

Every stage leaves its output in the run's folder and is skipped when that is
already there, so a run that died continues where it stopped.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass, field
from typing import Any

from pyspark.errors import PySparkException
from pyspark.ml import PipelineModel
from pyspark.sql import SparkSession

from moodmill.operators import labels as L
from moodmill.operators.gate import ASPECT_GATE, DOC_GATE, GateConfig
from moodmill.operators.sampling import MIN_LABELED_ROWS
from moodmill.operators.scoring import Backend
from moodmill.plans.distill import (
    DistillConfig,
    StudentBackend,
    aspect_budget,
    distill_aspect_student,
    distill_student,
    model_digest,
)
from moodmill.plans.evaluate import evaluate, split_docs, split_pairs
from moodmill.plans.labeling import label_aspect_pairs, label_training_set
from moodmill.plans.training import PrepConfig, build_training_set
from moodmill.schemas import ASPECT_LABELS, LABELS
from moodmill.session import checkpoint_dir
from moodmill.sinks.corpus import read_json_report, write_json_report
from moodmill.sources.corpus import read_labels


@dataclass(frozen=True)
class RunConfig:
    corpus_root: str
    out_root: str
    run_id: str
    teacher_version: str
    aspect_teacher_version: str
    # None: all rows, pairs and documents.
    max_sequences: int | None = None
    aspect_pairs: int | None = None
    mine_docs: int | None = None
    min_labeled: int = MIN_LABELED_ROWS
    flushes: int = 1
    distill: DistillConfig = field(default_factory=lambda: DistillConfig(aspect_fraction=1 / 3))
    doc_gate: GateConfig = DOC_GATE
    aspect_gate: GateConfig = ASPECT_GATE

    @property
    def run_dir(self) -> str:
        return f"{self.out_root}/runs/{self.run_id}"

    @property
    def train_path(self) -> str:
        return f"{self.run_dir}/train"

    def labels_path(self, kind: str) -> str:
        # Shared by all runs: labels outlive the training set they came from.
        return f"{self.out_root}/labels/{kind}"


def _stored_report(spark: SparkSession, path: str) -> dict[str, Any] | None:
    try:
        return read_json_report(spark, path)
    except PySparkException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _load_or_fit(path: str, fit) -> PipelineModel:
    spark = SparkSession.active()
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/metadata")
    # Only a missing model is fitted again; one that cannot be read is an error.
    if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return PipelineModel.load(path)
    model = fit()
    model.write().overwrite().save(path)
    return model


def assert_budgets(cfg: RunConfig) -> None:
    """Refuse budgets that keep nothing before anything is read."""
    for name in ("max_sequences", "aspect_pairs", "mine_docs"):
        value = getattr(cfg, name)
        if value is not None and value <= 0:
            raise ValueError(f"{name} must be positive, not {value}")
    aspect_budget(1, 1, cfg.distill.aspect_fraction)


def run_training(spark: SparkSession, cfg: RunConfig, teacher: Backend, aspect_teacher: Backend) -> dict[str, Any]:
    """Everything from corpus to verdict; returns what each stage reported."""
    assert_budgets(cfg)
    summary: dict[str, Any] = {"run_id": cfg.run_id}

    manifest = _stored_report(spark, f"{cfg.train_path}.manifest.json")
    if manifest:
        summary["prep"] = manifest["stats"]
    else:
        prep = PrepConfig(cfg.corpus_root, cfg.train_path, cfg.max_sequences)
        summary["prep"] = asdict(build_training_set(spark, prep))

    docs_path, pairs_path = cfg.labels_path("docs"), cfg.labels_path("aspects")
    summary["label"] = label_training_set(
        spark, cfg.train_path, docs_path, teacher, cfg.teacher_version, cfg.flushes
    )
    summary["label_aspects"] = label_aspect_pairs(
        spark, cfg.train_path, pairs_path, aspect_teacher, cfg.aspect_teacher_version,
        docs_cap=cfg.mine_docs, max_pairs=cfg.aspect_pairs, flushes=cfg.flushes,
    )

    train = spark.read.parquet(cfg.train_path)
    # Both are bounded by the caps above and read by every step below.
    checkpoint_dir(spark)
    docs = L.train_label_join(
        train, read_labels(spark, docs_path, cfg.teacher_version, LABELS), cfg.teacher_version
    ).checkpoint()
    pairs = L.train_aspect_join(
        train, read_labels(spark, pairs_path, cfg.aspect_teacher_version, ASPECT_LABELS),
        cfg.aspect_teacher_version,
    ).checkpoint()
    doc_train, doc_held = split_docs(docs, floor=cfg.min_labeled)
    pair_train, pair_held = split_pairs(pairs)
    n_docs = doc_train.count()

    temperature = cfg.distill.temperature
    model = _load_or_fit(f"{cfg.run_dir}/model", lambda: distill_student(doc_train, cfg.distill))
    student = StudentBackend(model, temperature)
    aspect_student = None
    if not pair_train.isEmpty():
        aspect_model = _load_or_fit(
            f"{cfg.run_dir}/aspect_model", lambda: distill_aspect_student(pair_train, n_docs, cfg.distill)
        )
        aspect_student = StudentBackend(aspect_model, temperature)
    summary["train"] = {"documents": n_docs, "model_sha256": model_digest(model)}

    report = _stored_report(spark, f"{cfg.run_dir}/eval.json")
    if not report or report["model_sha256"] != model_digest(model):
        report = evaluate(
            doc_held, student, model_digest(model),
            pair_held if aspect_student else None, aspect_student, cfg.doc_gate, cfg.aspect_gate,
        )
        write_json_report(spark, report, f"{cfg.run_dir}/eval.json")
    summary["eval"] = report
    return summary
