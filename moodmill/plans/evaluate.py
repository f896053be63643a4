"""Gating a student on the held-out tail its training never saw."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame

from moodmill.operators import labels as L
from moodmill.operators.gate import ASPECT_GATE, DOC_GATE, GateConfig, evaluate_gate
from moodmill.operators.sampling import holdout_pairs, holdout_rows, split_tail
from moodmill.operators.scoring import Backend, score_documents
from moodmill.schemas import CLASSES

# Texts whose scores are shown in the report.
SAMPLE_TEXTS = (
    "Lovely bread and friendly people behind the counter, a wonderful morning.",
    "Rude reply, awful coffee, and they still charged for the refill.",
    "The library opens at nine and closes at six.",
    "A beautiful room, though the heating is terrible.",
)


def split_docs(joined: DataFrame, floor: int | None = None, ceiling: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(train, held out) documents; training and evaluation both call this."""
    n = joined.count()
    bounds = {k: v for k, v in (("floor", floor), ("ceiling", ceiling)) if v is not None}
    return split_tail(joined, holdout_rows(n, **bounds), L.DOC_KEY, total=n)


def split_pairs(joined: DataFrame, ceiling: int | None = None) -> tuple[DataFrame, DataFrame]:
    n = joined.count()
    held = holdout_pairs(n) if ceiling is None else holdout_pairs(n, ceiling)
    return split_tail(joined, held, L.PAIR_KEY, total=n)


def gate_student(heldout: DataFrame, backend: Backend, cfg: GateConfig, aspect: bool = False) -> dict[str, Any]:
    """Score the held-out rows with the student and judge it."""
    key = L.PAIR_KEY if aspect else L.DOC_KEY
    bare = heldout.select(*key, "text")
    student = backend.probabilities(bare, "text", "aspect" if aspect else None)
    L.check_aligned(student, heldout, key)
    row = evaluate_gate(L.align_student_teacher(student, heldout, key), cfg).first()
    return {
        "passed": row["passed"],
        "reasons": list(row["reasons"]),
        "eval_rows": row["eval_rows"],
        "agreement": row["agreement"],
        "class_recall": {c: row[f"recall_{c}"] for c in CLASSES},
    }


def sample_predictions(backend: Backend, like: DataFrame) -> list[dict[str, Any]]:
    spark = like.sparkSession
    texts = spark.createDataFrame(
        [("sample", str(i), t) for i, t in enumerate(SAMPLE_TEXTS)], "platform string, doc_id string, text string"
    )
    rows = score_documents(texts, backend).select("doc_id", "text", "label", "confidence").collect()
    return [
        {"text": r["text"], "label": r["label"], "confidence": round(r["confidence"], 3)}
        for r in sorted(rows, key=lambda r: int(r["doc_id"]))
    ]


def evaluate(heldout: DataFrame, backend: Backend, digest: str, heldout_pairs: DataFrame | None = None,
             aspect_backend: Backend | None = None, doc_cfg: GateConfig = DOC_GATE,
             aspect_cfg: GateConfig = ASPECT_GATE) -> dict[str, Any]:
    """The run report: document gate, aspect gate (None without pairs), four
    sample predictions and the digest of the very model judged."""
    report = gate_student(heldout, backend, doc_cfg)
    report["samples"] = sample_predictions(backend, heldout)
    report["aspect"] = (
        gate_student(heldout_pairs, aspect_backend, aspect_cfg, aspect=True)
        if heldout_pairs is not None and aspect_backend is not None
        else None
    )
    report["model_sha256"] = digest
    return report
