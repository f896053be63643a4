"""Judging a student against its teacher on held-out rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moodmill.functions.scoring import argmax_class, tempered
from moodmill.operators.aggregate import one_row
from moodmill.schemas import CLASSES, PROBS

STUDENT = tuple(f"s_{p}" for p in PROBS)
TEACHER = tuple(f"t_{p}" for p in PROBS)


@dataclass(frozen=True)
class GateConfig:
    min_agreement: float = 0.85
    min_class_recall: float = 0.45
    min_eval_rows: int = 500


DOC_GATE = GateConfig()
ASPECT_GATE = GateConfig(min_agreement=0.75, min_class_recall=0.40, min_eval_rows=300)


def _share(hits: Column, of: Column) -> Column:
    """Fraction of the rows ``of`` marks that ``hits`` marks; NULL for none."""
    return F.try_divide(F.count_if(of & hits).cast("double"), F.count_if(of))


def gate_metrics(aligned: DataFrame) -> DataFrame:
    """One row: eval_rows, agreement and recall per teacher class. Ties go to
    the lowest class. A class the teacher never chose has NULL recall."""
    picked = aligned.select(
        argmax_class(STUDENT).alias("s"), argmax_class(TEACHER).alias("t")
    )
    same = F.col("s") == F.col("t")
    return picked.agg(
        F.count("*").alias("eval_rows"),
        F.coalesce(_share(same, F.lit(True)), F.lit(0.0)).alias("agreement"),
        *[
            _share(same, F.col("t") == i).alias(f"recall_{name}")
            for i, name in enumerate(CLASSES)
        ],
    )


def evaluate_gate(aligned: DataFrame, cfg: GateConfig = DOC_GATE) -> DataFrame:
    """The metrics plus ``reasons`` for failing, in check order, and ``passed``."""
    metrics = gate_metrics(aligned)
    n, agreement = F.col("eval_rows"), F.col("agreement")
    reasons = [
        F.when(
            n < cfg.min_eval_rows,
            F.format_string(f"held-out slice too small: %d < {cfg.min_eval_rows}", n),
        ),
        F.when(
            agreement < cfg.min_agreement,
            F.format_string(f"agreement %.4f < {cfg.min_agreement}", agreement),
        ),
    ]
    for name in CLASSES:
        recall = F.col(f"recall_{name}")
        reasons.append(
            F.when(recall.isNull(), F.lit(f"held-out slice has no teacher-{name} rows")).when(
                recall < cfg.min_class_recall,
                F.format_string(f"{name} recall %.4f < {cfg.min_class_recall}", recall),
            )
        )
    judged = metrics.withColumn("reasons", F.array_compact(F.array(*reasons)))
    return judged.withColumn("passed", F.size("reasons") == 0)


def kd_divergence(aligned: DataFrame, temperature: float) -> DataFrame:
    """T^2 times the mean KL divergence of tempered student from tempered teacher."""
    teacher = tempered(temperature, TEACHER)
    student = tempered(temperature, STUDENT)
    names = [f"_t{i}" for i in range(3)] + [f"_s{i}" for i in range(3)]
    rows = aligned.select(*[c.alias(n) for c, n in zip(teacher + student, names, strict=True)])
    kl = F.lit(0.0)
    for i in range(3):
        t, s = F.col(f"_t{i}"), F.col(f"_s{i}")
        kl = kl + F.when(t > 0, t * (F.ln(t) - F.ln(s))).otherwise(F.lit(0.0))
    return rows.agg((F.avg(kl) * F.lit(float(temperature) ** 2)).alias("kd_divergence"))


def confusion(aligned: DataFrame) -> DataFrame:
    """Rows per (teacher class, student class)."""
    return aligned.groupBy(
        argmax_class(TEACHER).alias("teacher"), argmax_class(STUDENT).alias("student")
    ).agg(F.count("*").alias("rows"))


def macro_f1(aligned: DataFrame) -> DataFrame:
    """Unweighted mean F1 over the three classes; an empty class scores 0."""
    cells = confusion(aligned)

    def f1(c: int) -> Column:
        hit = F.sum(F.when((F.col("teacher") == c) & (F.col("student") == c), F.col("rows")).otherwise(0))
        named = F.sum(F.when(F.col("teacher") == c, F.col("rows")).otherwise(0))
        picked = F.sum(F.when(F.col("student") == c, F.col("rows")).otherwise(0))
        return F.coalesce(F.try_divide(2.0 * hit, named + picked), F.lit(0.0))

    return cells.agg(((f1(0) + f1(1) + f1(2)) / 3).alias("macro_f1"))


def champion_gate(candidate: DataFrame, champion: DataFrame, baseline_agreement: float,
                  champion_slack: float = 0.01, baseline_slack: float = 0.02,
                  baseline_f1: float | None = None, f1_slack: float = 0.02) -> DataFrame:
    """Candidate against the serving model, both aligned on the same held-out
    slice, and against a frozen baseline, so small losses cannot add up. With
    ``baseline_f1`` the candidate's macro F1 has a floor as well."""
    new = gate_metrics(candidate).select(F.col("agreement").alias("candidate"))
    old = gate_metrics(champion).select(F.col("agreement").alias("champion"))
    one = one_row(new, old, macro_f1(candidate))
    floor = F.greatest(F.col("champion") - champion_slack, F.lit(baseline_agreement - baseline_slack))
    enough = F.col("candidate") >= floor
    if baseline_f1 is not None:
        enough = enough & (F.col("macro_f1") >= baseline_f1 - f1_slack)
    return one.select("candidate", "champion", "macro_f1", floor.alias("floor"), enough.alias("passed"))
