"""Gate queries: a smaller lexicon as the student of a larger one."""

from __future__ import annotations

from pyspark.sql import functions as F

from moodmill.catalog.registry import query
from moodmill.catalog.tables import (
    BACKEND,
    CORPUS,
    STUDENT,
    STUDENT_LEXICON,
    corpus,
    longs,
    rounded,
    scored_sql,
    soft_labels,
    with_,
)
from moodmill.operators import gate as G
from moodmill.operators.labels import align_student_teacher

_ARGMAX = (
    "CASE WHEN {0}.p_negative >= {0}.p_neutral AND {0}.p_negative >= {0}.p_positive THEN 0 "
    "WHEN {0}.p_neutral >= {0}.p_positive THEN 1 ELSE 2 END"
)
_ALIGNED = [
    CORPUS,
    scored_sql("corpus", "teacher"),
    scored_sql("corpus", "student", lexicon=STUDENT_LEXICON),
    f"""
picked AS (
  SELECT {_ARGMAX.format("s")} AS s, {_ARGMAX.format("t")} AS t,
    s.p_negative AS s0, s.p_neutral AS s1, s.p_positive AS s2,
    t.p_negative AS t0, t.p_neutral AS t1, t.p_positive AS t2
  FROM student s JOIN teacher t USING (platform, doc_id)
)""",
    """
metrics AS (
  SELECT count(*) AS eval_rows, count(*) FILTER (s = t)::DOUBLE / count(*) AS agreement,
    count(*) FILTER (s = 0 AND t = 0)::DOUBLE / nullif(count(*) FILTER (t = 0), 0) AS recall_negative,
    count(*) FILTER (s = 1 AND t = 1)::DOUBLE / nullif(count(*) FILTER (t = 1), 0) AS recall_neutral,
    count(*) FILTER (s = 2 AND t = 2)::DOUBLE / nullif(count(*) FILTER (t = 2), 0) AS recall_positive
  FROM picked
)""",
]
_RECALLS = ("recall_negative", "recall_neutral", "recall_positive")


def _aligned(spark, d):
    docs = corpus(spark, d, spread=True)
    return align_student_teacher(soft_labels(docs, STUDENT), soft_labels(docs, BACKEND))


@query(
    with_(
        *_ALIGNED,
        "SELECT eval_rows, round(agreement, 6) AS agreement, "
        + ", ".join(f"round({r}, 6) AS {r}" for r in _RECALLS) + " FROM metrics",
    )
)
def gate_metrics(spark, d):
    return rounded(G.gate_metrics(_aligned(spark, d)), "agreement", *_RECALLS)


_STRICT = G.GateConfig(min_agreement=0.99, min_class_recall=0.9, min_eval_rows=2_000_000)


@query(
    with_(
        *_ALIGNED,
        """SELECT concat_ws('; ',
  CASE WHEN eval_rows < 2000000 THEN 'held-out slice too small: ' || eval_rows || ' < 2000000' END,
  CASE WHEN agreement < 0.99 THEN 'agreement ' || printf('%.4f', agreement) || ' < 0.99' END, """
        + ", ".join(
            f"CASE WHEN {r} IS NULL THEN 'held-out slice has no teacher-{r[7:]} rows' "
            f"WHEN {r} < 0.9 THEN '{r[7:]} recall ' || printf('%.4f', {r}) || ' < 0.9' END"
            for r in _RECALLS
        )
        + ") AS reasons, 0::BIGINT AS passed FROM metrics",
    )
)
def evaluate_gate(spark, d):
    judged = G.evaluate_gate(_aligned(spark, d), _STRICT)
    return judged.select(F.array_join("reasons", "; ").alias("reasons"), F.col("passed").cast("long").alias("passed"))


@query(with_(*_ALIGNED, "SELECT t::BIGINT AS teacher, s::BIGINT AS student, count(*) AS rows FROM picked GROUP BY 1, 2"))
def confusion(spark, d):
    return longs(G.confusion(_aligned(spark, d)), "teacher", "student")


def _f1(c: int) -> str:
    return (
        f"coalesce(2.0::DOUBLE * count(*) FILTER (s = {c} AND t = {c}) / "
        f"nullif(count(*) FILTER (s = {c}) + count(*) FILTER (t = {c}), 0), 0)"
    )


@query(with_(*_ALIGNED, f"SELECT round(({_f1(0)} + {_f1(1)} + {_f1(2)}) / 3, 6) AS macro_f1 FROM picked"))
def macro_f1(spark, d):
    return rounded(G.macro_f1(_aligned(spark, d)), "macro_f1")


@query(
    with_(
        *_ALIGNED,
        f"""scores AS (SELECT ({_f1(0)} + {_f1(1)} + {_f1(2)}) / 3 AS f1 FROM picked)""",
        """SELECT round(agreement, 6) AS candidate, 1.0::DOUBLE AS champion, round(f1, 6) AS macro_f1, 0.99::DOUBLE AS floor,
  CASE WHEN agreement >= 0.99 AND f1 >= 0.78 THEN 1 ELSE 0 END::BIGINT AS passed FROM metrics, scores""",
    )
)
def champion_gate(spark, d):
    docs = corpus(spark, d, spread=True)
    teacher = soft_labels(docs, BACKEND)
    champion = align_student_teacher(teacher, teacher)
    return longs(
        rounded(G.champion_gate(_aligned(spark, d), champion, 0.8, baseline_f1=0.8), "candidate", "champion", "macro_f1", "floor"), "passed"
    )


def _tempered(side: str) -> list[str]:
    e = [f"exp(ln(greatest({side}{i}, 1e-9)) / 3)" for i in range(3)]
    return [f"({x} / ({' + '.join(e)}))" for x in e]


_KL = " + ".join(f"{t} * (ln({t}) - ln({s}))" for t, s in zip(_tempered("t"), _tempered("s"), strict=True))


@query(with_(*_ALIGNED, f"SELECT round(9 * avg({_KL}), 6) AS kd_divergence FROM picked"))
def kd_divergence(spark, d):
    return rounded(G.kd_divergence(_aligned(spark, d), 3.0), "kd_divergence")
