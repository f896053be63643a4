import math

import pytest

from moodmill.operators import gate as G
from moodmill.operators import labels as L
from moodmill.operators.sampling import holdout_pairs, holdout_rows


# A row that leans to each class, by hand; the teacher's and the student's differ in how far.
LEANS = [(0.7, 0.2, 0.1), (0.25, 0.5, 0.25), (0.05, 0.15, 0.8)]
FIRM = [(0.98, 0.01, 0.01), (0.1, 0.8, 0.1), (0.0, 0.3, 0.7)]


def aligned(spark, teacher, student):
    rows = [(*LEANS[s], *FIRM[t]) for s, t in zip(student, teacher, strict=True)]
    return spark.createDataFrame(rows, ", ".join(f"{c} double" for c in (*G.STUDENT, *G.TEACHER)))


def counted(*cells):
    """Teacher and student classes from (teacher, student, rows)."""
    return [t for t, _, n in cells for _ in range(n)], [s for _, s, n in cells for _ in range(n)]


def test_a_few_misses_in_every_class_pass(spark):
    teacher, student = counted((0, 0, 340), (0, 1, 20), (1, 1, 95), (1, 2, 15), (2, 2, 260), (2, 0, 10))
    row = G.evaluate_gate(aligned(spark, teacher, student)).first()
    assert row["passed"] and row["reasons"] == []
    assert row["agreement"] == pytest.approx(695 / 740) and row["recall_neutral"] == pytest.approx(95 / 110)


def test_one_class_mistaken_for_another_fails_on_agreement(spark):
    teacher, student = counted((0, 0, 250), (1, 1, 150), (2, 0, 100), (2, 2, 100))
    row = G.evaluate_gate(aligned(spark, teacher, student)).first()
    assert not row["passed"]
    assert row["agreement"] == pytest.approx(500 / 600) and row["reasons"][0] == "agreement 0.8333 < 0.85"


def test_rare_neutral_rows_fail_on_recall_alone(spark):
    teacher, student = counted((0, 0, 500), (1, 0, 25), (1, 1, 11), (1, 2, 4), (2, 2, 460))
    row = G.evaluate_gate(aligned(spark, teacher, student)).first()
    assert row["agreement"] == pytest.approx(0.971)
    assert row["reasons"] == ["neutral recall 0.2750 < 0.45"]


def test_too_small_and_missing_class(spark):
    row = G.evaluate_gate(aligned(spark, [0, 2] * 50, [0, 2] * 50)).first()
    assert row["reasons"] == ["held-out slice too small: 100 < 500", "held-out slice has no teacher-neutral rows"]
    assert row["recall_neutral"] is None


def test_empty_slice(spark):
    row = G.evaluate_gate(aligned(spark, [0], [0]).where("false")).first()
    assert row["agreement"] == 0.0 and not row["passed"]


def test_ties_go_to_the_lowest_class(spark):
    rows = [(0.5, 0.0, 0.5, 0.4, 0.4, 0.2)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in (*G.STUDENT, *G.TEACHER)))
    assert G.gate_metrics(df).first()["agreement"] == 1.0


def test_kd_divergence_by_hand(spark):
    t, s, temp = (0.7, 0.2, 0.1), (0.3, 0.3, 0.4), 3.0

    def soften(p):
        e = [math.exp(math.log(max(x, 1e-9)) / temp) for x in p]
        return [x / sum(e) for x in e]

    expected = temp**2 * sum(a * math.log(a / b) for a, b in zip(soften(t), soften(s), strict=True))
    df = spark.createDataFrame([(*s, *t)], ", ".join(f"{c} double" for c in (*G.STUDENT, *G.TEACHER)))
    assert G.kd_divergence(df, temp).first()[0] == pytest.approx(expected)
    zero = spark.createDataFrame([(1.0, 0.0, 0.0, 1.0, 0.0, 0.0)], df.schema)
    assert G.kd_divergence(zero, temp).first()[0] == pytest.approx(0.0)


def test_champion_and_baseline(spark):
    teacher = [i % 3 for i in range(300)]
    good = aligned(spark, teacher, teacher)
    worse = aligned(spark, teacher, [0] * 30 + teacher[30:])
    assert G.champion_gate(good, worse, 0.9).first()["passed"]
    assert not G.champion_gate(worse, good, 0.5).first()["passed"]
    assert not G.champion_gate(worse, worse, 1.0).first()["passed"]
    assert not G.champion_gate(worse, worse, 0.5, baseline_f1=0.99).first()["passed"]


def test_alignment_check(spark):
    key = "platform string, doc_id string, p_negative double, p_neutral double, p_positive double"
    a = spark.createDataFrame([("p", "1", 1.0, 0.0, 0.0), ("p", "2", 1.0, 0.0, 0.0)], key)
    L.check_aligned(a, a)
    for other in (a.where("doc_id = '1'"), a.union(a)):
        with pytest.raises(ValueError, match="aligned"):
            L.check_aligned(a, other)


def test_holdout_sizes():
    assert holdout_rows(2_500) == 500
    assert holdout_rows(100_000) == 5_000
    with pytest.raises(RuntimeError, match="need at least 2500"):
        holdout_rows(2_499)
    assert [holdout_pairs(n) for n in (0, 4, 100, 50_000)] == [0, 0, 20, 2_000]
