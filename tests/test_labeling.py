import pytest
from pyspark.sql import functions as F

from moodmill.operators.aggregate import label_integrity
from moodmill.operators.scoring import ModelBackend
from moodmill.plans import distill as KD
from moodmill.plans.labeling import label_aspect_pairs, label_training_set
from moodmill.schemas import ASPECT_LABELS, LABELS
from moodmill.sources.corpus import read_labels


def by_length():
    def classify(texts, aspects=None):
        sizes = [len(t) + (len(aspects[i]) if aspects else 0) for i, t in enumerate(texts)]
        return [[0.9 if n % 3 == c else 0.05 for c in range(3)] for n in sizes]

    return classify


TEACHER = ModelBackend(by_length, batch_size=4)


def write_train(spark, path, n):
    spark.range(n).select(
        F.lit("bluesky").alias("platform"),
        F.concat(F.lit("doc-"), F.lpad(F.col("id").cast("string"), 4, "0")).alias("doc_id"),
        F.repeat(F.lit("x"), (F.col("id") % 7).cast("int") + 40).alias("text"),
    ).write.mode("overwrite").parquet(path)


def run(spark, tmp_path, version="v1", backend=TEACHER, **kw):
    s = label_training_set(spark, str(tmp_path / "train"), str(tmp_path / "labels"), backend, version, **kw)
    return s["total"], s["already_labeled"], s["newly_labeled"]


def test_incremental(spark, tmp_path):
    write_train(spark, str(tmp_path / "train"), 10)
    assert run(spark, tmp_path) == (10, 0, 10)
    boom = ModelBackend(lambda: (_ for _ in ()).throw(RuntimeError("teacher called")))
    assert run(spark, tmp_path, backend=boom) == (10, 10, 0)
    write_train(spark, str(tmp_path / "train"), 15)
    assert run(spark, tmp_path) == (15, 10, 5)
    row = label_integrity(read_labels(spark, str(tmp_path / "labels"), "v1", LABELS)).first()
    assert (row["rows"], row["distinct_keys"], row["versions"]) == (15, 15, 1)
    assert row["min_sum"] == pytest.approx(1.0, abs=1e-5) and row["max_sum"] == pytest.approx(1.0, abs=1e-5)


def test_versions_are_labelled_apart(spark, tmp_path):
    write_train(spark, str(tmp_path / "train"), 6)
    run(spark, tmp_path, "team/teacher@fp32")
    assert run(spark, tmp_path, "team/teacher@fp16") == (6, 0, 6)
    assert read_labels(spark, str(tmp_path / "labels"), "team/teacher@fp32", LABELS).count() == 6


def dying():
    classify = by_length()

    def once(texts):
        if any(len(t) == 46 for t in texts):
            raise RuntimeError("killed")
        return classify(texts)

    return once


def test_kill_and_resume(spark, tmp_path):
    write_train(spark, str(tmp_path / "train"), 20)
    with pytest.raises(Exception, match="killed"):
        run(spark, tmp_path, backend=ModelBackend(dying, batch_size=4), flushes=8)
    done = read_labels(spark, str(tmp_path / "labels"), "v1", LABELS).count()
    assert 0 < done < 20
    assert run(spark, tmp_path, flushes=8) == (20, done, 20 - done)
    row = label_integrity(read_labels(spark, str(tmp_path / "labels"), "v1", LABELS)).first()
    assert (row["rows"], row["distinct_keys"]) == (20, 20)


def two_fixed(text):
    return F.array(F.lit("screen"), F.lit("battery"), F.lit("screen"))


def test_pairs_cap_and_repeat(spark, tmp_path):
    write_train(spark, str(tmp_path / "train"), 10)
    label = lambda **kw: label_aspect_pairs(
        spark, str(tmp_path / "train"), str(tmp_path / "pairs"), TEACHER, "a1", mine=two_fixed, **kw
    )
    assert label(max_pairs=12) == {"total": 12, "already_labeled": 0, "newly_labeled": 12}
    assert label(max_pairs=12) == {"total": 12, "already_labeled": 12, "newly_labeled": 0}
    assert label() == {"total": 20, "already_labeled": 12, "newly_labeled": 8}
    labels = read_labels(spark, str(tmp_path / "pairs"), "a1", ASPECT_LABELS)
    assert labels.select("platform", "doc_id", "aspect").distinct().count() == 20
    one = labels.where("doc_id = 'doc-0000' AND aspect = 'screen'").first()
    assert one["p_neutral"] == pytest.approx(0.9)


def test_doc_slice_is_cut_before_mining(spark, tmp_path):
    write_train(spark, str(tmp_path / "train"), 10)
    got = label_aspect_pairs(spark, str(tmp_path / "train"), str(tmp_path / "p"), TEACHER, "a1", mine=two_fixed, docs_cap=3)
    assert got["total"] == 6


SOFT = {"good fine": (0.05, 0.15, 0.8), "bad poor": (0.7, 0.2, 0.1), "plain table": (0.1, 0.85, 0.05)}


def test_student_recovers_soft_targets(spark):
    rows = [("p", str(i), t, *SOFT[t]) for i, t in enumerate(list(SOFT) * 40)]
    df = spark.createDataFrame(rows, "platform string, doc_id string, text string, p_negative double, p_neutral double, p_positive double")
    # Documents differ by a word of their own, so every word has some weight.
    df = df.withColumn("text", F.concat_ws(" ", "text", F.concat(F.lit("w"), (F.col("doc_id").cast("int") % 5))))
    cfg = KD.DistillConfig(num_features=1 << 10, max_iter=100, reg=0.0)
    student = KD.StudentBackend(KD.distill_student(df, cfg), cfg.temperature)
    for r in student.probabilities(df.select("platform", "doc_id", "text")).collect():
        want = SOFT[" ".join(r["text"].split()[:2])]
        assert (r["p_negative"], r["p_neutral"], r["p_positive"]) == pytest.approx(want, abs=0.02)
    assert KD.model_digest(student.model) == KD.model_digest(student.model)


def test_aspect_share():
    assert KD.aspect_budget(300, 1_000, 0.25) == 100
    assert KD.aspect_budget(300, 50, 0.25) == 50
    for bad in (0, 0.6):
        with pytest.raises(ValueError, match="aspect_fraction"):
            KD.aspect_budget(1, 1, bad)
