"""Compaction, revocation of stored rows, stream state and metrics over small corpora."""

import json
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from moodmill.files import children, create_once, read_text
from moodmill.operators.revocation import revoke
from moodmill.plans import revocation_index as R
from moodmill.plans.compaction import compact, finished_batches, vacuum
from moodmill.schemas import CORPUS, TOMBSTONE
from moodmill.sinks.corpus import write_corpus, write_partitioned, write_tombstones
from moodmill.sinks.metrics import ProgressLog, metric_totals, observed_write, stream_progress
from moodmill.sources.corpus import read_documents, read_tombstones
from moodmill.sources.manifest import ManifestConflict, commit_manifest, read_manifest
from moodmill.streaming import firehose as J
from tests.test_stream import FILTER, NOON, POST, SCRIPT, deletion, land, post

DAYS = ["2026-05-01", "2026-05-02"]


def documents(spark, first, n, platform="alpha"):
    ids = spark.range(first, first + n)
    return ids.select(
        F.lit(platform).alias("platform"), F.concat(F.lit("d"), F.col("id")).alias("doc_id"),
        F.concat(F.lit("author "), F.col("id") % 7).alias("author_did"), F.concat(F.lit("text of "), F.col("id")).alias("text"),
        F.when(F.col("id") % 2 == 0, DAYS[0]).otherwise(DAYS[1]).cast("date").alias("dt"),
    )


def corpus(spark, root, batches=5, rows=40):
    for k in range(batches):
        write_corpus(documents(spark, k * rows, rows, f"p {k % 2}"), root, "2026-05-09", batch=f"live-{k:08d}")
    write_corpus(documents(spark, 9000, 15), root, "2026-05-09")


def held(spark, root):
    return sorted((r["platform"], r["doc_id"], r["text"], str(r["dt"])) for r in read_documents(spark, root).collect())


def files_of(root):
    return {str(p.relative_to(root)): p.read_bytes() for p in (root / "documents").rglob("part-*") if "_index" not in str(p)}


def test_compaction_keeps_rows_and_ends_the_listing(spark, tmp_path):
    root, base = str(tmp_path), f"{tmp_path}/documents"
    corpus(spark, root)
    before = held(spark, root)
    done = compact(spark, base, CORPUS)
    # The newest batch of the stream may be written again and stays.
    assert len(done.parts) == 1 and done.folded == tuple(f"batch=live-{k:08d}" for k in range(4))
    assert held(spark, root) == before
    assert compact(spark, base, CORPUS) == done
    gone = vacuum(spark, base, older_than_hours=-1)
    assert gone == sorted(done.folded) and held(spark, root) == before
    left = read_manifest(spark, base)
    assert left.folded == () and left.parts == done.parts
    assert [n for n, _ in children(spark, base) if n.startswith("batch=")] == ["batch=live-00000004"]

    # Batches that come later count at once, and are folded by the next run.
    write_corpus(documents(spark, 5000, 9), root, "2026-05-10", batch="live-00000005")
    assert len(held(spark, root)) == len(before) + 9
    again = compact(spark, base, CORPUS, max_parts=1)
    assert len(again.parts) == 1 and again.parts != done.parts and len(held(spark, root)) == len(before) + 9


def test_a_crash_before_the_switch_loses_nothing(spark, tmp_path, monkeypatch):
    root, base = str(tmp_path), f"{tmp_path}/documents"
    corpus(spark, root, batches=3)
    before = held(spark, root)

    def crash(*a, **k):
        raise RuntimeError("gone")

    with monkeypatch.context() as m:
        m.setattr("moodmill.plans.compaction.commit_manifest", crash)
        with pytest.raises(RuntimeError):
            compact(spark, base, CORPUS)
    assert held(spark, root) == before and read_manifest(spark, base).version == 0
    leftover = [n for n, _ in children(spark, base) if n.startswith("part=")]
    assert len(leftover) == 1
    done = compact(spark, base, CORPUS)
    assert held(spark, root) == before
    assert leftover[0] in vacuum(spark, base, older_than_hours=-1)
    assert held(spark, root) == before and set(done.parts).isdisjoint(leftover)


def test_an_unfinished_batch_is_left_alone(spark, tmp_path):
    root, base = str(tmp_path), f"{tmp_path}/documents"
    corpus(spark, root, batches=3)
    (tmp_path / "documents" / "batch=live-00000001" / "_SUCCESS").unlink()
    assert finished_batches(spark, base, read_manifest(spark, base)) == ["batch=live-00000000"]
    write_partitioned(documents(spark, 1, 0).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in CORPUS if f.name != "platform"), "platform", "dt"), base, "live-00000009")
    before = held(spark, root)
    compact(spark, base, CORPUS)
    assert held(spark, root) == before


def test_two_jobs_cannot_both_switch(spark, tmp_path):
    base = f"{tmp_path}/documents"
    was = read_manifest(spark, base)
    assert commit_manifest(spark, base, was, folded=["batch=a"]).version == 1
    with pytest.raises(ManifestConflict):
        commit_manifest(spark, base, was, folded=["batch=b"])
    assert read_manifest(spark, base).folded == ("batch=a",)
    assert create_once(spark, f"{base}/once.txt", "é") and not create_once(spark, f"{base}/once.txt", "other")
    assert read_text(spark, f"{base}/once.txt") == "é"


def test_bloom_never_misses_and_rarely_errs():
    rng = np.random.default_rng(4)
    keys = rng.integers(-(2**63), 2**63 - 1, 30_000)
    held_keys, others = keys[:20_000], keys[20_000:]
    made = R.bloom(held_keys)
    assert len(made) == -(-20_000 * R.BITS_PER_KEY // 64) * 8
    assert all(R.may_hold(made, held_keys[k : k + 1]) for k in range(0, 20_000, 97))
    assert sum(R.may_hold(made, others[k : k + 1]) for k in range(2000)) < 30
    assert not R.may_hold(b"", held_keys) and not R.may_hold(made, held_keys[:0])


def test_revocation_rewrites_only_files_that_hold_a_row(spark, tmp_path):
    root = str(tmp_path)
    corpus(spark, root)
    tombs = spark.createDataFrame(
        [("p 0", "doc", "d3", None), ("p 1", "doc", "d3", None), ("alpha", "account", None, "author 4"), ("p 0", "doc", None, None)],
        "platform string, scope string, doc_id string, author_did string",
    )
    write_tombstones(tombs, root, "2026-05-20")
    expected = sorted((r["platform"], r["doc_id"]) for r in revoke(read_documents(spark, root), read_tombstones(spark, root)).collect())
    before = files_of(tmp_path)
    counts = R.apply_tombstones(spark, root)
    assert sorted(r[:2] for r in held(spark, root)) == expected
    assert counts["revoked"] == 215 - len(expected)
    gone = read_manifest(spark, f"{root}/documents").removed
    assert len(gone) == counts["rewritten"] < counts["files"]
    assert {k: v for k, v in files_of(tmp_path).items() if k in before} == before
    # Nothing left to do; new files are indexed and found.
    assert R.apply_tombstones(spark, root)["revoked"] == 0
    write_corpus(documents(spark, 3, 1, "p 0"), root, "2026-05-21", batch="late-00000000")
    assert R.apply_tombstones(spark, root)["revoked"] == 1
    assert sorted(r[:2] for r in held(spark, root)) == expected
    assert set(vacuum(spark, f"{root}/documents", older_than_hours=-1)) >= set(gone)
    assert sorted(r[:2] for r in held(spark, root)) == expected
    compact(spark, f"{root}/documents", CORPUS)
    assert sorted(r[:2] for r in held(spark, root)) == expected


def run_stream(spark, tmp_path, **options):
    source = J.firehose_source(spark, str(tmp_path / "landing"))
    run = J.start_corpus_stream(
        source, str(tmp_path / "corpus"), str(tmp_path / "ckpt"), FILTER, name="t", available_now=True, **options
    )
    run.awaitTermination()
    return run.lastProgress


def test_state_is_bounded_and_the_corpus_is_not_read_back(spark, tmp_path, monkeypatch):
    def never(*a, **k):
        raise AssertionError("the corpus was read back")

    monkeypatch.setattr(J, "unseen", never)
    sizes = []
    for k in range(4):
        rows = [post(f"did:x:{k}-{j}", NOON - (k * 3600 + j) * 10**6, f"k{k}-{j}", POST + f" {k} {j}", ["en"]) for j in range(6)]
        land(tmp_path, f"{k}.jsonl", [*rows, *rows, deletion(f"did:x:{k}-0", NOON, f"k{k}-0")])
        progress = run_stream(spark, tmp_path, replay_window="1 second")
        sizes.append(progress["stateOperators"][0]["numRowsTotal"])
        time.sleep(1.2)
    assert len(read_documents(spark, str(tmp_path / "corpus")).collect()) == 24
    assert read_tombstones(spark, str(tmp_path / "corpus")).count() == 4
    assert max(sizes) <= 14 and J.stream_counts(spark, str(tmp_path / "corpus"))["documents"] == 24


def test_metrics_come_with_the_rows(spark, tmp_path):
    out = str(tmp_path / "rows")
    got = observed_write(spark.range(1000).repartition(3), lambda d: d.write.parquet(out), F.count("*").alias("rows"), F.max("id").alias("top"))
    assert got == {"rows": 1000, "top": 999}
    got = observed_write(spark.range(10).where("id > 99"), lambda d: d.write.mode("overwrite").parquet(out), F.count("*").alias("rows"))
    assert got == {"rows": 0}

    log = ProgressLog(spark, str(tmp_path / "progress"))
    spark.streams.addListener(log)
    try:
        land(tmp_path, "a.jsonl", [*SCRIPT, SCRIPT[0], "{broken", json.dumps(7)])
        run_stream(spark, tmp_path)
        land(tmp_path, "b.jsonl", [post("did:x:zoe", NOON + 10**9, "k8", POST + " then", ["en"])])
        run_stream(spark, tmp_path)
        for _ in range(100):
            totals = {r["metric"]: r["total"] for r in metric_totals(stream_progress(spark, str(tmp_path / "progress"))).collect()} if (tmp_path / "progress").exists() else {}
            if totals.get("routed.documents") == 4:
                break
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(log)
    assert totals == {"routed.documents": 4, "routed.tombstones": 2, "routed.skipped": 2}
    rows = stream_progress(spark, str(tmp_path / "progress")).where("input_rows > 0").collect()
    assert sorted(r["input_rows"] for r in rows) == [1, len(SCRIPT) + 3] and all(r["late_rows"] == 0 for r in rows)


def test_tombstones_schema_is_kept(spark, tmp_path):
    assert read_tombstones(spark, str(tmp_path)).schema == TOMBSTONE
