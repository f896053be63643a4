"""Queries of the stored corpus: compaction, revocation by file, backfill of months, metrics of a stream."""

from __future__ import annotations

import datetime as dt
import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moodmill.catalog.exports import scratch
from moodmill.catalog.registry import query
from moodmill.catalog.sampling import _UNIT
from moodmill.catalog.sources import _ARCHIVE, _ARCHIVE_TEXT, archive
from moodmill.catalog.streams import _EVENTS, FILTER, stream_events
from moodmill.catalog.tables import ALIVE, BACKEND, CORPUS, TOMBSTONES, corpus, scored_sql, tombstones, with_
from moodmill.files import exists
from moodmill.operators import sampling as Z
from moodmill.operators.scoring import score_documents
from moodmill.plans.backfill import backfill_month, done_months, month_counts
from moodmill.plans.backfill import ingest_months as ingest
from moodmill.plans.compaction import compact, vacuum
from moodmill.plans.revocation_index import apply_tombstones
from moodmill.schemas import CORPUS as CORPUS_SCHEMA
from moodmill.session import local_table
from moodmill.sinks.corpus import write_partitioned
from moodmill.sinks.metrics import ProgressLog, metric_totals, stream_progress
from moodmill.sources.corpus import read_documents, read_tombstones
from moodmill.streaming import firehose as J

BATCHES = 4


def _batched_corpus(spark, d, name: str) -> str:
    """The documents as a stream leaves them: a few batches, days by document number."""
    root = scratch(spark, name)
    number = F.substring("doc_id", 3, 20).cast("long")
    rows = corpus(spark, d).withColumn("dt", F.date_add(F.lit("2024-03-01").cast("date"), (number % 3).cast("int")))
    rows = rows.drop("language", "url", "posted_at")
    for k in range(BATCHES):
        write_partitioned(rows.where(number % BATCHES == k), f"{root}/documents", f"live-{k:08d}")
    return root


def _stored_rows(docs: DataFrame) -> DataFrame:
    return docs.select("platform", "doc_id", F.length("text").cast("long").alias("chars"), F.col("dt").cast("string").alias("dt"))


_STORED = "platform, doc_id, length(text) AS chars, strftime(DATE '2024-03-01' + (n % 3)::INTEGER, '%Y-%m-%d') AS dt"


@query(with_(CORPUS, f"SELECT {_STORED} FROM corpus"))
def compacted_corpus(spark, d):
    root = _batched_corpus(spark, d, "compacted")
    done = compact(spark, f"{root}/documents", CORPUS_SCHEMA)
    if len(done.folded) != BATCHES - 1 or vacuum(spark, f"{root}/documents", older_than_hours=-1) != sorted(done.folded):
        raise RuntimeError(f"unexpected state after compaction: {done}")
    return _stored_rows(read_documents(spark, root))


@query(with_(CORPUS, TOMBSTONES, ALIVE, f"SELECT {_STORED} FROM alive"))
def purged_corpus(spark, d):
    # Some batches are folded before the revocations, and all of them after.
    root = _batched_corpus(spark, d, "purged")
    compact(spark, f"{root}/documents", CORPUS_SCHEMA)
    write_partitioned(tombstones(spark, d).withColumn("dt", F.lit("2024-03-09").cast("date")), f"{root}/tombstones")
    apply_tombstones(spark, root, read_tombstones(spark, root))
    compact(spark, f"{root}/documents", CORPUS_SCHEMA, max_parts=1, keep_newest=False)
    return _stored_rows(read_documents(spark, root))


@query(
    with_(
        _ARCHIVE,
        _ARCHIVE_TEXT,
        """SELECT strftime(ts, '%Y-%m') AS month, count(*) AS rows, 'stored' AS state FROM texts
WHERE length(text) BETWEEN 40 AND 2000 AND ts < TIMESTAMP '2024-03-01' GROUP BY 1
UNION ALL SELECT '2023-12', 0, 'failed: PATH_NOT_FOUND'""",
    )
)
def backfill_months(spark, d):
    # December's file is missing, February was tried with five rows before.
    root = scratch(spark, "backfill")
    rows = archive(spark, d)

    def month(name: str) -> DataFrame:
        if name == "2023-12":
            return spark.read.parquet(f"{root}/missing")
        return rows.where(F.date_format(F.col("time").cast("timestamp"), "yyyy-MM") == name)

    backfill_month(month("2024-02"), root, "2024-02", limit=5)
    log: list[str] = []
    ingest(spark, root, "2023-12", "2024-02", month, today=dt.date(2024, 7, 15), log=log.append)
    if done_months(spark, root).where("NOT is_partial").count() != 2:
        raise RuntimeError(f"unexpected months: {log}")
    failed = [(line[:7], 0, line[9:]) for line in log if ": failed" in line]
    stored = month_counts(read_documents(spark, root)).withColumn("state", F.lit("stored"))
    return stored.unionByName(local_table(spark, failed, "month string, rows long, state string"))


@query(
    with_(
        CORPUS,
        scored_sql("corpus"),
        f"""SELECT label, doc_id FROM (
  SELECT *, row_number() OVER (PARTITION BY label ORDER BY {_UNIT}, platform, doc_id) AS nth FROM scored)
ORDER BY nth, md5('{{"no":false,"of":"' || label || '"}}') LIMIT 201""",
    )
)
def stratified_reservoir_full(spark, d):
    scored = score_documents(corpus(spark, d, spread=True), BACKEND)
    return Z.stratified_reservoir(scored, 201, "label", fill=True).select("label", "doc_id")


@query(
    with_(
        _EVENTS,
        """SELECT 'routed.documents' AS metric, count(*) FILTER (route = 'document') AS total FROM routed
UNION ALL SELECT 'routed.tombstones', count(*) FILTER (route LIKE '%tombstone') FROM routed
UNION ALL SELECT 'routed.skipped', count(*) FILTER (route = 'skipped') FROM routed""",
    )
)
def stream_metrics(spark, d):
    # What a harvest counts of itself while it runs, from the rows its listener kept.
    root = scratch(spark, "stream-metrics")
    log = ProgressLog(spark, f"{root}/progress")
    spark.streams.addListener(log)
    try:
        run = J.start_corpus_stream(
            stream_events(spark, d), f"{root}/corpus", f"{root}/checkpoint", FILTER, name="stream_metrics", available_now=True
        )
        run.awaitTermination()
        last = run.lastProgress
        # Listeners hear of a batch a moment after it ends.
        for _ in range(300):
            if exists(spark, f"{root}/progress/{last['id']}-{last['batchId']:010d}.json"):
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(log)
    return metric_totals(stream_progress(spark, f"{root}/progress").where("name = 'stream_metrics'")).select("metric", "total")
