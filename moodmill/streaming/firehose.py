"""The post firehose as one streaming query: events -> corpus rows and tombstones."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from moodmill.files import create_once, exists, read_text
from moodmill.functions.hashing import HASH_VERSION, content_sha256, in_sample
from moodmill.functions.text import strip_space
from moodmill.functions.times import rfc3339
from moodmill.operators.filters import allows_langs, within_bytes
from moodmill.operators.scoring import DEFAULT_BACKEND, Backend, score_documents
from moodmill.operators.trend import daily_moments
from moodmill.schemas import CORPUS, EVENT, TOMBSTONE
from moodmill.session import local_table, session_defaults
from moodmill.sinks.corpus import write_partitioned
from moodmill.sinks.metrics import observed_write
from moodmill.sources.corpus import read_partitioned

POST_COLLECTION = "app.bsky.feed.post"
PLATFORM = "bluesky"
# What makes an event itself: a reconnect sends it again with all of these equal.
EVENT_KEY = ("route", "platform", "author_did", "doc_id", "operation", "time_us")
# How long after its arrival an event is known again.
REPLAY_WINDOW = "3 days"
# State lies on the executors' disks, with so much native memory an executor for all stores there. A heap would have
# to hold every event of the window.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
}
COUNTS = "documents long, tombstones long, skipped long, newest_us long"
ROUTES = {"documents": ("document",), "tombstones": ("doc_tombstone", "account_tombstone"), "skipped": ("skipped",)}


@dataclass(frozen=True)
class FirehoseFilter:
    """Which new posts enter the corpus. Revocations are never filtered."""

    langs: Sequence[str] = ()
    min_bytes: int = 0
    max_bytes: int = 0
    sample_rate: float = 1.0

    def admits(self, doc_id: Column, text: Column, langs: Column) -> Column:
        return (
            within_bytes(text, self.min_bytes, self.max_bytes)
            & allows_langs(langs, self.langs)
            & in_sample(doc_id, self.sample_rate)
        )


def firehose_source(spark: SparkSession, landing: str, files_per_trigger: int = 1000) -> DataFrame:
    """Events of landed JSON-line files. A malformed line is dropped; the
    stream goes on."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(landing)
    return parse_events(lines, "value")


def parse_events(lines: DataFrame, payload: str = "payload") -> DataFrame:
    parsed = lines.select(F.from_json(payload, EVENT, {"mode": "PERMISSIVE"}).alias("e"))
    # A malformed line parses to NULL, or to a struct of NULLs.
    return parsed.where(F.col("e.kind").isNotNull()).select("e.*")


def firehose_doc_id(did: str = "did", collection: str = "commit.collection", rkey: str = "commit.rkey") -> Column:
    return F.concat_ws("/", did, collection, rkey)


def event_time(time_us: str = "time_us") -> Column:
    return F.timestamp_micros(time_us)


def route_events(events: DataFrame, admit: FirehoseFilter = FirehoseFilter(), platform: str = PLATFORM) -> DataFrame:
    """One row per event with its ``route``: document, doc_tombstone,
    account_tombstone, skipped (a post the filter refuses) or ignored."""
    events = events.withColumn("_text", strip_space("commit.record.text"))
    operation, text = F.col("commit.operation"), F.col("_text")
    is_post = (F.col("kind") == "commit") & (F.col("commit.collection") == POST_COLLECTION)
    is_new = is_post & operation.isin("create", "update") & F.col("commit.record").isNotNull()
    doc_id = firehose_doc_id()
    keep = (F.coalesce(text, F.lit("")) != "") & admit.admits(doc_id, text, F.col("commit.record.langs"))
    # An account event that does not say "active" counts as a deactivation.
    gone = (
        (F.col("kind") == "account")
        & F.col("account").isNotNull()
        & ~F.coalesce("account.active", F.lit(False))
    )
    route = (
        F.when(gone, F.lit("account_tombstone"))
        .when(is_post & (operation == "delete"), F.lit("doc_tombstone"))
        .when(is_new & keep, F.lit("document"))
        .when(is_new, F.lit("skipped"))
        .otherwise(F.lit("ignored"))
    )
    moment = event_time()
    return events.select(
        route.alias("route"),
        F.lit(platform).alias("platform"),
        F.when(is_post, doc_id).alias("doc_id"),
        F.col("did").alias("author_did"),
        F.when(is_new, text).alias("text"),
        F.when(is_new, F.col("commit.record.langs")).alias("langs"),
        F.when(is_new, F.col("commit.record.createdAt")).alias("created_at"),
        operation.alias("operation"),
        "time_us",
        moment.alias("event_time"),
        F.to_date(moment).alias("dt"),
    )


def admitted_documents(routed: DataFrame) -> DataFrame:
    """Corpus rows of the document branch. Harvest time and day are the event's
    own, so replaying a batch writes the same rows to the same folders."""
    return routed.where(F.col("route") == "document").select(
        "platform", "doc_id", "author_did", F.lit(None).cast("string").alias("author"), "text", "langs",
        "created_at", rfc3339("event_time").alias("harvested_at"),
        content_sha256("text").alias("content_sha256"), F.lit(HASH_VERSION).alias("hash_version"), "dt",
    ).select(*CORPUS.fieldNames(), "dt")


def tombstones(routed: DataFrame) -> DataFrame:
    is_doc = F.col("route") == "doc_tombstone"
    return routed.where(F.col("route").isin("doc_tombstone", "account_tombstone")).select(
        "platform",
        F.when(is_doc, F.lit("doc")).otherwise(F.lit("account")).alias("scope"),
        F.when(is_doc, F.col("doc_id")).alias("doc_id"),
        "author_did",
        rfc3339("event_time").alias("deleted_at"),
        "dt",
    ).select(*TOMBSTONE.fieldNames(), "dt")


def without_refused_text(routed: DataFrame) -> DataFrame:
    """The same rows, with what only corpus rows need left to ``document`` rows: no
    later step reads the text of a post that the filter refused."""
    return routed.withColumns(
        {c: F.when(F.col("route") == "document", F.col(c)) for c in ("text", "langs", "created_at")}
    )


def drop_replayed(routed: DataFrame, window: str = REPLAY_WINDOW) -> DataFrame:
    """One of each event that arrives within the window, whatever its own time.

    The watermark is on the time of arrival, which only grows: no event is ever
    late, and the state of a key ends that long after it first arrived, so state is
    as large as the window's traffic and never grows with the corpus. Start the
    stream under ``STATE``, or executors hold it in their heaps. A deletion is
    another event than the post it deletes, and always passes.
    """
    arrived = routed.withColumn("_arrived", F.current_timestamp()).withWatermark("_arrived", window)
    return arrived.dropDuplicatesWithinWatermark(list(EVENT_KEY)).drop("_arrived")


def unseen(rows: DataFrame, base: str, label: str, key: Sequence[str]) -> DataFrame:
    """Rows that no other stored batch holds. Only the days of ``rows`` are read back."""
    days = [r["dt"] for r in rows.select("dt").distinct().collect()]
    schema = T.StructType([f for f in rows.schema if f.name != "dt"])
    stored = read_partitioned(rows.sparkSession, base, schema, with_file=True) if days else None
    if stored is None:
        return rows
    stored = stored.where(F.col("dt").isin(days) & ~F.col("file").startswith(f"batch={label}/"))
    known = stored.select(*(F.coalesce(c, F.lit("")).alias(c) for c in key)).distinct()
    same = [F.coalesce(rows[c], F.lit("")) == known[c] for c in key]
    return rows.join(known, same, "left_anti")


def resume_mark(spark: SparkSession, root: str, checkpoint: str) -> int:
    """Event time (microseconds) up to which earlier streams may have stored an event that arrives again.

    Found once for a checkpoint, from the counts kept per batch, and kept beside
    it; -1 for the first stream of a corpus. State knows what this checkpoint's
    stream has seen; only events up to the mark are looked up in the corpus.
    """
    kept = f"{checkpoint.rstrip('/')}/corpus_mark.json"
    if not exists(spark, kept):
        newest = None
        if exists(spark, f"{root}/stream_counts"):
            newest = spark.read.schema(COUNTS).json(f"{root}/stream_counts").agg(F.max("newest_us")).first()[0]
        create_once(spark, kept, json.dumps({"newest_us": -1 if newest is None else newest}))
    return json.loads(read_text(spark, kept))["newest_us"]


def route_counts(routed: DataFrame) -> DataFrame:
    return routed.groupBy("route").agg(F.count("*").alias("rows"))


def route_metrics() -> list[Column]:
    """Events of each route, as metrics of a running query (``observedMetrics`` of its progress)."""
    return [F.count_if(F.col("route").isin(*names)).alias(k) for k, names in ROUTES.items()]


def stream_counts(spark: SparkSession, root: str) -> dict[str, int]:
    """Documents, tombstones and skipped posts of all batches of a corpus: one
    stored row per batch, so a long run is counted in full."""
    counts = spark.read.schema(COUNTS).json(f"{root}/stream_counts")
    row = counts.agg(*(F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in ROUTES)).first()
    return row.asDict()


def start_corpus_stream(events: DataFrame, root: str, checkpoint: str, admit: FirehoseFilter = FirehoseFilter(),
                        name: str = "firehose", available_now: bool = False, interval: str = "30 seconds",
                        drop_replays: bool = True, replay_window: str = REPLAY_WINDOW) -> StreamingQuery:
    """Write routed events to the corpus, however late they come.

    The checkpoint is the resume position. A micro-batch is a folder named after
    the query's own id, which the checkpoint keeps: a replayed batch replaces
    itself, and a stream with a new checkpoint never touches an older one's rows.
    No event is dropped for its time. Copies of an event are dropped by keyed state
    for ``replay_window`` after its arrival; the corpus is read back only for
    events that a stream with another checkpoint may have stored. Any that two
    streams write at once are removed when the training set is built.
    """
    spark = events.sparkSession
    routed = route_events(events, admit).where(F.col("route") != "ignored").observe("routed", *route_metrics())
    # Before rows move to the state of their key and are kept for the batch.
    routed = without_refused_text(routed)
    mark = -1
    if drop_replays:
        mark = resume_mark(spark, root, checkpoint)
        routed = drop_replayed(routed, replay_window)

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        run = spark.sparkContext.getLocalProperty("sql.streaming.queryId") or "manual"
        label = f"{name}-{run}-{batch_id:08d}"
        batch = batch.persist()
        try:
            gone, docs = tombstones(batch), admitted_documents(batch)
            if mark >= 0 and not batch.where(F.col("time_us") <= mark).isEmpty():
                gone = unseen(gone, f"{root}/tombstones", label, ("platform", "scope", "doc_id", "author_did", "deleted_at"))
                docs = unseen(docs, f"{root}/documents", label, ("platform", "doc_id", "content_sha256", "harvested_at"))
            # Revocations first: a batch that fails between the two writes must
            # not have added documents whose deletion it already knew.
            rows = F.count(F.lit(1)).alias("rows")
            n_gone = observed_write(gone, lambda d: write_partitioned(d, f"{root}/tombstones", label), rows)["rows"]
            n_docs = observed_write(docs, lambda d: write_partitioned(d, f"{root}/documents", label), rows)["rows"]
            other = batch.agg(F.count_if(F.col("route") == "skipped").alias("skipped"), F.max("time_us").alias("newest_us")).first()
            counts = local_table(spark, [(n_docs, n_gone, other["skipped"], other["newest_us"])], COUNTS)
            counts.write.mode("overwrite").json(f"{root}/stream_counts/batch={label}")
        finally:
            batch.unpersist()

    writer = routed.writeStream.queryName(name).option("checkpointLocation", checkpoint).foreachBatch(write)
    trigger = {"availableNow": True} if available_now else {"processingTime": interval}
    # A stream keeps the settings that it starts with; one that resumes keeps the kind of state of its checkpoint.
    with session_defaults(spark, STATE):
        return writer.trigger(**trigger).start()


def score_stream(docs: DataFrame, backend: Backend = DEFAULT_BACKEND) -> DataFrame:
    """Score documents as they land: the batch expressions on a stream."""
    return score_documents(docs, backend)


def daily_stream(scored: DataFrame, event_time: str = "event_time", lateness: str = "1 day",
                 keys: Sequence[str] = ("platform",)) -> DataFrame:
    """Daily moments of a scored stream: tumbling UTC days with a watermark."""
    day = F.window(event_time, "1 day")
    grouped = scored.withWatermark(event_time, lateness).groupBy(*keys, day.alias("_w")).agg(*daily_moments())
    return grouped.withColumn("day", F.to_date("_w.start")).drop("_w")
