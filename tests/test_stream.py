import json

from moodmill.catalog.streams import stream_events
from moodmill.operators.scoring import DEFAULT_BACKEND
from moodmill.sources.corpus import read_documents, read_tombstones
from moodmill.streaming import firehose as J

POST = "trams run every ten minutes along the harbour today"
NOON = 1_780_000_000_000_000  # microseconds


def post(did, us, rkey, text, langs, op="create"):
    record = {"text": text, "langs": langs, "createdAt": "2026-05-28T20:26:40Z"}
    commit = {"operation": op, "collection": J.POST_COLLECTION, "rkey": rkey, "record": record}
    return {"did": did, "time_us": us, "kind": "commit", "commit": commit}


def deletion(did, us, rkey):
    return {"did": did, "time_us": us, "kind": "commit", "commit": {"operation": "delete", "collection": J.POST_COLLECTION, "rkey": rkey}}


def account(did, us, **state):
    return {"did": did, "time_us": us, "kind": "account", "account": {"did": did, **state}}


# Two posts pass, one is in another language, one too short; then revocations and an event of no interest.
SCRIPT = [
    post("did:x:ines", NOON, "k1", POST, ["en"]),
    post("did:x:jon", NOON + 1, "k2", POST + " and tomorrow", ["en", "de"]),
    post("did:x:kai", NOON + 2, "k3", "die Straßenbahn fährt heute alle zehn Minuten", ["de"]),
    post("did:x:lea", NOON + 3, "k4", "late again", ["en"]),
    deletion("did:x:mia", NOON + 4, "k5"),
    account("did:x:nils", NOON + 5, active=False),
    {"did": "did:x:nils", "time_us": NOON + 5, "kind": "identity"},
]
FILTER = J.FirehoseFilter(langs=["en"], min_bytes=20)


def events(spark, rows):
    return J.parse_events(spark.createDataFrame([(r if isinstance(r, str) else json.dumps(r),) for r in rows], "payload string"))


def routes(spark, rows, admit=FILTER):
    return [r["route"] for r in J.route_events(events(spark, rows), admit).orderBy("time_us").collect()]


def test_script(spark):
    assert sorted(routes(spark, [*SCRIPT, "{broken", "", "[]"])) == sorted(
        ["document", "document", "skipped", "skipped", "doc_tombstone", "account_tombstone", "ignored"])


def test_routing_details(spark):
    other = post("d", 1, "r", POST, ["en"])
    other["commit"]["collection"] = "app.bsky.feed.like"
    bare = {"did": "d", "time_us": 3, "kind": "commit", "commit": {"operation": "create", "collection": J.POST_COLLECTION, "rkey": "x"}}
    rows = [
        other, post("d", 2, "r", POST, ["en-US"], op="update"), bare,
        {"did": "d", "time_us": 4, "kind": "account", "account": {"active": True, "did": "d"}},
        {"did": "d", "time_us": 5, "kind": "account", "account": {"did": "d"}},
        {"did": "d", "time_us": 6, "kind": "account"},
        post("d", 7, "r", "  \n ", ["en"]),
        post("d", 8, "r", POST, None),
    ]
    assert routes(spark, rows) == [
        "ignored", "document", "ignored", "ignored", "account_tombstone", "ignored", "skipped", "skipped"]


def test_revocations_are_never_sampled(spark):
    nothing = J.FirehoseFilter(sample_rate=0.0)
    assert sorted(routes(spark, SCRIPT, nothing)) == sorted(
        ["skipped"] * 4 + ["doc_tombstone", "account_tombstone", "ignored"])


def start(spark, tmp_path, checkpoint="ckpt"):
    source = J.firehose_source(spark, str(tmp_path / "landing"))
    run = J.start_corpus_stream(source, str(tmp_path / "corpus"), str(tmp_path / checkpoint), FILTER, name="t", available_now=True)
    run.awaitTermination()


def stored(spark, tmp_path):
    root = str(tmp_path / "corpus")
    docs = sorted(r["doc_id"].rsplit("/")[-1] for r in read_documents(spark, root).collect())
    gone = sorted((r["scope"], (r["doc_id"] or r["author_did"])[-4:]) for r in read_tombstones(spark, root).collect())
    return docs, gone


def land(tmp_path, name, rows):
    (tmp_path / "landing").mkdir(exist_ok=True)
    (tmp_path / "landing" / name).write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows) + "\n")


def test_stream_writes_corpus_and_resumes(spark, tmp_path):
    land(tmp_path, "a.jsonl", [*SCRIPT, "{broken"])
    start(spark, tmp_path)
    assert stored(spark, tmp_path) == (["k1", "k2"], [("account", "nils"), ("doc", "t/k5")])
    assert J.stream_counts(spark, str(tmp_path / "corpus")) == {"documents": 2, "tombstones": 2, "skipped": 2}
    (d,) = read_documents(spark, str(tmp_path / "corpus")).where("author_did = 'did:x:ines'").collect()
    assert (d["platform"], d["text"], d["langs"]) == ("bluesky", POST, ["en"]) and str(d["dt"]) == "2026-05-28"

    # Only the new file is read; the old ones are behind the checkpoint.
    land(tmp_path, "b.jsonl", [post("did:x:olga", NOON + 10**11, "k9", POST + " once more", ["en"])])
    start(spark, tmp_path)
    assert stored(spark, tmp_path)[0] == ["k1", "k2", "k9"]


def test_late_events_and_replays(spark, tmp_path):
    hour = 3600 * 10**6
    land(tmp_path, "a.jsonl", SCRIPT)
    start(spark, tmp_path)
    # Hours behind the newest event: a post, a deletion, and an account that goes in the microsecond of its identity event.
    late = [
        post("did:x:pia", NOON - 9 * hour, "k6", POST + " as before", ["en"]), deletion("did:x:ines", NOON - 8 * hour, "k1"),
        {"did": "did:x:rut", "time_us": NOON - 7 * hour, "kind": "identity"}, account("did:x:rut", NOON - 7 * hour),
    ]
    land(tmp_path, "b.jsonl", late)
    start(spark, tmp_path)
    both = (["k1", "k2", "k6"], [("account", ":rut"), ("account", "nils"), ("doc", "t/k1"), ("doc", "t/k5")])
    assert stored(spark, tmp_path) == both
    land(tmp_path, "c.jsonl", [*SCRIPT, *late, *late])
    start(spark, tmp_path)
    assert stored(spark, tmp_path) == both
    counts = J.stream_counts(spark, str(tmp_path / "corpus"))
    assert (counts["documents"], counts["tombstones"]) == (3, 4)

    # A stream that lost its checkpoint reads everything again and destroys nothing.
    start(spark, tmp_path, checkpoint="other")
    assert stored(spark, tmp_path) == both


HEAP_STATE = "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def state_files(tmp_path):
    return {f.suffix for f in (tmp_path / "ckpt" / "state").rglob("*")} & {".zip", ".delta"}


def test_state_of_replays_is_not_in_the_heap(spark, tmp_path):
    assert all(spark.conf.get(k, None) is None for k in J.STATE)
    land(tmp_path, "a.jsonl", [*SCRIPT, *SCRIPT])
    start(spark, tmp_path)
    # RocksDB keeps archives of its files, state in the heap keeps changes.
    assert state_files(tmp_path) == {".zip"}
    assert all(spark.conf.get(k, None) is None for k in J.STATE)
    land(tmp_path, "b.jsonl", [*SCRIPT, post("did:x:olga", NOON + 9, "k9", POST, ["en"])])
    start(spark, tmp_path)
    assert stored(spark, tmp_path) == (["k1", "k2", "k9"], [("account", "nils"), ("doc", "t/k5")])


def test_checkpoint_with_state_in_the_heap_resumes(spark, tmp_path):
    land(tmp_path, "a.jsonl", SCRIPT)
    spark.conf.set(PROVIDER, HEAP_STATE)
    try:
        start(spark, tmp_path)
        assert spark.conf.get(PROVIDER) == HEAP_STATE
    finally:
        spark.conf.unset(PROVIDER)
    land(tmp_path, "b.jsonl", [*SCRIPT, post("did:x:olga", NOON + 9, "k9", POST, ["en"])])
    start(spark, tmp_path)
    assert stored(spark, tmp_path) == (["k1", "k2", "k9"], [("account", "nils"), ("doc", "t/k5")])
    assert state_files(tmp_path) == {".delta"}


def test_scored_stream_equals_batch(spark, tmp_path):
    land(tmp_path, "a.jsonl", [post("d", i * 86_400_000_000, f"r{i}", POST + (" great" if i % 2 else " awful"), ["en"]) for i in range(6)])
    source = J.firehose_source(spark, str(tmp_path / "landing"))
    routed = J.route_events(source, FILTER).where("route = 'document'")
    out = str(tmp_path / "series")
    run = (
        J.daily_stream(J.score_stream(routed, DEFAULT_BACKEND)).writeStream.outputMode("complete")
        .option("checkpointLocation", str(tmp_path / "c"))
        .foreachBatch(lambda b, _: b.write.mode("overwrite").parquet(out)).trigger(availableNow=True).start()
    )
    run.awaitTermination()
    got = spark.read.parquet(out).orderBy("day").select("n_positive", "n_negative", "sample_size").collect()
    assert [tuple(r) for r in got] == [(0, 1, 1), (1, 0, 1)] * 3


def test_route_counts(spark):
    counts = {r["route"]: r["rows"] for r in J.route_counts(J.route_events(events(spark, SCRIPT), FILTER)).collect()}
    assert counts == {"document": 2, "skipped": 2, "doc_tombstone": 1, "account_tombstone": 1, "ignored": 1}


def test_refused_posts_leave_their_text_before_state(spark):
    rows = [("document", "kept"), ("skipped", "refused"), ("doc_tombstone", None)]
    routed = spark.createDataFrame(
        [(r, t, ["en"], "2024-01-01T00:00:00Z", i) for i, (r, t) in enumerate(rows)],
        "route string, text string, langs array<string>, created_at string, time_us long",
    )
    got = J.without_refused_text(routed).orderBy("time_us").collect()
    assert [(r["route"], r["text"], r["langs"], r["time_us"]) for r in got] == [
        ("document", "kept", ["en"], 0), ("skipped", None, None, 1), ("doc_tombstone", None, None, 2),
    ]


def test_replayed_events_meet_documents_in_one_join(spark, tmp_path):
    spark.sql("SELECT 0L AS event_id, timestamp'2024-01-01' AS ts, 1L AS user_id, 'view' AS event_type").write.parquet(f"{tmp_path}/events.parquet")
    spark.sql("SELECT 0L AS doc_id, 'some text' AS text, 'en' AS lang").write.parquet(f"{tmp_path}/documents.parquet")
    for replayed in (False, True):
        plan = stream_events(spark, str(tmp_path), replayed)._jdf.queryExecution().analyzed().toString()
        assert plan.count("Join LeftOuter") == 1 and plan.count("StreamingRelation") == 1 + replayed
