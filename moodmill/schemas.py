"""Explicit schemas of every table the jobs read or write."""

from __future__ import annotations

from pyspark.sql import types as T

S, L, I, B = T.StringType(), T.LongType(), T.IntegerType(), T.BooleanType()


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, dtype, True) for name, dtype in fields.items()])


# Canonical class order; every probability triple in the package follows it.
CLASSES = ("negative", "neutral", "positive")
PROBS = tuple(f"p_{c}" for c in CLASSES)

# A corpus row carries these always ...
REQUIRED = ("platform", "doc_id", "text", "content_sha256", "hash_version")
# ... and these when the source knows them.
OPTIONAL = ("author_did", "author", "langs", "created_at")

CORPUS = struct(
    platform=S, doc_id=S, author_did=S, author=S, text=S, langs=T.ArrayType(S),
    created_at=S, harvested_at=S, content_sha256=S, hash_version=I,
)
TOMBSTONE = struct(platform=S, scope=S, doc_id=S, author_did=S, deleted_at=S)
TRAINING_COLUMNS = (
    "platform", "doc_id", "author_did", "author", "text", "langs",
    "created_at", "content_sha256", "hash_version",
)
# Documents as the query path sees them, whatever platform they came from.
SOURCED = struct(
    platform=S, doc_id=S, text=S, language=S, url=S, author=S, posted_at=T.TimestampType(),
)
LABELS = T.StructType(
    [T.StructField("platform", S), T.StructField("doc_id", S)]
    + [T.StructField(p, T.FloatType()) for p in PROBS]
    + [T.StructField("teacher_version", S)]
)
ASPECT_LABELS = T.StructType(
    LABELS.fields[:2] + [T.StructField("aspect", S)] + LABELS.fields[2:]
)
EVENT = struct(
    did=S, time_us=L, kind=S,
    commit=struct(
        operation=S, collection=S, rkey=S,
        record=struct(text=S, langs=T.ArrayType(S), createdAt=S),
    ),
    account=struct(active=B, did=S),
)
ARCHIVE_COLUMNS = ("id", "type", "by", "time", "text", "title", "deleted", "dead")
INLINE = struct(
    id=S, text=S, language=S, aspects=T.ArrayType(S), metadata=T.MapType(S, S),
)
