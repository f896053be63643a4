"""Removing revoked rows from a stored corpus by rewriting only the files that may hold one.

Each document file has two Bloom filters, of (platform, doc_id) and of (platform,
author_did), kept as one small row in ``_index`` beside the files. Applying
tombstones asks every file's filters for the revoked keys, reads the files that
answer "maybe", and replaces those that did hold a revoked row by a part without it,
in one manifest. All other files stay as they are, byte by byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from moodmill.operators.revocation import account_tombstones, doc_tombstones, mark_revoked
from moodmill.schemas import CORPUS
from moodmill.session import local_table
from moodmill.sinks.corpus import write_partitioned
from moodmill.sources.corpus import live_files, read_partitioned, read_tombstones
from moodmill.sources.manifest import commit_manifest, new_part, read_manifest

BITS_PER_KEY = 12
PROBES = 8
# Revoked keys that are asked for in one step; a block of them is 8 bytes a key.
BLOCK_KEYS = 65_536
INDEX = "file string, platform string, rows long, docs binary, authors binary"


def _positions(keys: np.ndarray, bits: int) -> np.ndarray:
    """Bit positions of each key, a row a key, by double hashing of its two halves."""
    keys = keys.view(np.uint64)
    first, second = keys & np.uint64(0xFFFFFFFF), (keys >> np.uint64(32)) | np.uint64(1)
    return (first[:, None] + np.arange(PROBES, dtype=np.uint64)[None, :] * second[:, None]) % np.uint64(bits)


def bloom(keys: np.ndarray) -> bytes:
    """A filter of distinct 64-bit keys; none at all is no bytes."""
    if not len(keys):
        return b""
    bits = -(-len(keys) * BITS_PER_KEY // 64) * 64
    held = np.zeros(bits, dtype=bool)
    held[_positions(keys, bits).ravel()] = True
    return np.packbits(held, bitorder="little").tobytes()


def may_hold(filter_: bytes, keys: np.ndarray) -> bool:
    """Whether any of the keys may be in the filter; never False for one that is."""
    if not filter_ or not len(keys):
        return False
    held = np.unpackbits(np.frombuffer(filter_, dtype=np.uint8), bitorder="little").astype(bool)
    return bool(held[_positions(keys, len(held))].all(axis=1).any())


def _index_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a file. A gzipped file is read by one task, so its rows come one after the other."""
    now: list[str] | None = None
    docs: list[np.ndarray] = []
    authors: list[np.ndarray] = []
    rows = 0

    def done() -> pa.RecordBatch:
        filters = [bloom(np.unique(np.concatenate(k))) for k in (docs, authors)]
        columns = [[now[0]], [now[1]], [rows], [filters[0]], [filters[1]]]
        types = [pa.string(), pa.string(), pa.int64(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["file", "platform", "rows", "docs", "authors"])

    for batch in batches:
        files = batch.column(0).to_pylist()
        edges = [0, *(k for k in range(1, len(files)) if files[k] != files[k - 1]), len(files)]
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            if lo == hi:
                continue
            if now is None or now[0] != files[lo]:
                if now is not None:
                    yield done()
                now, docs, authors, rows = [files[lo], batch.column(1)[lo].as_py()], [], [], 0
            docs.append(batch.column(2).slice(lo, hi - lo).drop_null().to_numpy(zero_copy_only=False))
            authors.append(batch.column(3).slice(lo, hi - lo).drop_null().to_numpy(zero_copy_only=False))
            rows += hi - lo
    if now is not None:
        yield done()


def _key(name: str) -> Column:
    return F.when(F.col(name).isNotNull(), F.xxhash64("platform", name))


def read_index(spark: SparkSession, base: str) -> DataFrame | None:
    try:
        return spark.read.schema(INDEX).parquet(f"{base}/_index")
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def refresh_index(spark: SparkSession, root: str) -> DataFrame:
    """Index the files that have no row yet and return the rows of the files that count.

    Files are never changed in place, so a row stays right; a batch that its
    stream wrote again has new file names. Only ids and authors are read.
    """
    base = f"{root}/documents"
    manifest = read_manifest(spark, base)
    docs = read_partitioned(spark, base, CORPUS, with_file=True, manifest=manifest)
    if docs is None:
        raise FileNotFoundError(f"no corpus documents under {base}")
    files = local_table(spark, [(f,) for f in live_files(spark, base, docs, manifest)], "file string")
    known = read_index(spark, base)
    if known is not None:
        # Names of files, which prune the scan itself.
        fresh = [r["file"] for r in files.join(known.select("file"), "file", "left_anti").collect()]
        docs = docs.where(F.col("file").isin(fresh)) if fresh else None
    if docs is not None:
        keys = docs.select("file", "platform", _key("doc_id").alias("doc"), _key("author_did").alias("author"))
        keys.mapInArrow(_index_files, INDEX).write.mode("append").parquet(f"{base}/_index")
    return read_index(spark, base).dropDuplicates(["file"]).join(files, "file", "left_semi")


def _blocks(keys: DataFrame, name: str) -> DataFrame:
    """Hashed keys of a platform in arrays of about ``BLOCK_KEYS``."""
    hashed = keys.select("platform", _key(name).alias("key")).distinct()
    sizes = hashed.groupBy("platform").agg(F.ceil(F.count("*") / BLOCK_KEYS).alias("blocks"))
    dealt = hashed.join(sizes, "platform").withColumn("block", F.pmod("key", F.col("blocks")))
    return dealt.groupBy("platform", "block").agg(F.collect_list("key").alias("keys"))


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = [np.array(k, dtype=np.int64) for k in batch.column("keys").to_pylist()]
        maybe = [may_hold(f, k) for f, k in zip(batch.column("filter").to_pylist(), keys, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("file").filter(pa.array(maybe, pa.bool_()))], ["file"])


def files_to_rewrite(index: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Files whose filters answer "maybe" to a tombstone of their platform."""
    found = None
    for keys, name, column in ((doc_tombstones(tombstones), "doc_id", "docs"), (account_tombstones(tombstones), "author_did", "authors")):
        asked = index.select("file", "platform", F.col(column).alias("filter")).join(_blocks(keys, name), "platform")
        files = asked.select("file", "filter", "keys").mapInArrow(_asked, "file string")
        found = files if found is None else found.union(files)
    return found.distinct()


def apply_tombstones(spark: SparkSession, root: str, tombstones: DataFrame | None = None) -> dict[str, int]:
    """Drop revoked rows from the stored documents; counts of files and rows.

    ``tombstones`` are all stored ones unless the caller passes those that are
    new since the last run. Documents that arrive later are not touched: readers
    go on applying tombstones, and the next run takes them. Running it again
    changes nothing. A job that dies leaves the old state.
    """
    base = f"{root}/documents"
    tombstones = read_tombstones(spark, root) if tombstones is None else tombstones
    was = read_manifest(spark, base)
    index = refresh_index(spark, root)
    maybe = [r["file"] for r in files_to_rewrite(index, tombstones).collect()]
    counts = {"files": index.count(), "asked": len(maybe), "rewritten": 0, "revoked": 0}
    if not maybe:
        return counts
    held = read_partitioned(spark, base, CORPUS, with_file=True, manifest=was).where(F.col("file").isin(maybe))
    # A filter may be wrong about a file: one without a revoked row stays.
    hits = {
        r["file"]: r["rows"]
        for r in mark_revoked(held, tombstones).where("revoked").groupBy("file").agg(F.count("*").alias("rows")).collect()
    }
    if not hits:
        return counts
    name = new_part(was)
    rows = mark_revoked(held.where(F.col("file").isin(*hits)), tombstones).where("NOT revoked").drop("revoked", "file")
    write_partitioned(rows, f"{base}/{name}")
    commit_manifest(spark, base, was, parts=[*was.parts, name], removed=[*was.removed, *hits])
    return counts | {"rewritten": len(hits), "revoked": sum(hits.values())}
