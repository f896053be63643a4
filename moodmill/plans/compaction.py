"""Folding small batches of a corpus folder into large parts, and dropping what no longer counts."""

from __future__ import annotations

import time
from dataclasses import replace
from urllib.parse import unquote

from pyspark.sql import SparkSession
from pyspark.sql import types as T

from moodmill.files import children, delete, exists
from moodmill.sinks.corpus import write_partitioned
from moodmill.sources.corpus import read_partitioned
from moodmill.sources.manifest import FOLDER, Manifest, commit_manifest, new_part, read_manifest

# Parts beyond this number are folded together with the batches, so neither grows without end.
MAX_PARTS = 8
HOUR_MS = 3_600_000


def _stream_of(batch: str) -> str:
    """A batch's name without its number: the stream or job that writes it."""
    return batch.rsplit("-", 1)[0]


def finished_batches(spark: SparkSession, base: str, manifest: Manifest, keep_newest: bool = True) -> list[str]:
    """Batch folders that are complete and not folded yet.

    The newest of each stream stays: after a crash its stream may write it again.
    """
    names = [n for n, _ in children(spark, base) if n.startswith("batch=") and n not in manifest.folded]
    newest = {_stream_of(n): n for n in names}
    ready = [n for n in names if not (keep_newest and newest[_stream_of(n)] == n)]
    return [n for n in ready if exists(spark, f"{base}/{n}/_SUCCESS")]


def compact(spark: SparkSession, base: str, schema: T.StructType, *, max_parts: int = MAX_PARTS,
            keep_newest: bool = True) -> Manifest:
    """Fold finished batches into one part; readers switch with the manifest.

    Rows, days and platforms stay as they are. The part is written first, under
    a name of its own, so a job that dies leaves the old state; a second job at
    the same time loses the commit and changes nothing. The folded folders stay
    for readers that listed them before; ``vacuum`` takes them.
    """
    was = read_manifest(spark, base)
    batches = finished_batches(spark, base, was, keep_newest)
    parts = was.parts if len(was.parts) >= max_parts else ()
    if not batches and len(parts) < 2:
        return was
    name = new_part(was)
    live = replace(was, parts=parts)
    rows = read_partitioned(spark, base, schema, manifest=live, batches=batches, appended=False)
    if rows is not None:
        write_partitioned(rows, f"{base}/{name}")
    kept = [p for p in was.parts if p not in parts]
    return commit_manifest(spark, base, was, parts=[*kept, *([name] if rows is not None else [])], folded=[*was.folded, *batches])


def vacuum(spark: SparkSession, base: str, older_than_hours: float = 24, now_ms: int | None = None) -> list[str]:
    """Delete folded batches, replaced files and parts no manifest names, once older than that.

    The time is the readers' grace: a job that listed the folder before the
    switch may still read it. Manifests end up as short as the folder's state:
    names of what is gone are left out. Returns what was deleted.
    """
    was = read_manifest(spark, base)
    limit = (now_ms or int(time.time() * 1000)) - older_than_hours * HOUR_MS
    there = children(spark, base)
    old = {n for n, changed in there if changed <= limit}
    folders = [n for n in was.folded if n in old] + [n for n in old if n.startswith("part=") and n not in was.parts]
    files = [f for f in was.removed if dict(children(spark, f"{base}/{unquote(f.rsplit('/', 1)[0])}")).get(unquote(f.rsplit("/", 1)[1]), 0) <= limit]
    # The manifest forgets names only after what they name is gone.
    for name in [*folders, *map(unquote, files)]:
        delete(spark, f"{base}/{name}")
    left = {n for n, _ in children(spark, base)}
    folded, removed = [n for n in was.folded if n in left], [f for f in was.removed if f not in files]
    if len(folded) < len(was.folded) or len(removed) < len(was.removed):
        commit_manifest(spark, base, was, folded=folded, removed=removed)
    for name, changed in [v for v in children(spark, f"{base}/{FOLDER}") if v[0].endswith(".json")][:-2]:
        if changed <= limit:
            delete(spark, f"{base}/{FOLDER}/{name}")
    return sorted([*folders, *files])
