"""Which files of a corpus folder count.

Appended parts (``dt=*``) and batches (``batch=*``) count as they lie. A manifest
names what later jobs changed about that: batches folded into a compact part, files
replaced because they held revoked rows, and the parts that hold their rows now
(``part=*``, which count only if named). Each change is one new file
``_manifest/<version>.json``; readers take the latest, so they see all of a change or
nothing of it. A job that dies before its manifest leaves a part that nobody reads.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, replace

from pyspark.sql import SparkSession

from moodmill.files import children, create_once, read_text

FOLDER = "_manifest"


@dataclass(frozen=True)
class Manifest:
    version: int = 0
    parts: tuple[str, ...] = ()
    # Batch folders whose rows a part holds, and files (below the base) replaced by one.
    folded: tuple[str, ...] = ()
    removed: tuple[str, ...] = ()


class ManifestConflict(RuntimeError):
    """Another job changed the corpus folder first."""


def read_manifest(spark: SparkSession, base: str) -> Manifest:
    names = [n for n, _ in children(spark, f"{base}/{FOLDER}") if n.endswith(".json") and not n.startswith(".")]
    if not names:
        return Manifest()
    found = json.loads(read_text(spark, f"{base}/{FOLDER}/{names[-1]}"))
    return Manifest(found["version"], *(tuple(found[k]) for k in ("parts", "folded", "removed")))


def commit_manifest(spark: SparkSession, base: str, was: Manifest, **changes) -> Manifest:
    """Make the next version, unless another job has made it since ``was`` was read."""
    now = replace(was, version=was.version + 1, **{k: tuple(sorted(set(v))) for k, v in changes.items()})
    if not create_once(spark, f"{base}/{FOLDER}/{now.version:012d}.json", json.dumps(asdict(now))):
        raise ManifestConflict(f"{base} changed since version {was.version}; run the job again")
    return now


def new_part(manifest: Manifest) -> str:
    """A folder name no earlier attempt at this version has used."""
    from uuid import uuid4

    return f"part={manifest.version + 1:06d}-{uuid4().hex[:12]}"
