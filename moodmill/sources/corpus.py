"""Reading corpus files: gzipped JSON lines in dated, per-platform folders.

Three layouts live side by side under ``<root>/documents`` and
``<root>/tombstones``: ``dt=*/platform=*`` (append-only parts),
``batch=*/dt=*/platform=*`` (parts that a re-run of their batch replaces) and
``part=*/dt=*/platform=*`` (what compaction and revocation wrote, see
``sources.manifest``).
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from moodmill.schemas import CORPUS, OPTIONAL, REQUIRED, TOMBSTONE
from moodmill.files import children
from moodmill.session import local_table
from moodmill.sources.manifest import Manifest, read_manifest


def live_patterns(spark: SparkSession, base: str, manifest: Manifest, batches: list[str] | None = None) -> list[str]:
    """Path patterns of the rows that count: appended ones, batches, parts; empty where a layout has none.

    Batches are named one by one only if some no longer count, or if the caller names them.
    """
    if batches is None and manifest.folded:
        batches = [n for n, _ in children(spark, base) if n.startswith("batch=") and n not in manifest.folded]

    def any_of(names: Iterable[str]) -> str:
        # A folder without rows has no days; alternatives that match nothing are no error.
        return f"{{{','.join(names)}}}/dt=*" if names else ""

    return ["dt=*", "batch=*/dt=*" if batches is None else any_of(batches), any_of(manifest.parts)]


def file_below(base: str, path: Column) -> Column:
    """A file's path below the folder ``base``, from its full path."""
    return F.substring_index(path, f"/{base.rstrip('/').rsplit('/', 1)[-1]}/", -1)


def _read_layout(spark: SparkSession, base: str, pattern: str, schema: T.StructType) -> DataFrame | None:
    try:
        rows = spark.read.schema(schema).option("basePath", base).json(f"{base}/{pattern}")
        # Folders whose files are all gone have no days.
        return rows if "dt" in rows.columns else None
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def read_partitioned(spark: SparkSession, base: str, schema: T.StructType, *, with_file: bool = False,
                     manifest: Manifest | None = None, batches: list[str] | None = None,
                     appended: bool = True) -> DataFrame | None:
    """Rows that count, of all layouts, or None if there are no files. ``dt`` is a
    date partition column, so filters on it prune folders; the path's platform
    wins over the one in the row. ``with_file`` adds the file below ``base``;
    without ``appended`` only batches (those named, if any are) and parts are read."""
    manifest = manifest or read_manifest(spark, base)
    out = None
    for pattern in live_patterns(spark, base, manifest, batches)[0 if appended else 1 :]:
        part = _read_layout(spark, base, pattern, schema) if pattern else None
        if part is None:
            continue
        below = file_below(base, F.col("_metadata.file_path"))
        if manifest.removed:
            part = part.where(~below.isin(*manifest.removed))
        part = part.select(
            *(F.col(c).cast("string").alias(c) if c == "platform" else F.col(c) for c in schema.fieldNames()),
            F.col("dt").cast("date").alias("dt"), *([below.alias("file")] if with_file else []),
        )
        out = part if out is None else out.unionByName(part)
    return out


def live_files(spark: SparkSession, base: str, rows: DataFrame, manifest: Manifest) -> list[str]:
    """The files behind ``rows``, below ``base``; the scan has listed them already, so none is read."""
    folder = f"/{base.rstrip('/').rsplit('/', 1)[-1]}/"
    gone = set(manifest.removed)
    return sorted({f.rsplit(folder, 1)[-1] for f in rows.inputFiles()} - gone)


def read_documents(spark: SparkSession, root: str) -> DataFrame:
    """Corpus rows: required columns must occur, optional ones may be absent
    (NULL). No files at all is an error."""
    docs = read_partitioned(spark, f"{root}/documents", CORPUS)
    if docs is None:
        raise FileNotFoundError(f"no corpus documents under {root}/documents")
    # Stops at the first complete row; only without one is each column probed.
    complete = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in REQUIRED])
    if docs.where(complete).isEmpty():
        missing = [c for c in REQUIRED if docs.where(F.col(c).isNotNull()).isEmpty()]
    else:
        missing = []
    if missing:
        raise ValueError(f"corpus rows are missing required columns: {sorted(missing)}")
    return docs.select(*REQUIRED, *OPTIONAL, "harvested_at", "dt")


def read_tombstones(spark: SparkSession, root: str, with_day: bool = False) -> DataFrame:
    """Revocations; none is an empty table."""
    columns = [*TOMBSTONE.fieldNames(), *(["dt"] if with_day else [])]
    tombs = read_partitioned(spark, f"{root}/tombstones", TOMBSTONE)
    if tombs is None:
        empty = local_table(spark, [], TOMBSTONE)
        return empty.withColumn("dt", F.lit(None).cast("date")).select(*columns)
    return tombs.select(*columns)


def read_labels(spark: SparkSession, path: str, teacher_version: str, schema: T.StructType) -> DataFrame:
    """Labels of one version: only that version's folder is read. A table that
    does not exist yet is empty."""
    try:
        labels = spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        labels = local_table(spark, [], schema)
    return labels.where(F.col("teacher_version") == teacher_version).select(*schema.fieldNames())
