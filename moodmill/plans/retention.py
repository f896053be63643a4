"""Removing revoked sources and expired text from a stored corpus."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from moodmill.operators.filters import expire_text, purge_source
from moodmill.schemas import CORPUS
from moodmill.sinks.corpus import write_partitioned
from moodmill.sources.corpus import read_documents, read_tombstones

# The batch a rewrite leaves, so that a second run replaces it.
REWRITE = "rewrite"


def rewrite_corpus(spark: SparkSession, root: str, new_root: str, *, purge: Sequence[str] = (),
                   now: dt.datetime | str | None = None, keep_days: int | None = None) -> None:
    """Copy a corpus without the sources in ``purge`` and, if asked, without
    documents older than ``keep_days``. Days, hashes and harvest times stay as
    they are; tombstones are always kept. Running it again replaces what it wrote
    before. The old folder is left for its owner to drop once readers use the new
    one; training sets are then rebuilt."""
    if new_root.rstrip("/") == root.rstrip("/"):
        raise ValueError("a corpus cannot be rewritten into its own folder")
    docs = read_documents(spark, root)
    for platform in purge:
        docs = purge_source(docs, platform)
    if keep_days is not None:
        docs = expire_text(docs, now or dt.datetime.now(dt.timezone.utc), keep_days)
    write_partitioned(docs.select(*CORPUS.fieldNames(), "dt"), f"{new_root}/documents", REWRITE)
    tombs = read_tombstones(spark, root, with_day=True)
    write_partitioned(tombs, f"{new_root}/tombstones", REWRITE)


def append_outcomes(outcomes: DataFrame, root: str, run_id: str) -> None:
    """Keep what each source answered in a run; a repeated run replaces its rows."""
    outcomes.write.mode("overwrite").parquet(f"{root}/source_outcomes/run_id={run_id}")
