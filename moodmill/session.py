"""Session settings the jobs are designed for, and checkpoint location handling."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

# Settings that matter at any scale. Shuffle partition counts are left to AQE:
# start high on a cluster, let coalescing bring small stages down.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Per-platform limits above the default of 1000 are cut before the shuffle too.
    "spark.sql.optimizer.windowGroupLimitThreshold": "100000",
}


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A single-JVM session for tests and benchmarks."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("moodmill")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder lineage is cut into.

    A cluster names it in ``spark.checkpoint.dir``; only where that is unset
    (local tests) is a temporary folder made and registered.
    """
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    current = conf or spark.sparkContext.getCheckpointDir()
    if current:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(current)
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    made = tempfile.mkdtemp(prefix="moodmill-ckpt-")
    spark.sparkContext.setCheckpointDir(made)
    return os.fspath(made)


@contextmanager
def session_defaults(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    """Those of the settings that the session does not make itself, for the time of a block."""
    added = [k for k in settings if spark.conf.get(k, None) is None]
    try:
        for k in added:
            spark.conf.set(k, settings[k])
        yield
    finally:
        for k in added:
            spark.conf.unset(k)


def spread_small(scan: DataFrame) -> DataFrame:
    """Spread a scan that has fewer splits than the cluster has cores.

    A small table in one file would otherwise be scored or mined by one task.
    Tables of any size worth a cluster have more splits and are left alone.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def local_table(spark: SparkSession, rows: Sequence[Sequence[Any]], schema: T.StructType | str) -> DataFrame:
    """A small table of constants whose size the planner knows.

    Rows handed over as an Arrow table become a local relation, so joins with it
    are broadcast because it is small; a plain list becomes an RDD of unknown
    size, and its joins shuffle the big side.
    """
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    arrow = to_arrow_schema(schema)
    columns = list(zip(*rows, strict=True)) or [()] * len(schema.fields)
    arrays = [pa.array(list(c), f.type) for c, f in zip(columns, arrow, strict=True)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, schema=arrow), schema)
