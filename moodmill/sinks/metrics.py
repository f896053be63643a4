"""Counts of jobs and streams, taken while rows pass and never by reading them again."""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from moodmill.files import create_once

PROGRESS = (
    "query string, name string, batch long, at string, input_rows long, state_rows long, "
    "late_rows long, took_ms long, metrics map<string,long>"
)


def observed_write(df: DataFrame, write: Callable[[DataFrame], None], *metrics: Column) -> dict[str, Any]:
    """Run ``write`` and return the metrics of the rows it wrote, from the same pass.

    ``write`` must run one action over the rows, as a file writer does.
    """
    seen = Observation()
    write(df.observe(seen, *metrics))
    return seen.get


class ProgressLog(StreamingQueryListener):
    """Keeps one row per micro-batch of every query of the session under ``path``.

    A row is a file of its own, named after query and batch, so that a replayed
    batch or a second listener adds nothing. Read them with ``stream_progress``.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def onQueryStarted(self, event: Any) -> None:
        pass

    def onQueryProgress(self, event: Any) -> None:
        p = event.progress
        metrics = {f"{name}.{k}": v for name, row in p.observedMetrics.items() for k, v in row.asDict().items() if isinstance(v, int)}
        row = {
            "query": str(p.id), "name": p.name, "batch": p.batchId, "at": p.timestamp, "input_rows": p.numInputRows,
            "state_rows": sum(s.numRowsTotal for s in p.stateOperators),
            "late_rows": sum(s.numRowsDroppedByWatermark for s in p.stateOperators),
            "took_ms": p.durationMs.get("triggerExecution", 0), "metrics": metrics,
        }
        create_once(self.spark, f"{self.path}/{p.id}-{p.batchId:010d}.json", json.dumps(row))

    def onQueryIdle(self, event: Any) -> None:
        pass

    def onQueryTerminated(self, event: Any) -> None:
        pass


def stream_progress(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PROGRESS).json(path)


def metric_totals(progress: DataFrame) -> DataFrame:
    """name, metric and its total over all batches of a query's runs."""
    rows = progress.select("name", F.explode("metrics").alias("metric", "value"))
    return rows.groupBy("name", "metric").agg(F.sum("value").alias("total"))
