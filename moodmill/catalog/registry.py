"""Registration of catalog queries."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    name: str
    fn: Callable[[SparkSession, str], DataFrame]
    sql: str | None

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        # Days and printed times are UTC in every job of this package.
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return self.fn(spark, sf_dir)


REGISTRY: dict[str, Query] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame under its own name."""

    def register(fn):
        key = name or fn.__name__
        if key in REGISTRY:
            raise ValueError(f"query registered twice: {key}")
        REGISTRY[key] = Query(key, fn, sql)
        return fn

    return register
