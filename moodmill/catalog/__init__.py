"""Every operator as a runnable query over the shared test tables, with the SQL
that must give the same answer where SQL can express it."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from moodmill.catalog.registry import REGISTRY, Query

MODULES = (
    "sources", "filters", "text", "scoring", "joins", "dedupe", "aggregates", "ranking",
    "sampling", "gate", "exports", "streams", "jobs", "trends", "storage",
)


def all_queries() -> dict[str, Query]:
    for name in MODULES:
        importlib.import_module(f"moodmill.catalog.{name}")
    return REGISTRY


def runnable() -> dict[str, Callable]:
    return {name: q.run for name, q in all_queries().items()}


def sql_texts() -> dict[str, str]:
    return {name: q.sql for name, q in all_queries().items() if q.sql}
