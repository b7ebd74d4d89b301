"""All queries of the engine by name, and their SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Modules of queries; each has QUERIES (name -> function) and SQL (name -> DuckDB text).
MODULES: tuple[str, ...] = ("storage", "series", "people", "texts", "market", "feeds", "desk", "streams")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for name in MODULES:
        out |= importlib.import_module(f"tidemark.plans.{name}").QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for name in MODULES:
        out |= importlib.import_module(f"tidemark.plans.{name}").SQL
    return out
