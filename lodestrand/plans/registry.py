"""Registered queries over the driver's tables, with their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import coverage, curation, relational, storage, vectors

MODULES = (vectors, curation, relational, coverage, storage)
Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {name: f for m in MODULES for name, (f, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, (_, sql) in m.QUERIES.items() if sql}
