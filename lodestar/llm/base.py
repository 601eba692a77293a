"""Queries of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import durable, shared_folder, ship, stored, table  # noqa: F401  (handed on to the operators)
from ..workload.base import Entry, Tables

REGISTRY: dict[str, Entry] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(t)`` under ``name``; ``sql`` gives the same rows in DuckDB."""

    def wrap(fn):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            ship(spark)
            return fn(Tables(spark, folder))

        REGISTRY[name] = Entry(run, sql)
        return fn

    return wrap
