"""Registry of (query, oracle) pairs."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..session import ship, spread, table


@dataclass(frozen=True)
class Entry:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


class Tables:
    """``t("orders")`` → DataFrame of the table below one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __call__(self, name: str) -> DataFrame:
        return table(self.spark, self.folder, name)

    def texts(self, name: str) -> DataFrame:
        """A table of long texts, on all cores."""
        frame = self(name)
        return spread(frame, frame.columns[0])


REGISTRY: dict[str, Entry] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(t)`` under ``name``; ``sql`` gives the same rows in DuckDB."""

    def wrap(fn: Callable[[Tables], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"{name} is registered twice")

        def run(spark: SparkSession, folder: str) -> DataFrame:
            ship(spark)
            return fn(Tables(spark, folder))

        REGISTRY[name] = Entry(run, sql)
        return fn

    return wrap
