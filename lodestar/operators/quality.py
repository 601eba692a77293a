"""Constraint checks: each returns the rows (or keys) that break the rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def check_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def check_not_null(df: DataFrame, columns: list[str]) -> DataFrame:
    broken = F.lit(False)
    for name in columns:
        broken = broken | F.col(name).isNull()
    return df.where(broken)


def null_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])


def check_fk(child: DataFrame, parent: DataFrame, on: list[tuple[str, str]]) -> DataFrame:
    """Child rows whose non-null key has no parent."""
    keys = parent.select(*[F.col(p).alias(f"_p{i}") for i, (_, p) in enumerate(on)])
    condition = F.lit(True)
    for i, (c, _) in enumerate(on):
        condition = condition & (child[c] == keys[f"_p{i}"])
        child = child.where(child[c].isNotNull())
    return child.join(keys, condition, "left_anti")


def check_predicate(df: DataFrame, rule: Column) -> DataFrame:
    """Rows for which the rule is false. As in SQL, an unknown result is no violation."""
    return df.where(~rule)


def fill_defaults(df: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    return df.withColumns({name: F.coalesce(F.col(name), value) for name, value in defaults.items()})
