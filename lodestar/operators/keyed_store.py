"""A stored keyed collection whose upsert reads and writes only the parts that it touches.

The table is partitioned by a hash of the key into a fixed number of parts. An
upsert finds the parts of its keys, reads those (partition pruning), merges, and
overwrites them with dynamic partition overwrite; other parts are neither read
nor written. Running the same upsert again changes nothing, so one that failed
half way is simply repeated.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import durable
from .collections import upsert

PART = "_part"


@dataclass(frozen=True)
class KeyedStore:
    """The collection at ``path`` with one row for each ``key``; ``parts`` is fixed when it is made."""

    spark: SparkSession
    path: str
    key: str
    order_col: str
    parts: int = 64

    def part(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key).cast("string")), F.lit(self.parts)).cast("int")

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path).drop(PART)

    def exists(self) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def touched(self, updates: DataFrame) -> list[int]:
        """The parts that hold the keys of ``updates``: ``parts`` numbers at most."""
        return sorted(r[0] for r in updates.select(self.part().alias("p")).distinct().collect())

    def reached(self, parts: list[int]) -> DataFrame:
        """The rows of some parts; the others are not read."""
        return self.spark.read.parquet(self.path).where(F.col(PART).isin(parts)).drop(PART)

    def upsert(self, updates: DataFrame, parts: list[int] | None = None) -> list[int]:
        """Merge ``updates``: of each key the highest ``order_col`` stays, updates win ties. Returns the parts written.

        ``parts``: what ``touched`` gave for these keys. The updates are then read once and not stored before.
        """
        if parts is None:
            updates = durable(updates)
            parts = self.touched(updates)
        if not parts:
            return []
        base = self.reached(parts) if self.exists() else updates.limit(0)
        # Stored before it is written over what it was read from.
        merged = durable(upsert(base.select(*updates.columns), updates, [self.key], self.order_col))
        # A part that was not read must not be overwritten: keys that changed between two readings stop the write.
        known = F.when(self.part().isin(parts), self.part()).otherwise(F.raise_error(F.lit("a key lies outside the parts that were read")).cast("int"))
        dealt = merged.withColumn(PART, known).repartition(PART)
        dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(PART).parquet(self.path)
        return parts


def _offered(docs: DataFrame, text_col: str) -> DataFrame:
    return docs.withColumn("text_hash", F.md5(F.coalesce(F.col(text_col), F.lit(""))))


def changed(store: KeyedStore, docs: DataFrame, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """``docs`` with ``text_hash``: those whose text the store has under the same key, with its ``vector``; and the others."""
    offered = durable(_offered(docs, text_col))
    if not store.exists():
        return offered.limit(0).withColumn("vector", F.lit(None).cast("array<float>")), offered
    old = store.reached(store.touched(offered)).select(store.key, "text_hash", "vector")
    same = offered.join(old, [store.key, "text_hash"])
    return same, offered.join(old, [store.key, "text_hash"], "left_anti")


def index_changed(store: KeyedStore, docs: DataFrame, embedder: Callable[[Column], Column], text_col: str = "text") -> list[int]:
    """Upsert ``docs`` (the store's key and order column, text, …) with a ``vector``; texts that did not change are not embedded.

    Texts go once to the stored hashes and once to their parts; the embedder gets null for those that did not change.
    """
    offered = _offered(docs, text_col)
    parts = store.touched(offered)
    vector = embedder(F.col(text_col)).cast("array<float>")
    if parts and store.exists():
        old = store.reached(parts).select(store.key, "text_hash", F.struct("vector").alias("_old"))
        offered = offered.join(old, [store.key, "text_hash"], "left")
        fresh = offered.withColumn("_fresh", F.when(F.col("_old").isNull(), F.col(text_col)))
        made = fresh.withColumn("_made", embedder(F.col("_fresh")).cast("array<float>"))
        vector = F.when(F.col("_old").isNull(), F.col("_made")).otherwise(F.col("_old.vector"))
        return store.upsert(made.withColumn("vector", vector).select(*docs.columns, "text_hash", "vector"), parts)
    return store.upsert(offered.withColumn("vector", vector), parts)
