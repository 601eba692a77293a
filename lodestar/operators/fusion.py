"""Combining ranked lists of two sources.

Lists are (query_id, id, content, score, rank, …). Duplicate contents are found
within one query, by their first ``prefix`` characters, or as a whole (``None``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.strings import strip

PREFIX = 100


def minmax(hits: DataFrame, by: list[str]) -> DataFrame:
    """Scores scaled to [0, 1] within each group; a constant list becomes 1."""
    w = Window.partitionBy(*by)
    low, high = F.min("score").over(w), F.max("score").over(w)
    scaled = F.when(high == low, F.lit(1.0)).otherwise((F.col("score") - low) / (high - low))
    return hits.withColumn("score", scaled)


def prefix_key(content: Column, prefix: int | None = PREFIX) -> Column:
    text = strip(F.coalesce(content, F.lit("")))
    return F.lower(text if prefix is None else F.substring(text, 1, prefix))


def dedup_prefix(hits: DataFrame, order: list[str], by: str = "query_id", prefix: int | None = PREFIX) -> DataFrame:
    """First row in ``order`` for each (query, content prefix).

    ``row_number() = 1`` is cut on the map side, so a passage copied a million
    times sends one row per task.
    """
    w = Window.partitionBy(by, "_key").orderBy(*order)
    keyed = hits.withColumn("_key", prefix_key(F.col("content"), prefix))
    return keyed.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn", "_key")


def dedup_prefix_global(docs: DataFrame, order: str, prefix: int | None = PREFIX) -> DataFrame:
    """The same over one whole table of documents."""
    return dedup_prefix(docs.withColumn("query_id", F.lit(0)), [order], prefix=prefix).drop("query_id")


def _tag(vector: DataFrame, graph: DataFrame) -> DataFrame:
    v = vector.withColumn("source_type", F.lit("vector")).withColumn("_source", F.lit(0))
    g = graph.withColumn("source_type", F.lit("graph")).withColumn("_source", F.lit(1))
    return v.unionByName(g)


def _top(hits: DataFrame, order: list[Column], k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(*order)
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("_source", "_in_rank")


def _placed(hits: DataFrame) -> DataFrame:
    return hits.withColumnRenamed("rank", "_in_rank")


def fuse_weighted(vector: DataFrame, graph: DataFrame, k: int, vector_weight: float = 0.5, graph_weight: float = 0.5, dedup: bool = True, prefix: int | None = PREFIX) -> DataFrame:
    """Normalise each list, weigh, merge, best k. Equal scores keep vector first, then list order."""
    for weight in (vector_weight, graph_weight):
        if not 0 <= weight <= 1:
            raise ValueError("weights lie in [0, 1]")
    v = minmax(vector, ["query_id"]).withColumn("score", F.col("score") * vector_weight)
    g = minmax(graph, ["query_id"]).withColumn("score", F.col("score") * graph_weight)
    merged = _placed(_tag(v, g))
    if dedup:
        merged = dedup_prefix(merged, ["_source", "_in_rank"], prefix=prefix)
    return _top(merged, [F.col("score").desc(), F.col("_source"), F.col("_in_rank")], k)


def fuse_ensemble(vector: DataFrame, graph: DataFrame, k: int, dedup: bool = True, prefix: int | None = PREFIX) -> DataFrame:
    """Interleave: first of each list, then second of each; scores stay as they are."""
    merged = _placed(_tag(vector, graph))
    if dedup:
        merged = dedup_prefix(merged, ["_in_rank", "_source"], prefix=prefix)
    return _top(merged, [F.col("_in_rank"), F.col("_source")], k)


def fuse_cascade(vector: DataFrame, graph: DataFrame, k: int, threshold: float = 0.7, dedup: bool = True, prefix: int | None = PREFIX) -> DataFrame:
    """Vector hits alone where there are k of them with a mean score above ``threshold``; else both lists."""
    gate = vector.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("_n"), F.avg(F.when(F.col("rank") <= k, F.col("score"))).alias("_mean")
    )
    good = gate.where((F.col("_n") >= k) & (F.round("_mean", 6) > threshold)).select("query_id", F.lit(True).alias("_good"))
    merged = _placed(_tag(vector, graph)).join(good, "query_id", "left")
    alone = F.coalesce("_good", F.lit(False))
    merged = merged.where(~alone | (F.col("_source") == 0))
    if dedup:
        # A list that stands alone is passed on as it is.
        w = Window.partitionBy("query_id", "_key").orderBy("_source", "_in_rank")
        merged = merged.withColumn("_key", prefix_key(F.col("content"), prefix)).withColumn("_rn", F.row_number().over(w))
        merged = merged.where(alone | (F.col("_rn") == 1)).drop("_rn", "_key")
    return _top(merged.drop("_good"), [F.col("_source"), F.col("_in_rank")], k)


STRATEGIES = {"weighted": fuse_weighted, "ensemble": fuse_ensemble, "cascade": fuse_cascade}


def fuse(strategy: str, vector: DataFrame, graph: DataFrame, k: int, **options) -> DataFrame:
    """Dispatch by name; an unknown name means ``weighted``."""
    return STRATEGIES.get(strategy, fuse_weighted)(vector, graph, k, **options)


def normalise_graph_hits(hits: DataFrame) -> DataFrame:
    """Foreign hits (query_id, position, text, content, confidence, metadata) in the common shape.

    A row without ``content`` is a bare string: it gets the id ``graph_<position>``
    and full confidence.
    """
    bare = F.col("content").isNull()
    confidence = F.when(bare, F.lit(1.0)).otherwise(F.coalesce("confidence", F.lit(1.0)))
    wrapped = F.create_map(
        F.lit("source"), F.lit("graph"),
        F.lit("result_id"), F.concat(F.lit("graph_"), F.col("position").cast("string")),
        F.lit("confidence"), F.lit("1.0"),
    )
    return hits.select(
        "query_id",
        "position",
        F.coalesce("content", "text").alias("content"),
        confidence.alias("score"),
        F.when(bare, wrapped).otherwise(F.col("metadata")).alias("metadata"),
    )
