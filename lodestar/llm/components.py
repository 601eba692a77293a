"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import durable

#: Edges that one partition holds between rounds, so that few edges make few files.
EDGES_PER_PARTITION = 200_000


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join the same vertices as those given do: each vertex but the smallest of its component to that one."""
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    label = np.arange(len(names))
    while True:
        least = np.minimum(label[u], label[v])
        if (label[u] == least).all() and (label[v] == least).all():
            break
        np.minimum.at(label, label[u], least)
        np.minimum.at(label, label[v], least)
        while (label[label] != label).any():
            label = label[label]
    moved = np.flatnonzero(label != np.arange(len(names)))
    return names[moved], names[label[moved]]


def _contracted(batches):
    """The edges of a partition, about ``EDGES_PER_PARTITION``, as stars."""
    held = [(batch.column(0).to_numpy(), batch.column(1).to_numpy()) for batch in batches]
    if held:
        a, b = stars(*(np.concatenate(x) for x in zip(*held)))
        yield pa.record_batch({"a": pa.array(a), "b": pa.array(b)})


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Point the neighbours of every vertex at the smallest of them (or the vertex).

    Large: the neighbours above the vertex. Small: those below it, and itself.
    A hub's neighbours are never gathered: the least one is a partial sum, and
    the join back can be split.
    """
    if large:
        around = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).toDF("v", "u")
    else:
        around = edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u"))
    least = around.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("m"))
    joined = around.join(least, "v")
    if large:
        out = joined.where(F.col("u") > F.col("v")).select("u", "m")
    else:
        out = joined.select("u", "m").union(least.select("v", "m"))
    return out.toDF("a", "b").where(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``v``, ``component``: for each vertex of edges (``a``, ``b``) the smallest one it is connected with.

    Edges that one partition holds are contracted there at once. Of more, each round
    writes its edges to the checkpoint folder, every partition of them is contracted by
    itself first, and the end is reached when they are stars: each vertex has one edge
    down, to one that has none. Self-loops and repeated edges do no harm; an empty table
    gives an empty one.
    """
    now = durable(edges.select("a", "b").where(F.col("a") != F.col("b")).distinct())
    if now.count() <= EDGES_PER_PARTITION:
        now = durable(now.coalesce(1).mapInArrow(_contracted, "a long, b long"))
        return now.select(F.col("a").alias("v"), F.col("b").alias("component")).union(now.select("b", "b").distinct())
    while True:
        ends = now.select(F.col("a").alias("v"), F.lit(1).alias("down"), F.lit(0).alias("up")).union(now.select("b", F.lit(0), F.lit(1)))
        degrees = ends.groupBy("v").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
        rows, odd = degrees.agg(F.sum("down"), F.count(F.when((F.col("down") > 1) | ((F.col("down") > 0) & (F.col("up") > 0)), 1))).first()
        # Every edge points down once it has been through a star; before that it may not.
        if not rows or (not odd and now.where("a < b").isEmpty()):
            return now.select(F.col("a").alias("v"), F.col("b").alias("component")).union(now.select("b", "b").distinct())
        parts = -(-rows // EDGES_PER_PARTITION)
        local = now.coalesce(parts).mapInArrow(_contracted, "a long, b long")  # a vertex of several partitions has an edge in each
        now = durable(local if parts == 1 else _star(_star(local, True), False))


def merged(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """Labels (``v``, ``component``) after new links (``a``, ``b``), of whose components only are looked at."""
    if labels is None:
        return durable(components(links))
    for end in ("a", "b"):
        side = labels.select(F.col("v").alias(end), F.col("component").alias(f"_{end}"))
        links = links.join(side, end, "left").withColumn(f"_{end}", F.coalesce(f"_{end}", end))
    links = durable(links)
    found = components(links.select(F.col("_a").alias("a"), F.col("_b").alias("b")))
    every = labels.union(links.select("a", "_a")).union(links.select("b", "_b")).distinct()
    now = every.join(found.toDF("component", "_now"), "component", "left")
    return durable(now.select("v", F.coalesce("_now", "component").alias("component")))
