"""Mixing sources to target weights, in DataFrame operations only.

Words are summed by source; a source's rate is its target over its words. Each
document is taken floor(rate) times, and once more if its hash, read as a number
between 0 and 1, is below the rest of the rate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.prefix import prefix_sum
from .base import durable

WEIGHTS = (5, 2, 1)
#: Bytes of source names up to which the table of rates is sent to all tasks; a larger one is joined by shuffling.
BROADCAST_BYTES = 4 << 20


def text_size(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def coin(doc_id: Column, text: Column, seed: str) -> Column:
    """A number in [0, 1) that depends on the document alone."""
    hexed = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("|"), F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(hexed, 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def source_targets(sizes: DataFrame, share_percent: int = 150, most: int = 2, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """``source``, ``source_size``, ``target`` for ``sizes`` (``source``, ``size``).

    Sources in code point order (NULL last) get the weights in turn and share
    ``share_percent`` of all words. No target passes ``most`` times its source;
    the excess is shared again by weight among the others until none does. Where
    even that many times all sources falls short, every source gets its most.
    A source without words has the target 0.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = prefix_sum(sources.withColumns({"_one": F.lit(1), "_null": F.col("source").isNull()}), "_one", ["_null", "source"], out="_rank")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("_rank") % len(weights) + 1).cast("int"))
    table = durable(ranked.select("source", "source_size", weight.cast("long").alias("weight"), (F.col("source_size") * most).alias("most")))
    total = table.agg(F.sum("source_size")).first()[0] or 0
    level, done = None, -1
    while True:  # each round finds sources that reach their most, or is the last
        full = F.lit(False) if level is None else F.col("weight") * F.lit(level) >= F.col("most")
        used, rest, count = table.agg(F.sum(F.when(full, F.col("most"))), F.sum(F.when(~full, F.col("weight"))), F.count(F.when(full, 1))).first()
        if count == done or not rest:
            break
        done, level = count, (total * share_percent / 100 - (used or 0)) / rest
    share = F.lit(0.0) if level is None else F.col("weight") * F.lit(level)
    return table.select("source", "source_size", F.least(share, F.col("most").cast("double")).alias("target"))


def mixing_plan(docs: DataFrame, share_percent: int = 150, most: int = 2, weights: tuple[int, ...] = WEIGHTS, seed: str = "mix") -> DataFrame:
    """``docs`` (``doc_id``, ``text``, ``source``) with ``_size``, ``_source_size``, ``_target``, ``_copies``.

    A NULL or empty text has size 0; rows without source are a source of their
    own. Equal rows get equal copies; a row without doc_id is told apart by its
    text. In a source without words nothing is taken. Columns of those four names,
    and of ``_source_size_of``, are replaced.
    """
    docs = docs.drop("_size", "_source_size", "_source_size_of", "_target", "_copies").withColumn("_size", text_size(F.col("text")))
    targets = source_targets(docs.select("source", F.col("_size").alias("size")), share_percent, most, weights)
    targets = durable(targets.select(F.struct(F.col("source").alias("name")).alias("_source_size_of"), F.col("source_size").alias("_source_size"), F.col("target").alias("_target")))
    size = targets.agg(F.sum(F.coalesce(F.octet_length("_source_size_of.name"), F.lit(0)) + 32)).first()[0] or 0
    side = F.broadcast(targets) if size <= BROADCAST_BYTES else targets
    rate = F.when(F.col("_source_size") > 0, F.col("_target") / F.col("_source_size")).otherwise(F.lit(0.0))
    once = (coin(F.col("doc_id"), F.col("text"), seed) < rate - F.floor(rate)).cast("long")
    joined = docs.join(side, docs["source"].eqNullSafe(side["_source_size_of"]["name"]))
    return joined.withColumn("_copies", F.floor(rate) + once).drop("_source_size_of")


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The documents of the mix, each as often as it is taken, with a number for each copy in ``copy`` (a column of that name is replaced)."""
    plan = mixing_plan(docs, **how).where("_copies > 0")
    return plan.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).drop("_size", "_source_size", "_target", "_copies")
