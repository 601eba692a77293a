"""Communities of an undirected graph by repeated joins and aggregations.

Each round is checkpointed, so lineage stays short and a lost executor costs at
most one round. Minima and counts are aggregated before they are joined back; a
hub with a third of all edges never becomes one task's group.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import durable


def both_ways(edges: DataFrame) -> DataFrame:
    """Every edge in both orientations as (src, dst); parallel edges stay."""
    forward = edges.select(F.col("subject").alias("src"), F.col("object").alias("dst"))
    return forward.unionByName(forward.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("subject", "object")).alias("name")).distinct()


def _fingerprint(pairs: DataFrame) -> tuple:
    row = pairs.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first()
    return tuple(row)


def _large_star(pairs: DataFrame) -> DataFrame:
    around = pairs.select("u", "v").unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return around.where(F.col("v") > F.col("u")).join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(pairs: DataFrame) -> DataFrame:
    down = pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(low, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select("u", F.col("m").alias("v"))).where(F.col("u") != F.col("v")).distinct()


def connected_components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(name, component) with the smallest member name as component.

    Alternates the large-star and small-star steps of Kiveris et al. (2014),
    which shorten every path at once, so the number of rounds grows with the
    logarithm of the graph's size, not with its diameter.
    """
    pairs = edges.select(F.col("subject").alias("u"), F.col("object").alias("v")).where("u <> v").distinct()
    pairs = durable(pairs)
    before = _fingerprint(pairs)
    for _ in range(max_rounds):
        pairs = durable(_small_star(_large_star(pairs)))
        after = _fingerprint(pairs)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    names = nodes_of(edges)
    roots = pairs.groupBy("u").agg(F.min("v").alias("component"))
    return names.join(roots, names["name"] == roots["u"], "left").select("name", F.coalesce("component", "name").alias("component"))


def label_propagation(edges: DataFrame, rounds: int = 3, labels: DataFrame | None = None) -> DataFrame:
    """(name, label) after ``rounds`` synchronous rounds: the commonest label among the neighbours, ties to the smallest."""
    ways = durable(both_ways(edges).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("weight")))
    names = nodes_of(edges)
    labels = names.withColumn("label", F.col("name")) if labels is None else labels
    for _ in range(rounds):
        sent = ways.join(labels.select(F.col("name").alias("src"), "label"), "src")
        votes = sent.groupBy("dst", "label").agg(F.sum("weight").alias("votes"))
        won = votes.groupBy("dst").agg(F.min_by("label", F.struct(-F.col("votes"), F.col("label"))).alias("won"))
        labels = labels.join(won, labels["name"] == won["dst"], "left").select("name", F.coalesce("won", "label").alias("label"))
        labels = durable(labels)
    return labels


def communities(edges: DataFrame, max_size: int = 5, rounds: int = 3) -> DataFrame:
    """(name, community_id): label propagation, repeated inside communities above ``max_size``.

    It ends when none of those falls apart any more. What is still too large then
    hangs together too closely to be split, and stays one community.
    """
    current = label_propagation(edges, rounds).select("name", F.col("label").alias("community_id"))
    before = -1
    while True:
        sizes = durable(current.groupBy("community_id").agg(F.count(F.lit(1)).alias("n")))
        # Each repetition makes more communities or is the last one.
        number = sizes.count()
        big = sizes.where(F.col("n") > max_size).select("community_id")
        if number == before or big.isEmpty():
            return current
        before = number
        inside = current.join(big, "community_id", "left_semi")
        a = inside.select(F.col("name").alias("subject"), F.col("community_id").alias("ca"))
        b = inside.select(F.col("name").alias("object"), F.col("community_id").alias("cb"))
        sub = durable(edges.select("subject", "object").join(a, "subject").join(b, "object").where("ca = cb").select("subject", "object"))
        # A member without an edge to another one stands alone. A community whose members
        # all got one label keeps its name.
        split = inside.join(label_propagation(sub, rounds), "name", "left").withColumn("label", F.coalesce("label", "name"))
        parts = split.groupBy("community_id").agg(F.min("label").alias("_low"), F.max("label").alias("_high"))
        split = split.join(parts.where("_low <> _high"), "community_id").select(
            "name", F.concat_ws("/", "community_id", "label").alias("_part")
        )
        current = durable(
            current.join(split, "name", "left").select("name", F.coalesce("_part", "community_id").alias("community_id"))
        )


def community_details(membership: DataFrame, edges: DataFrame) -> DataFrame:
    """One row per detail line ``member -> neighbour -> relation -> description``.

    The lines stay rows: a community around a hub may have as many lines as the
    graph has edges. ``details_text`` joins lists that are known to be short.
    """
    out = edges.select(F.col("subject").alias("name"), F.col("object").alias("neighbour"), "predicate", "description")
    back = edges.select(F.col("object").alias("name"), F.col("subject").alias("neighbour"), "predicate", "description")
    line = F.concat_ws(" -> ", "name", "neighbour", "predicate", F.coalesce("description", F.lit("")))
    return (
        out.unionByName(back)
        .join(membership, "name")
        .select("community_id", "name", "neighbour", line.alias("detail"))
        .distinct()
    )


def details_text(details: DataFrame, n: int, order: list[Column]) -> DataFrame:
    """The first ``n`` lines of each community as one text that ends in a full stop."""
    w = Window.partitionBy("community_id").orderBy(*order)
    top = details.withColumn("_i", F.row_number().over(w)).where(F.col("_i") <= n)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("_i", "detail"))), lambda e: e["detail"])
    return top.groupBy("community_id").agg(F.concat(F.array_join(lines, "\n"), F.lit(".")).alias("summary"))


def summarise_communities(details: DataFrame, edges: DataFrame, n: int = 3, summariser: Callable[[Column], Column] | None = None) -> DataFrame:
    """Extractive summary: the ``n`` lines whose two ends have the most edges. ``summariser`` may rewrite the text."""
    degree = both_ways(edges).groupBy("src").agg(F.count(F.lit(1)).alias("degree"))
    a = degree.select(F.col("src").alias("name"), F.col("degree").alias("_da"))
    b = degree.select(F.col("src").alias("neighbour"), F.col("degree").alias("_db"))
    weighed = details.join(a, "name").join(b, "neighbour").withColumn("centrality", F.col("_da") + F.col("_db"))
    text = details_text(weighed, n, [F.col("centrality").desc(), F.col("detail")])
    return text.withColumn("summary", summariser(F.col("summary"))) if summariser else text


def community_retrieve(mentions: DataFrame, membership: DataFrame, summaries: DataFrame) -> DataFrame:
    """Summaries of the communities that a query's entities belong to."""
    ids = mentions.join(membership, "name").select("query_id", "community_id").distinct()
    return ids.join(summaries, "community_id")
