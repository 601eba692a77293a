"""Communities of large modularity: local moves, refinement and contraction, in parallel rounds.

After Traag, Waltman and van Eck (2019). A round looks at all nodes at once:
each finds the neighbouring community that gains most; of those that would move,
no two neighbours do (the one with the higher seeded hash goes first), and what
that set gains is measured. Should many nodes that enter one community at once
have cost more than they gained, the round is taken back and only one move for
each community is made, whose gains add up exactly. Then every community is
refined into connected parts, the parts become weighted nodes, and the rounds
start again on the smaller graph. Nodes with one neighbour join it before the
first round: in a best parting they are together, and a hub of many of them is
one node then.

Weights and degrees are sums of whole numbers, so the same graph and seed give
the same communities on any cluster. Each round is written to the shared folder; sums are made
before tables are joined, so a hub is never one task's group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored

_LEAST_GAIN = 1e-9
#: Rounds end when one adds less than this share of the modularity.
_STILL = 1e-3


def weighted_ways(edges: DataFrame) -> DataFrame:
    """(u, v, w) in both directions, parallel edges added up; loops once, as (u, u, 2 w)."""
    pairs = edges.select(F.col("subject").alias("u"), F.col("object").alias("v"))
    both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.groupBy("u", "v").agg(F.count(F.lit(1)).cast("double").alias("w"))


def modularity(ways: DataFrame, membership: DataFrame, resolution: float = 1.0) -> DataFrame:
    """One row: ``modularity``, ``n_communities``, ``largest`` of ``membership`` (name, community_id)."""
    of = membership.select(F.col("name").alias("u"), F.col("community_id").alias("c"))
    degree = ways.groupBy("u").agg(F.sum("w").alias("k"))
    totals = degree.join(of, "u").groupBy("c").agg(F.sum("k").alias("total"), F.count(F.lit(1)).alias("n"))
    inner = ways.join(of, "u").join(of.select(F.col("u").alias("v"), F.col("c").alias("d")), "v").where("c = d").groupBy("c").agg(F.sum("w").alias("inner"))
    found = totals.join(inner, "c", "left")
    all_ = F.sum("total")
    value = F.sum(F.coalesce("inner", F.lit(0.0))) / all_ - resolution * F.sum(F.col("total") * F.col("total")) / (all_ * all_)
    return found.agg(F.round(value, 6).alias("modularity"), F.count(F.lit(1)).alias("n_communities"), F.max("n").alias("largest"))


class _Level:
    """A graph of one contraction: ``ways`` (u, v, w) without loops, ``nodes`` (u, k, two_m): degree, and all degrees of the node's scope."""

    def __init__(self, ways: DataFrame, nodes: DataFrame, resolution: float, seed: int):
        self.ways, self.nodes, self.resolution, self.seed = ways, nodes, resolution, seed
        self.turn = 0

    def _links(self, label: DataFrame, ways: DataFrame) -> tuple[DataFrame, float]:
        """What each node could join and what that is worth, its own community included; and the modularity, but for a constant."""
        of = label.select(F.col("u").alias("v"), "c")
        links = ways.join(of, "v").groupBy("u", "c").agg(F.sum("w").alias("w"))
        own = label.select("u", F.col("c").alias("own")).join(self.nodes, "u")
        links = own.select("u", F.col("own").alias("c"), F.lit(0.0).alias("w")).unionByName(links).groupBy("u", "c").agg(F.sum("w").alias("w"))
        totals = own.groupBy(F.col("own").alias("c")).agg(F.sum("k").alias("total"))
        met = links.join(own, "u").join(totals, "c")
        stays = F.col("c") == F.col("own")
        others = F.col("total") - F.when(stays, F.col("k")).otherwise(0.0)
        met = met.withColumn("worth", F.col("w") - self.resolution * F.col("k") * others / F.col("two_m"))
        met = stored(met.select("u", "c", "own", "worth", (F.col("w") - self.resolution * F.col("k") * F.col("total") / F.col("two_m")).alias("part"), "two_m"))
        value = met.where("c = own").agg(F.sum(F.col("part") / F.col("two_m"))).first()[0]
        return met, value or 0.0

    def _wishes(self, links: DataFrame, may: DataFrame | None) -> DataFrame:
        """(u, own, c, luck): the best move of each node that has one."""
        best = links.groupBy("u").agg(
            F.max(F.when(F.col("c") == F.col("own"), F.col("worth"))).alias("stay"), F.first("own").alias("own"),
            F.min(F.when(F.col("c") != F.col("own"), F.struct((-F.col("worth")).alias("loss"), F.col("c").alias("c")))).alias("best"),
        )
        found = best.where(-F.col("best.loss") > F.col("stay") + _LEAST_GAIN).select("u", "own", F.col("best.c").alias("c"))
        if may is not None:
            found = found.join(may, "u", "left_semi")
        return stored(found.withColumn("luck", F.xxhash64("u", F.lit(self.seed), F.lit(self.turn))))

    def _apart(self, wishes: DataFrame, ways: DataFrame) -> DataFrame:
        """Those of whose neighbours none with more luck moves."""
        mine, other = (wishes.select(F.col("u").alias(a), F.struct("luck", "u").alias(b)) for a, b in (("u", "mine"), ("v", "other")))
        late = ways.join(mine, "u").join(other, "v").where("other > mine").select("u").distinct()
        return wishes.join(late, "u", "left_anti")

    @staticmethod
    def _one_each(wishes: DataFrame) -> DataFrame:
        """At most one move out of or into each community."""
        luck = F.struct("luck", "u")
        first = wishes.select(F.explode(F.array("own", "c")).alias("x"), luck.alias("luck")).groupBy("x").agg(F.max("luck").alias("first"))
        out = wishes.join(first.select(F.col("x").alias("own"), F.col("first").alias("a")), "own").join(first.select(F.col("x").alias("c"), F.col("first").alias("b")), "c")
        return out.where((F.col("a.u") == F.col("u")) & (F.col("b.u") == F.col("u")))

    @staticmethod
    def _moved(label: DataFrame, moves: DataFrame) -> DataFrame:
        return stored(label.join(moves.select("u", F.col("c").alias("to")), "u", "left").select("u", F.coalesce("to", "c").alias("c")))

    def moves(self, label: DataFrame, rounds: int, ways: DataFrame | None = None, singles_only: bool = False) -> tuple[DataFrame, bool]:
        """The communities (u, c) after up to ``rounds`` rounds of moves, and whether any was made."""
        ways = self.ways if ways is None else ways
        links, value = self._links(label, ways)
        any_move = False
        for _ in range(rounds):
            self.turn += 1
            may = None
            if singles_only:
                alone = label.groupBy("c").agg(F.count(F.lit(1)).alias("n"), F.min("u").alias("u")).where("n = 1")
                may = alone.select("u")
            wishes = self._wishes(links, may)
            if wishes.isEmpty():
                break
            apart = self._apart(wishes, ways)
            now = self._moved(label, apart)
            now_links, now_value = self._links(now, ways)
            if now_value < value:
                now = self._moved(label, self._one_each(apart))
                now_links, now_value = self._links(now, ways)
            any_move = True
            gain, label, links, value = now_value - value, now, now_links, now_value
            if gain < _STILL * abs(value):
                break
        return label, any_move


def _alone(nodes: DataFrame) -> DataFrame:
    """Each node a community of its own. The name is made anew: as an alias, a rule of the optimiser would track that both are equal through all rounds."""
    return stored(nodes.select("u", F.concat(F.col("u"), F.lit("")).alias("c")))


def _dealt(names: DataFrame) -> DataFrame:
    """A table with a row for each name is dealt over the tasks and not broadcast: one after the other, all of them would go through the driver."""
    return names.hint("merge")


def _leaves(ways: DataFrame) -> DataFrame:
    """(u, to): nodes whose only way leads to ``to``. Of two that have only each other the larger joins the smaller.

    At a resolution of at most 1 no parting loses modularity when a leaf joins its neighbour's community.
    """
    sole = stored(ways.groupBy("u").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("to")).where("n = 1 and u <> to").select("u", "to"))
    mutual = sole.where("u < to").join(_dealt(sole.select(F.col("to").alias("u"), F.col("u").alias("to"))), ["u", "to"], "left_semi")
    return stored(sole.join(mutual, ["u", "to"], "left_anti"))


def _without_leaves(ways: DataFrame, nodes: DataFrame, leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``ways`` and ``nodes`` with the leaves gone into their neighbours, whose degrees take theirs."""
    ways = ways.join(_dealt(leaves.select("u")), "u", "left_anti").join(_dealt(leaves.select(F.col("u").alias("v"))), "v", "left_anti").select("u", "v", "w")
    dealt = nodes.join(_dealt(leaves), "u", "left").select(F.coalesce("to", "u").alias("u"), "k", "two_m")
    return stored(ways), stored(dealt.groupBy("u").agg(F.sum("k").alias("k"), F.max("two_m").alias("two_m")))


def _optimised(ways: DataFrame, scope: DataFrame, rounds: int, levels: int, resolution: float, seed: int) -> DataFrame:
    """(name, community_id) over all scopes (name, scope) at once; ``ways`` run inside scopes only."""
    degree = ways.groupBy("u").agg(F.sum("w").alias("k"))
    nodes = scope.select(F.col("name").alias("u"), "scope").join(_dealt(degree), "u", "left").select("u", "scope", F.coalesce("k", F.lit(0.0)).alias("k"))
    totals = nodes.groupBy("scope").agg(F.greatest(F.sum("k"), F.lit(1.0)).alias("two_m"))
    nodes = stored(nodes.join(totals, "scope").select("u", "k", "two_m"))
    member = scope.select("name", F.col("name").alias("u"))
    if resolution <= 1.0:
        leaves = _leaves(ways)
        ways, nodes = _without_leaves(ways.where("u <> v"), nodes, leaves)
        member = stored(member.join(_dealt(leaves), "u", "left").select("name", F.coalesce("to", "u").alias("u")))
    else:
        ways = stored(ways.where("u <> v"))
    label = _alone(nodes)
    for level in range(levels):
        graph = _Level(ways, nodes, resolution, seed + 1000 * level)
        label, moved = graph.moves(label, rounds)
        if not moved:
            break
        of = label.select("u", F.col("c").alias("cu"))
        inside = stored(ways.join(of, "u").join(of.select(F.col("u").alias("v"), F.col("cu").alias("cv")), "v").where("cu = cv").select("u", "v", "w"))
        part, _ = graph.moves(_alone(label), rounds, inside, singles_only=True)
        # Parts become nodes, named by their smallest; each starts in the community it is a part of.
        names = part.groupBy("c").agg(F.min("u").alias("to"))
        part = stored(part.join(names, "c").select("u", "to"))
        member = stored(member.join(part, "u").select("name", F.col("to").alias("u")))
        nodes = stored(nodes.join(part, "u").groupBy(F.col("to").alias("u")).agg(F.sum("k").alias("k"), F.max("two_m").alias("two_m")))
        ends = ways.join(part, "u").withColumnRenamed("to", "a").join(part.select(F.col("u").alias("v"), F.col("to").alias("b")), "v")
        ways = stored(ends.where("a <> b").groupBy(F.col("a").alias("u"), F.col("b").alias("v")).agg(F.sum("w").alias("w")))
        label = stored(label.join(part, "u").select(F.col("to").alias("u"), "c").distinct())
    found = member.join(label, "u").select("name", "c")
    least = found.groupBy("c").agg(F.min("name").alias("community_id"))
    return stored(found.join(least, "c").select("name", "community_id"))


def modular_communities(edges: DataFrame, max_size: int | None = None, rounds: int = 8, levels: int = 6, resolution: float = 1.0, seed: int = 11) -> DataFrame:
    """(name, level, community_id, parent_id): communities of ``edges`` (subject, object), named by their smallest member.

    Level 0 parts the whole graph. With ``max_size``, each community above it is
    parted again for itself, as a graph of its own, on the next level, and so on;
    one that does not fall apart is larger than the cap and stays. The last level
    of a name is its community in the end (``last_level``).
    """
    ways = stored(weighted_ways(edges))
    scope = stored(ways.select(F.col("u").alias("name")).distinct().withColumn("scope", F.lit("")))
    out, level = None, 0
    while True:
        found = _optimised(ways, scope, rounds, levels, resolution, seed + level)
        rows = found.join(_dealt(scope), "name").select("name", F.lit(level).alias("level"), "community_id", F.col("scope").alias("parent_id"))
        if level:
            # A community that stayed whole is not a level of its own.
            number = rows.groupBy("parent_id").agg(F.min("community_id").alias("_a"), F.max("community_id").alias("_b")).where("_a <> _b").select("parent_id")
            rows = stored(rows.join(number, "parent_id", "left_semi").select("name", "level", "community_id", "parent_id"))
        out = rows if out is None else out.unionByName(rows)
        if max_size is None:
            return out
        big = rows.groupBy("community_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max_size).select("community_id")
        scope = stored(rows.join(big, "community_id", "left_semi").select("name", F.col("community_id").alias("scope")))
        if scope.isEmpty():
            return out
        at = scope.select(F.col("name").alias("u"), F.col("scope").alias("a"))
        ways = stored(ways.join(_dealt(at), "u").join(_dealt(at.select(F.col("u").alias("v"), F.col("a").alias("b"))), "v").where("a = b").select("u", "v", "w"))
        level += 1


def last_level(hierarchy: DataFrame) -> DataFrame:
    """(name, community_id): of each name the community on its deepest level."""
    return hierarchy.groupBy("name").agg(F.max_by("community_id", "level").alias("community_id"))
