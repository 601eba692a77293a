"""Nodes with one neighbour join it before the rounds of modularity communities."""

from lodestar.operators import modularity as Q


def test_leaves_join_their_neighbour(spark):
    pairs = [("hub", f"x{i}") for i in range(5)] + [("hub", "far"), ("far", "y"), ("far", "hub"), ("b", "a"), ("loop", "loop"), ("z", "z"), ("z", "hub")]
    ways = Q.weighted_ways(spark.createDataFrame(pairs, "subject string, object string"))
    got = {r.u: r.to for r in Q._leaves(ways).collect()}
    assert got == {f"x{i}": "hub" for i in range(5)} | {"y": "far", "b": "a"}


def test_a_hub_of_leaves_is_one_node_in_the_rounds(spark, monkeypatch):
    sizes, moves = [], Q._Level.moves

    def counted(self, label, *more, **named):
        sizes.append(self.nodes.count())
        return moves(self, label, *more, **named)

    monkeypatch.setattr(Q._Level, "moves", counted)
    pairs = [(f"h{h}", f"l{h}_{i}") for h in range(3) for i in range(40)] + [("h0", "h1"), ("h1", "h2"), ("h2", "h0")]
    found = Q.modular_communities(spark.createDataFrame(pairs, "subject string, object string"))
    rows = {r.name: r.community_id for r in found.collect()}
    assert len(rows) == 123 and all(rows[f"l{h}_{i}"] == f"h{h}" for h in range(3) for i in range(40))
    assert max(sizes) == 3


def test_no_leaf_is_forced_at_a_high_resolution(spark):
    pairs = [("hub", f"x{i}") for i in range(6)]
    edges = spark.createDataFrame(pairs, "subject string, object string")
    assert Q.modular_communities(edges, resolution=6.0).select("community_id").distinct().count() > 1
    assert Q.modular_communities(edges).select("community_id").distinct().count() == 1
