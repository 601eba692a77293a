"""Communities of large modularity."""

import random

import pytest

from lodestar.operators import communities as M
from lodestar.operators import modularity as Q


@pytest.fixture(scope="module")
def edges(spark):
    rng = random.Random(5)
    pairs = {(f"n{g}_{i}", f"n{g}_{j}") for g in range(5) for i in range(7) for j in range(i) if rng.random() < 0.8}
    pairs |= {(f"n{g}_0", f"n{(g + 1) % 5}_0") for g in range(5)} | {("alone", "alone")}
    return spark.createDataFrame(sorted(pairs), "subject string, object string")


def by_hand(pairs, of):
    ways = [(a, b) for a, b in pairs] + [(b, a) for a, b in pairs]
    total = {}
    for a, _ in ways:
        total[of[a]] = total.get(of[a], 0) + 1
    m = len(ways)
    return sum(of[a] == of[b] for a, b in ways) / m - sum(x * x for x in total.values()) / m**2


@pytest.fixture(scope="module")
def found(edges):
    return Q.modular_communities(edges).cache()


def test_planted_groups_are_found(found):
    got = {r.name: r.community_id for r in found.collect()}
    assert got == {n: "alone" if n == "alone" else n[:3] + "0" for n in got} and len(got) == 36


def test_modularity_by_hand_and_against_propagated_labels(edges, found):
    pairs = [tuple(r) for r in edges.collect()]
    ways = Q.weighted_ways(edges)
    labels = M.label_propagation(edges, 3).withColumnRenamed("label", "community_id")
    of = {r.name: r.community_id for r in labels.collect()}
    row = Q.modularity(ways, labels).first()
    assert row["modularity"] == round(by_hand(pairs, of), 6) and row["n_communities"] == len(set(of.values()))
    assert Q.modularity(ways, found).first()["modularity"] >= row["modularity"]


def test_communities_above_the_cap_are_parted_and_repeatable(spark):
    # Two cliques that are tied closely enough to be one at a low resolution.
    pairs = [(f"{c}{i}", f"{c}{j}") for c in "ab" for i in range(4) for j in range(i)] + [("a0", "b0"), ("hub", "leaf1"), ("hub", "leaf2")]
    edges = spark.createDataFrame(pairs, "subject string, object string")
    found = [sorted(map(tuple, Q.modular_communities(e, 4, rounds=4, levels=2).collect())) for e in (edges, edges.repartition(3))]
    assert found[0] == found[1]
    last = {}
    for name, _, community, _ in sorted(found[0], key=lambda r: r[1]):
        last[name] = community
    assert last == {n: "hub" if n[0] in "hl" else n[0] + "0" for n in last} and len(last) == 11
