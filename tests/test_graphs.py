import random

from pyspark.sql import functions as F

from lodestar.functions.strings import norm_predicate
from lodestar.operators import collections as C
from lodestar.operators import communities as M
from lodestar.operators import graph as G
from lodestar.operators.prefix import prefix_sum

EDGES = "subject string, predicate string, object string, description string"


def test_triplet_lines(spark):
    long = "x" * 129
    lines = [
        "(alice, Works At, acme corp, She works there)",
        "(a, b, c)",
        "(a, b, c, d, e)",
        ") before (",
        "( , b, c, d)",
        f"({long}, b, c, d)",
        '("QUOTED", knows, "bob", "met (twice), once late")',
        "no brackets",
        "(é" + "é" * 63 + ", b, c, exactly 128 bytes)",
    ]
    df = spark.createDataFrame([(1, "\n".join(lines), "long enough text"), (2, lines[0], "short")], "id int, response string, src string")
    strict = G.parse_triplets(df, "id", "response", "strict", "src").orderBy("line_no").collect()
    assert [(r.doc_id, r.line_no, r.subject, r.predicate, r.object) for r in strict][0] == (1, 0, "Alice", "works_at", "Acme corp")
    # The quoted line is cut at its first closing bracket and then has four fields.
    assert [r.line_no for r in strict] == [0, 6, 8] and strict[1].description == "Met (twice"
    lenient = {r.line_no: r for r in G.parse_triplets(df, "id", "response", "lenient", "src").collect()}
    # Five fields are four with a comma in the last one, and one bracket pair may enclose another.
    assert set(lenient) == {0, 2, 6, 8}
    assert lenient[2].description == "D, e"
    assert lenient[6].subject == "Quoted" and lenient[6].description == "Met (twice), once late"


def test_predicates_become_ascii(spark):
    pairs = {"được tạo bởi": "duoc_tao_boi", "Gehört zur Straße": "gehort_zur_strasse", "Ångström": "angstrom", "plain": "plain"}
    df = spark.createDataFrame([(k,) for k in pairs], "p string")
    assert {r.p: r.n for r in df.select("p", norm_predicate(F.col("p")).alias("n")).collect()} == pairs


def test_json_with_noise(spark):
    rows = [
        (1, 'text {"entities":[{"entity_name":"A","entity_type":"t","entity_description":"d"},{"entity_name":"B"}],"relationships":[]} more'),
        (2, "no json"),
        (3, '{"entities": [broken'),
    ]
    ents, rels, bad = G.parse_graph_json(spark.createDataFrame(rows, "id int, x string"), "id", "x")
    assert [r.entity_name for r in ents.collect()] == ["A"] and rels.isEmpty()
    assert [(r.doc_id, r.part) for r in bad.collect()] == [(1, "entities")]


def test_expansion_keeps_edges_without_description_apart(spark):
    edges = spark.createDataFrame([("a", "p", "b", ""), ("c", "q", "a", ""), ("a", "r", "d", "same"), ("e", "s", "a", "same"), ("x", "y", "z", "far")], EDGES)
    seeds = spark.createDataFrame([(1, "a"), (2, "b")], "query_id int, name string")
    rows = G.expand_seeds(seeds, edges).collect()
    assert sorted((r.query_id, r.subject, r.object) for r in rows) == [(1, "a", "b"), (1, "a", "d"), (1, "c", "a"), (2, "a", "b")]


def test_components_of_paths_and_rings(spark):
    rng = random.Random(2)
    parts = [[f"{p}-{i:03d}" for i in range(n)] for p, n in (("long", 120), ("ring", 30), ("pair", 2))]
    pairs = [(a, b) for part in parts for a, b in zip(part, part[1:])] + [(parts[1][0], parts[1][-1])]
    pairs = [(b, a) if rng.random() < 0.5 else (a, b) for a, b in pairs] + [("alone", "alone")]
    edges = spark.createDataFrame([(a, "p", b, "") for a, b in pairs], EDGES)
    got = {r.name: r.component for r in M.connected_components(edges).collect()}
    assert got == {**{n: part[0] for part in parts for n in part}, "alone": "alone"}


def test_communities_cover_all_and_none_can_be_split_further(spark):
    rng = random.Random(4)
    hub = [("hub", f"n{i:03d}") for i in range(80)]  # One node has most edges.
    rest = [(f"n{rng.randrange(80):03d}", f"n{rng.randrange(80):03d}") for _ in range(60)]
    edges = spark.createDataFrame([(a, "p", b, "") for a, b in hub + rest if a != b], EDGES)
    found = M.communities(edges, 5, 2)
    rows = found.collect()
    names = [r.name for r in rows]
    assert sorted(names) == sorted({x for a, b in hub + rest if a != b for x in (a, b)})
    sizes = {}
    for r in rows:
        sizes[r.community_id] = sizes.get(r.community_id, 0) + 1
    for name, size in sizes.items():
        if size > 5:
            members = [r.name for r in rows if r.community_id == name]
            inner = edges.where(F.col("subject").isin(members) & F.col("object").isin(members))
            assert M.label_propagation(inner, 2).select("label").distinct().count() == 1


def test_prefix_sum_by_group(spark):
    rng = random.Random(6)
    rows = [("hot" if i % 3 else f"g{i % 7}", i, rng.randrange(5)) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, o int, v int").repartition(7)
    got = {r.o: r.offset for r in prefix_sum(df, "v", ["o"], ["g"], partitions=6).collect()}
    run, want = {}, {}
    for g, o, v in rows:
        want[o] = run.get(g, 0)
        run[g] = want[o] + v
    assert got == want


def test_loading_twice_changes_nothing(spark):
    rows = [("a", "p", "b", "d", "doc1"), ("a", "p", "c", "", "doc1"), ("b", "p", "c", "d", None)]
    once = spark.createDataFrame(rows, EDGES + ", document_id string")
    for a, b in zip(C.build_graph(once), C.build_graph(once.unionByName(once))):
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_upsert_is_idempotent(spark):
    base = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "id int, v string, ver int")
    delta = spark.createDataFrame([(2, "c", 2), (2, "d", 3), (3, "e", 1), (1, "old", 0)], "id int, v string, ver int")
    once = C.upsert(base, delta, ["id"], "ver")
    assert sorted(map(tuple, once.collect())) == [(1, "a", 1), (2, "d", 3), (3, "e", 1)]
    assert sorted(map(tuple, C.upsert(once, delta, ["id"], "ver").collect())) == sorted(map(tuple, once.collect()))
