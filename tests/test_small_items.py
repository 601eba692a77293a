"""Triplet parsers, mentions in any script, prefixes as arguments, sketches."""

import pytest
from pyspark.sql import functions as F

from lodestar.functions.triplet_parser import bracketed, parsed, register_triplet_parser
from lodestar.operators import conversations as V
from lodestar.operators import fusion as U
from lodestar.operators import graph as G


def test_a_parser_of_ones_own_is_a_table_function(spark):
    spark.createDataFrame([("a", "x=is=y\nno\nHà Nội=là của=việt nam"), ("b", None), ("c", "1=2=3=4")], "id string, text string").createOrReplaceTempView("own_texts")

    def equals(text):
        for number, line in enumerate(text.split("\n")):
            parts = line.split("=")
            if len(parts) == 3:
                yield number, [*parts, ""]

    register_triplet_parser(spark, "equals_triplets", equals)
    rows = sorted(map(tuple, parsed(spark, "equals_triplets", "own_texts", "id", "text").collect()))
    assert rows == [("a", 0, "X", "is", "Y", ""), ("a", 2, "Hà nội", "la_cua", "Việt nam", "")]
    register_triplet_parser(spark, "plain_triplets", bracketed)
    with pytest.raises(Exception, match="no column"):
        parsed(spark, "plain_triplets", "own_texts", "id", "nothing").collect()


def test_column_form_and_limits(spark):
    long = "d" * 200
    rows = spark.createDataFrame([(1, f"(a, b, c, {long})\n(q, r, s, t), (x)\n( , b, c, d)\n(a, b, c)\n(a,b,c,d,e)")], "id int, text string")
    strict = rows.select(F.inline(G.triplets_of(G.triplet_fields(F.col("text"))))).collect()
    assert [(r.line_no, r.subject) for r in strict] == [(1, "Q")]
    free = rows.select(F.inline(G.triplets_of(G.triplet_fields(F.col("text"), "lenient", None)))).collect()
    assert [(r.line_no, r.description) for r in free] == [(0, "D" + long[1:]), (1, "T), (x"), (4, "D,e")]
    with pytest.raises(ValueError):
        G.triplet_fields(F.col("text"), "other")


def test_mentions_of_any_script(spark):
    text = "Lan -> làm việc ở -> Hà Nội\r\nbad -> 12 -> line\nA -> b\nx -> y -> z -> w\n  Москва -> столица -> Россия \n-> a -> b\nA1 -> knows -> A1"
    found = G.entity_mentions(spark.createDataFrame([(1, text), (2, None)], "id int, text string"), "id", "text")
    assert sorted(r.name for r in found.collect()) == sorted(["Lan", "Hà Nội", "Москва", "Россия", "A1"])


def test_prefix_or_whole(spark):
    docs = spark.createDataFrame([(1, "a" * 100 + "x"), (2, "a" * 100 + "y"), (3, "A" * 100 + "X "), (4, None)], "id int, content string")
    ids = lambda prefix: sorted(r.id for r in U.dedup_prefix_global(docs, "id", prefix).collect())
    assert ids(100) == [1, 4] and ids(None) == [1, 2, 4] and ids(101) == [1, 2, 4]


def test_sketches_merge_over_any_span(spark):
    events = spark.range(4000).select(F.timestamp_seconds(1_700_000_000 + F.col("id") * 5).alias("ts"), ((F.col("id") * 7919) % 4000 / 10.0).alias("seconds"))
    kept = V.latency_sketches(events, "ts", "seconds").cache()
    assert kept.count() == 6
    row = V.merged_quantiles(kept, [0.5, 0.95]).first()
    assert row.n == 4000 and abs(row.p50 - 200) < 8 and abs(row.p95 - 380) < 8
    days = V.merged_quantiles(kept, [0.5], [F.date_trunc("day", "span").alias("day")]).collect()
    assert sum(r.n for r in days) == 4000
    assert abs(V.rank_of(kept, 100.0).first().rank - 0.25) < 0.02
