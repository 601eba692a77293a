"""The stored inverted index against the scan of the whole corpus."""

import random

import pytest
from pyspark.sql import functions as F

from lodestar.operators import inverted_index as N
from lodestar.operators import rerank as R
from lodestar.session import shared_folder


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(["the"] * rng.randrange(1, 4) + rng.choices(words, [1 / (j + 1) for j in range(40)], k=rng.randrange(1, 60)))) for i in range(900)]
    return spark.createDataFrame(rows + [(900, None), (901, ""), (902, "ONLY here")], "doc_id long, text string").repartition(3)


@pytest.fixture(scope="module")
def index(spark, docs):
    path = shared_folder(spark, "text-index")
    N.build_index(docs, path, block_docs=64)
    return N.TextIndex.open(spark, path)


def test_equal_to_the_scan(spark, docs, index):
    # "the" stands in nearly all documents: its idf is negative, and the floor counts.
    asked = spark.createDataFrame([(1, "the"), (2, "w39 w38"), (3, "only"), (4, "unknown words"), (5, "w1 w1 the w7"), (6, "")], "query_id long, text string")
    for k in (3, 950):
        got = sorted(map(tuple, index.search(asked, k).collect()))
        want = sorted(map(tuple, R.bm25_corpus(asked, docs, k).collect()))
        assert got == want
    assert {r[0] for r in got} == {1, 2, 3, 4, 5, 6}


def test_statistics_are_stored(docs, index):
    want = R.corpus_statistics(docs)
    assert index.statistics.n == want.n and abs(index.statistics.mean_length - want.mean_length) < 1e-9 and abs(index.statistics.floor - want.floor) < 1e-9
    assert sorted(map(tuple, index.statistics.terms.collect())) == sorted(map(tuple, want.terms.collect()))


def test_bounds_hold_and_most_blocks_are_left_out(spark, docs, index):
    asked = spark.createDataFrame([(1, "only here"), (2, "w39 w35")], "query_id long, text string")
    terms = index.weighted(asked, "text").cache()
    bounds = {(r.query_id, r.block): r.bound for r in index.bounds(terms).collect()}
    every = terms.select("query_id").distinct().withColumn("block", F.explode(F.array(*(F.lit(b) for b in {b for _, b in bounds}))))
    for row in index._scored(every, terms, 1).join(index.blocks.select("block", F.explode("ids").alias("id")), "id").collect():
        if (row.query_id, row.block) in bounds:
            assert row.score <= bounds[row.query_id, row.block] + 1e-6
    assert sum(1 for q, _ in bounds if q == 1) < index.blocks.count()
