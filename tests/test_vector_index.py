"""The stored vector index."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conftest import SMALL
from lodestar.operators import search as S
from lodestar.operators import vector_index as I
from lodestar.session import shared_folder
from lodestar.workload import load


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=16)]) for i in range(600)] + [(600, None), (601, [0.0] * 16)]
    return spark.createDataFrame(rows, "id long, embedding array<double>")


@pytest.fixture(scope="module")
def index(spark, corpus):
    path = shared_folder(spark, "index-test")
    I.build_index(corpus, path, I.train_books(corpus, cells=8, parts=4, entries=32))
    return I.VectorIndex.open(spark, path)


def test_every_vector_is_indexed(index):
    assert index.codes.count() == index.vectors.count() == 601
    assert index.codes.select("cell").distinct().count() <= 8


def test_all_cells_and_all_rescored_is_exact(index, corpus):
    asked = corpus.where("id < 20").select(F.col("id").alias("query_id"), "embedding")
    got = index.search(asked, 5, nprobe=8, rescored=601)
    want = S.knn(asked, corpus.withColumn("embedding", F.col("embedding").cast("array<float>")), 5)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_query_blocks_find_the_same(index, corpus):
    asked = corpus.where("id < 40").select(F.col("id").alias("query_id"), "embedding")
    one = index.candidates(asked, 7, 3)
    many = index.candidates(asked, 7, 3, block_bytes=1000)
    key = lambda rows: sorted(tuple(r) for r in rows.collect())
    assert key(one) == key(many)


def test_only_probed_cells_are_read(index, corpus):
    asked = corpus.where("id = 5").select(F.col("id").alias("query_id"), "embedding")
    frame, _ = index._scan(asked.toPandas(), index.codes, 5, 2, S.hit_schema(asked.schema["query_id"].dataType, index.codes.schema["id"].dataType).add("cell", T.IntegerType()))
    plan = frame._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(cell" in plan or "PartitionFilters: [cell" in plan
    read = {r["cell"] for r in frame.select("cell").collect()}
    assert len(read) <= 2


def test_books_are_the_same_again(corpus):
    a, b = (I.train_books(corpus, cells=8, parts=4, entries=32) for _ in range(2))
    assert (a.centres == b.centres).all() and (a.books == b.books).all()


def test_other_lengths_are_errors(spark, corpus, index):
    with pytest.raises(ValueError):
        I.train_books(corpus, parts=5)
    with pytest.raises(ValueError):
        I.train_books(corpus.limit(0))
    with pytest.raises(Exception, match="length"):
        I.build_index(spark.createDataFrame([(1, [1.0, 2.0])], "id long, embedding array<double>"), shared_folder(spark, "index-bad"), index.books)


def test_recall_and_bytes(spark):
    for row in load()["e08_index_recall"].run(spark, SMALL).collect():
        assert row["recall"] >= 0.9 and row["bytes_share"] < 1 / 3
