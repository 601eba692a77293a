"""Upserts that touch only their parts."""

import pytest
from pyspark.sql import functions as F

from lodestar.operators.keyed_store import KeyedStore, changed, index_changed
from lodestar.session import shared_folder


@pytest.fixture
def store(spark):
    store = KeyedStore(spark, shared_folder(spark, "store-test"), "id", "version", parts=8)
    assert store.upsert(spark.createDataFrame([], "id long, version int, text string")) == []
    index_changed(store, spark.range(200).select("id", F.lit(1).alias("version"), F.concat(F.lit("text "), "id").alias("text")), embedder)
    return store


def embedder(text):
    return F.array(F.length(text).cast("float"), F.lit(1.0).cast("float"))


def test_only_touched_parts_are_read_and_written(spark, store):
    updates = spark.createDataFrame([(5, 2, "new"), (5, 3, "newest"), (900, 1, "more"), (7, 0, "older")], "id long, version int, text string")
    parts = store.touched(updates)
    assert 0 < len(parts) < 8
    plan = store.reached(parts)._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "_part" in plan.split("PartitionFilters: [")[1][:60]
    before = {r[0]: r[1] for r in files(spark, store)}
    made = updates.withColumn("text_hash", F.md5("text")).withColumn("vector", embedder(F.col("text")))
    assert store.upsert(made) == parts
    after = {r[0]: r[1] for r in files(spark, store)}
    assert {p for p in after if after[p] != before.get(p)} == set(parts)
    rows = {r.id: (r.version, r.text) for r in store.read().collect()}
    assert len(rows) == 201 and rows[5] == (3, "newest") and rows[900] == (1, "more") and rows[7] == (1, "text 7")
    again = sorted(map(str, store.read().collect()))
    store.upsert(made)
    assert sorted(map(str, store.read().collect())) == again


def files(spark, store):
    named = spark.read.parquet(store.path).select("_part", F.input_file_name().alias("f")).distinct()
    return named.groupBy("_part").agg(F.sort_array(F.collect_set("f")).alias("f")).collect()


def test_unchanged_texts_are_not_embedded(spark, store):
    docs = spark.createDataFrame([(1, 2, "text 1"), (2, 2, "another"), (1000, 2, None)], "id long, version int, text string")
    same, fresh = changed(store, docs)
    assert [r.id for r in same.collect()] == [1] and sorted(r.id for r in fresh.collect()) == [2, 1000]
    index_changed(store, docs, embedder)
    rows = {r.id: (r.version, r.vector) for r in store.read().where("id in (1, 2, 3)").collect()}
    assert rows[1] == (2, [6.0, 1.0]) and rows[2] == (2, [7.0, 1.0]) and rows[3] == (1, [6.0, 1.0])
