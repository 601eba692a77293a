"""Indexing a changed delivery moves its texts no more often than needed, and a part that was not read is not overwritten."""

import pytest
from pyspark.sql import functions as F

from lodestar.operators import keyed_store
from lodestar.operators.keyed_store import KeyedStore, index_changed
from lodestar.session import shared_folder


def embedder(text):
    return F.when(text.isNull(), F.array(F.lit(-1.0).cast("float"))).otherwise(F.array(F.length(text).cast("float")))


@pytest.fixture
def store(spark):
    store = KeyedStore(spark, shared_folder(spark, "moves-test"), "id", "version", parts=8)
    index_changed(store, spark.range(50).select("id", F.lit(1).alias("version"), F.concat(F.lit("text "), "id").alias("text")), embedder)
    return store


def test_texts_are_stored_once_before_they_are_written(spark, store, monkeypatch):
    kept = []
    monkeypatch.setattr(keyed_store, "durable", lambda df, real=keyed_store.durable: kept.append(df.columns) or real(df))
    docs = spark.createDataFrame([(1, 2, "text 1"), (2, 2, "another"), (99, 2, None), (2, 3, "the last"), (3, 0, "older")], "id long, version int, text string")
    index_changed(store, docs, embedder)
    assert len([c for c in kept if "text" in c]) == 1
    rows = {r.id: (r.version, r.text, r.vector) for r in store.read().collect()}
    assert len(rows) == 51 and rows[1] == (2, "text 1", [6.0]) and rows[2] == (3, "the last", [8.0]) and rows[3] == (1, "text 3", [6.0])
    assert rows[99] == (2, None, [-1.0])


def test_a_key_outside_the_parts_stops_the_write(spark, store):
    before = sorted(map(str, store.read().collect()))
    docs = spark.createDataFrame([(i, 2, "new") for i in range(50)], "id long, version int, text string")
    made = docs.withColumn("text_hash", F.md5("text")).withColumn("vector", embedder(F.col("text")))
    with pytest.raises(Exception, match="outside the parts"):
        store.upsert(made, [0])
    assert sorted(map(str, store.read().collect())) == before
