"""Keyed collections: upsert, point lookup, indexing and graph loading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the first by ``order``, which should be total."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def upsert(base: DataFrame, updates: DataFrame, keys: list[str], order_col: str) -> DataFrame:
    """Union in which the highest ``order_col`` per key wins; updates win ties.

    Of several updates with the same ``order_col`` the one with the greatest hash
    of its whole row wins, whatever the order of the input. ``row_number() = 1`` lets the planner keep one candidate per key on the map
    side, so a key written many times does not pile up in one task.
    """
    both = base.withColumn("_src", F.lit(0)).unionByName(updates.withColumn("_src", F.lit(1)))
    # Maps have no hash and no order: their sorted entries stand for them.
    whole = [F.array_sort(F.map_entries(F.col(c))) if _is_map(base, c) else F.col(c) for c in base.columns]
    order = [F.col(order_col).desc(), F.col("_src").desc(), F.xxhash64(*whole).desc()]
    return latest_per_key(both, keys, order).drop("_src")


def _is_map(df: DataFrame, name: str) -> bool:
    return df.schema[name].dataType.typeName() == "map"


def get_by_ids(collection: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return collection.join(ids.select(key), key, "left_semi")


def check_dimension(collection: DataFrame, vec_col: str, dim: int) -> DataFrame:
    """Rows whose vector does not have the collection's dimension."""
    return collection.where(F.size(vec_col) != dim)


def index_documents(docs: DataFrame, embedder, collection: DataFrame | None, id_col: str, text_col: str, version: Column) -> DataFrame:
    """Embed documents and upsert them into a collection of (id, vector, payload, version).

    ``text`` goes into the payload unless the payload brings its own.
    """
    payload = F.col("metadata") if "metadata" in docs.columns else F.create_map().cast("map<string,string>")
    with_text = F.when(
        F.array_contains(F.map_keys(payload), "text"), payload
    ).otherwise(F.map_concat(payload, F.create_map(F.lit("text"), F.col(text_col))))
    points = docs.select(
        F.col(id_col).cast("string").alias("id"),
        embedder(F.col(text_col)).alias("vector"),
        with_text.alias("payload"),
        version.alias("version"),
    )
    if collection is None:
        collection = points.limit(0)
    return upsert(collection, points, ["id"], "version")


def build_graph(triplets: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Triplets (subject, predicate, object, description, document_id) → entities, edges, provenance.

    Rows are distinct, so loading the same triplets twice changes nothing.
    """
    entities = (
        triplets.select(F.explode(F.array("subject", "object")).alias("name")).where(F.col("name").isNotNull()).distinct()
    )
    edges = triplets.select("subject", "predicate", "object", "description").distinct()
    provenance = (
        triplets.where(F.col("document_id").isNotNull())
        .select(F.explode(F.array("subject", "object")).alias("name"), "document_id")
        .distinct()
    )
    return entities, edges, provenance


def attach_embeddings(target: DataFrame, vectors: DataFrame, keys: list[str], vec_col: str = "embedding") -> DataFrame:
    """Update ``target``'s vectors by key. Null or empty keys and vectors are left out."""
    usable = vectors.where(F.coalesce(F.size(vec_col), F.lit(0)) > 0)
    for key in keys:
        usable = usable.where(F.coalesce(F.col(key), F.lit("")) != "")
    usable = usable.groupBy(*keys).agg(F.min(F.col(vec_col)).alias("_new"))
    old = F.col(vec_col) if vec_col in target.columns else F.lit(None)
    joined = target.join(usable, keys, "left")
    return joined.withColumn(vec_col, F.coalesce(F.col("_new"), old)).drop("_new")


def attach_counts(target: DataFrame, vectors: DataFrame, keys: list[str], vec_col: str = "embedding") -> DataFrame:
    """One row: offered, skipped, updated and unmatched vectors."""
    bad = F.coalesce(F.size(vec_col), F.lit(0)) <= 0
    for key in keys:
        bad = bad | (F.coalesce(F.col(key), F.lit("")) == "")
    known = target.select(*keys).distinct().withColumn("_known", F.lit(True))
    return (
        vectors.withColumn("_bad", bad)
        .join(known, keys, "left")
        .agg(
            F.count(F.lit(1)).alias("offered"),
            F.count_if("_bad").alias("skipped"),
            F.count_if(~F.col("_bad") & F.col("_known").isNotNull()).alias("updated"),
            F.count_if(~F.col("_bad") & F.col("_known").isNull()).alias("unmatched"),
        )
    )
