"""Embedding texts, with reuse of vectors that are already known."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.pieces import text_function
from ..functions.strings import is_blank
from ..session import durable

MEMO = 200_000


class _Slots(dict):
    """Token → slot; slots of negative tokens are shifted by ``dim``."""

    def __init__(self, dim: int):
        super().__init__()
        self.dim = dim

    def __missing__(self, token: str) -> int:
        digest = hashlib.md5(token.encode("utf-8")).hexdigest()
        slot = int(digest[:8], 16) % self.dim + (self.dim if int(digest[8], 16) % 2 else 0)
        self[token] = slot
        return slot


def hashed_vectors(texts: list[str | None], dim: int, slots: _Slots | None = None) -> np.ndarray:
    """Signed feature hashing (Weinberger et al. 2009), unit length, blank → zeros.

    A lower-cased token's md5 gives its slot (first eight hex digits modulo
    ``dim``) and its sign (ninth digit even or odd).
    """
    slots = _Slots(dim) if slots is None else slots
    out = np.zeros((len(texts), dim))
    for row, text in enumerate(texts):
        tokens = text.lower().split() if text else ()
        if tokens:
            counts = np.bincount([slots[token] for token in tokens], minlength=2 * dim)
            out[row] = counts[:dim] - counts[dim:]
    size = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, size, out=np.zeros_like(out), where=size > 0)


def hash_embedder(dim: int = 64) -> Callable[[Column], Column]:
    def start() -> Callable[[list[str | None]], pa.Array]:
        slots = _Slots(dim)

        def vectors(texts: list[str | None]) -> pa.Array:
            made = hashed_vectors(texts, dim, slots).astype(np.float32)
            if len(slots) > MEMO:  # Bounds the memo's memory, not the result.
                slots.clear()
            return pa.ListArray.from_arrays(np.arange(0, made.size + 1, dim, dtype=np.int32), made.ravel())

        return vectors

    return text_function("array<float>", start)


def model_embedder(load: Callable[[], Callable[[list[str]], np.ndarray]], dim: int, batch: int = 32) -> Callable[[Column], Column]:
    """Hook for a real model: ``load`` runs once per Python worker, blank texts never reach it."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = load()
        for texts in batches:
            values = texts.fillna("").tolist()
            out = np.zeros((len(values), dim), dtype=np.float32)
            rows = [i for i, t in enumerate(values) if t.strip()]
            for at in range(0, len(rows), batch):
                part = rows[at : at + batch]
                out[part] = encode([values[i] for i in part])
            yield pd.Series(list(out))

    return run


def embed(df: DataFrame, text_col: str, dim: int = 64, embedder: Callable[[Column], Column] | None = None, out: str = "embedding") -> DataFrame:
    return df.withColumn(out, (embedder or hash_embedder(dim))(F.col(text_col)))


def cache_key(text: Column, namespace: str) -> Column:
    return F.concat(F.lit(f"{namespace}:"), F.md5(F.coalesce(text, F.lit(""))))


def embed_cached(
    df: DataFrame, text_col: str, cache: DataFrame, namespace: str, dim: int = 64, embedder: Callable[[Column], Column] | None = None
) -> tuple[DataFrame, DataFrame]:
    """(df + embedding, new cache rows). Each distinct unknown text is embedded once.

    A cached vector of another length counts as a miss. The new rows are stored,
    so that using them and keeping them embeds no text again.
    """
    keyed = df.withColumn("cache_key", cache_key(F.col(text_col), namespace))
    known = cache.where(F.size("embedding") == dim).select("cache_key", "embedding")
    distinct = keyed.groupBy("cache_key").agg(F.min(text_col).alias("_text"))
    missing = distinct.join(known, "cache_key", "left_anti")
    fresh = durable(missing.select("cache_key", (embedder or hash_embedder(dim))(F.col("_text")).alias("embedding")))
    return keyed.join(known.unionByName(fresh), "cache_key", "left"), fresh


def cache_counts(df: DataFrame, text_col: str, cache: DataFrame, namespace: str, dim: int = 64) -> DataFrame:
    """One row: requests, distinct texts, hits and computed vectors."""
    keyed = df.select(cache_key(F.col(text_col), namespace).alias("cache_key")).groupBy("cache_key").count()
    known = cache.where(F.size("embedding") == dim).select("cache_key").distinct().withColumn("_hit", F.lit(1))
    joined = keyed.join(known, "cache_key", "left")
    hit = F.col("_hit").isNotNull()
    return joined.agg(
        F.sum("count").alias("requests"),
        F.count(F.lit(1)).alias("distinct_texts"),
        F.coalesce(F.sum(F.when(hit, F.col("count"))), F.lit(0)).cast("bigint").alias("request_hits"),
        F.count_if(hit).alias("text_hits"),
        F.count_if(~hit).alias("computed"),
    )


def entity_names(triplets: DataFrame) -> DataFrame:
    return (
        triplets.select(F.explode(F.array("subject", "object")).alias("name")).where(~is_blank(F.col("name"))).distinct()
    )


def entity_vectors(triplets: DataFrame, dim: int = 64, embedder=None) -> DataFrame:
    return embed(entity_names(triplets), "name", dim, embedder)


def relationship_texts(triplets: DataFrame) -> DataFrame:
    """Text to embed for each edge (its description, else the three parts) and the edge's key."""
    parts = [F.col(c) for c in ("subject", "predicate", "object")]
    text = F.coalesce(F.when(F.col("description") != "", F.col("description")), F.concat_ws(" ", *parts))
    return triplets.withColumn("rel_text", text).withColumn("rel_key", F.concat_ws("|", *parts))
