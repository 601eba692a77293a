"""A stored index for approximate cosine search: coarse cells and product-quantised residuals.

The index is two tables partitioned by cell. ``codes`` holds a byte for each part
of a vector's difference from its cell's centre; ``vectors`` holds the vectors.
A search reads the codes of the cells that its queries probe (partition pruning),
scores them by table look-ups, and rescores the best of them exactly from the
vectors of the same cells. The index is built once and opened by path.

Cells and code books are learned from a bounded sample (``SAMPLE`` rows, drawn by
hash); every vector is indexed.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vectors import cosine
from ..session import durable
from .search import BLOCK_BYTES, _matrix, _rank, _unit, fetch, hit_schema, merged, scan_blocks

SAMPLE = 1 << 16
#: Bytes of vectors in a file of the index, about.
FILE_BYTES = 128 << 20
_CODED = 1 << 13


@dataclass(frozen=True)
class Books:
    """``centres`` (cells × length) and, for each part of a vector, the ``books`` of up to 256 residuals (parts × entries × length of a part)."""

    centres: np.ndarray
    books: np.ndarray

    @property
    def dim(self) -> int:
        return self.centres.shape[1]

    def cell_of(self, unit: np.ndarray) -> np.ndarray:
        return _nearest(unit, self.centres)

    def codes_of(self, residual: np.ndarray) -> np.ndarray:
        parts, _, width = self.books.shape
        split = residual.reshape(len(residual), parts, width)
        return np.stack([_nearest(split[:, p], self.books[p]) for p in range(parts)], axis=1).astype(np.uint8)

    def probes(self, unit: np.ndarray, n: int) -> np.ndarray:
        """The ``n`` cells whose centres are closest, closest first; equal ones by number."""
        far = (self.centres**2).sum(1)[None, :] - 2 * unit @ self.centres.T
        return np.argsort(np.round(far, 9), axis=1, kind="stable")[:, :n]


def _nearest(rows: np.ndarray, points: np.ndarray) -> np.ndarray:
    out = np.empty(len(rows), np.int64)
    size = (points**2).sum(1)[None, :]
    for low in range(0, len(rows), _CODED):
        part = rows[low : low + _CODED]
        # Rounded, so that the order of additions can't break a tie.
        out[low : low + len(part)] = np.argmin(np.round(size - 2 * part @ points.T, 9), axis=1)
    return out


def _means(rows: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """Lloyd's k-means on the bounded sample; a centre without rows stays where it is."""
    rng = np.random.default_rng(seed)
    centres = rows[rng.choice(len(rows), min(k, len(rows)), replace=False)].copy()
    for _ in range(rounds):
        at = _nearest(rows, centres)
        count = np.bincount(at, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, at, rows)
        centres[count > 0] = total[count > 0] / count[count > 0, None]
    return centres


def train_books(corpus: DataFrame, cells: int = 64, parts: int = 16, entries: int = 256, id_col: str = "id", vec_col: str = "embedding", sample: int = SAMPLE, rounds: int = 12, seed: int = 7) -> Books:
    """Learn cells and code books from ``sample`` rows at most, the first by the hash of their ids."""
    rows = corpus.where(F.col(vec_col).isNotNull()).select(F.col(vec_col).alias("v"), F.xxhash64(id_col).alias("h"))
    drawn = rows.orderBy("h").limit(sample).select("v").toPandas()["v"]
    if not len(drawn):
        raise ValueError("an index can't be learned from no vectors")
    unit = _unit(np.stack([np.asarray(v, dtype=np.float64) for v in drawn]))
    if unit.shape[1] % parts:
        raise ValueError(f"vectors of length {unit.shape[1]} can't be cut into {parts} equal parts")
    centres = _means(unit, cells, rounds, seed)
    left = (unit - centres[_nearest(unit, centres)]).reshape(len(unit), parts, -1)
    return Books(centres, np.stack([_means(left[:, p], entries, rounds, seed + p) for p in range(parts)]))


def build_index(corpus: DataFrame, path: str, books: Books, id_col: str = "id", vec_col: str = "embedding") -> None:
    """Write the index of ``corpus`` below ``path``. Rows without a vector are not in it."""
    c = corpus.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<float>").alias("embedding"))
    schema = T.StructType([T.StructField("cell", T.IntegerType()), c.schema["id"], T.StructField("codes", T.BinaryType()), T.StructField("embedding", T.ArrayType(T.FloatType()))])

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(batch.column(1).is_valid())
            if batch.num_rows:
                unit = _unit(_matrix(batch.column(1), books.dim))
                cell = books.cell_of(unit)
                codes = books.codes_of(unit - books.centres[cell])
                yield pa.record_batch({"cell": pa.array(cell, pa.int32()), "id": batch.column(0), "codes": pa.array([r.tobytes() for r in codes], pa.binary()), "embedding": batch.column(1)})

    coded = durable(c.mapInArrow(code, schema))
    # A crowded cell is written by several tasks, by its counted size: a row for each cell.
    lots = coded.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) * (4 * books.dim) / FILE_BYTES).alias("lots"))
    dealt = coded.join(F.broadcast(lots), "cell").withColumn("lot", F.pmod(F.xxhash64("id"), "lots"))
    dealt = dealt.repartition("cell", "lot").sortWithinPartitions("cell", "id")
    spark = corpus.sparkSession
    dealt.select("cell", "id", "codes").write.partitionBy("cell").parquet(f"{path}/codes")
    dealt.select("cell", "id", "embedding").write.partitionBy("cell").parquet(f"{path}/vectors")
    form = json.dumps({"cells": len(books.centres), "dim": books.dim, "parts": books.books.shape[0], "entries": books.books.shape[1]})
    row = (form, books.centres.astype("<f8").tobytes(), books.books.astype("<f8").tobytes())
    spark.createDataFrame([row], "form string, centres binary, books binary").coalesce(1).write.parquet(f"{path}/books")


@dataclass(frozen=True)
class VectorIndex:
    books: Books
    codes: DataFrame
    vectors: DataFrame

    @staticmethod
    def open(spark: SparkSession, path: str) -> VectorIndex:
        row = spark.read.parquet(f"{path}/books").first()
        form = json.loads(row["form"])
        centres = np.frombuffer(row["centres"], "<f8").reshape(form["cells"], form["dim"])
        books = np.frombuffer(row["books"], "<f8").reshape(form["parts"], form["entries"], -1)
        return VectorIndex(Books(centres, books), spark.read.parquet(f"{path}/codes"), spark.read.parquet(f"{path}/vectors"))

    def candidates(self, queries: DataFrame, n: int, nprobe: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
        """``query_id, id, score, cell, rank``: the ``n`` best of each query (``query_id``, ``embedding``) by their codes, in its ``nprobe`` closest cells."""
        schema = hit_schema(queries.schema["query_id"].dataType, self.codes.schema["id"].dataType).add("cell", T.IntegerType())
        q = durable(queries.select("query_id", "embedding")).where("embedding is not null")
        size = F.octet_length(F.col("query_id").cast("string")) + 8 * F.size("embedding")
        # The codes themselves are the corpus: pruned by cell for each block, so not stored again.
        hits = scan_blocks(q, self.codes, size, block_bytes, lambda head, rows: self._scan(head, rows, n, nprobe, schema), schema)
        return merged(hits, n)

    def _scan(self, head: pd.DataFrame, codes: DataFrame, n: int, nprobe: int, schema: T.StructType):
        books = self.books
        unit = _unit(np.stack([np.asarray(v, dtype=np.float64) for v in head["embedding"]]))
        probes = books.probes(unit, nprobe)
        sent = codes.sparkSession.sparkContext.broadcast((head["query_id"].to_numpy(), unit, probes))
        wanted = codes.where(F.col("cell").isin([int(c) for c in np.unique(probes)])).select("cell", "id", "codes")

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, vectors, near = sent.value
            parts, _, width = books.books.shape
            best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            for batch in batches:
                cells = batch.column(0).to_numpy()
                ids = batch.column(1).to_numpy(zero_copy_only=False)
                coded = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(len(ids), parts)
                for cell in np.unique(cells):
                    rows = np.flatnonzero(cells == cell)
                    for query in np.flatnonzero((near == cell).any(axis=1)):
                        table = np.einsum("pew,pw->pe", books.books, vectors[query].reshape(parts, width))
                        score = table[np.arange(parts), coded[rows]].sum(axis=1) + vectors[query] @ books.centres[cell]
                        now = (ids[rows], np.round(score, 6) + 0.0, cells[rows])
                        best[query] = _best(n, *(np.concatenate(x) for x in zip(best[query], now)) if query in best else now)
            for query, (found, score, cell) in best.items():
                yield pa.record_batch([pa.array(names[np.full(len(found), query)]), pa.array(found), pa.array(score), pa.array(cell)], names=["query_id", "id", "score", "cell"])

        return wanted.mapInArrow(scan, schema), sent

    def search(self, queries: DataFrame, k: int, nprobe: int = 8, rescored: int = 100) -> DataFrame:
        """Cosine top-k (``query_id, id, score, rank``) among the ``rescored`` best candidates by code of the probed cells."""
        return self.rescore(self.candidates(queries, rescored, nprobe), queries, k)

    def rescore(self, found: DataFrame, queries: DataFrame, k: int) -> DataFrame:
        found = durable(found)
        cells = [r["cell"] for r in found.select("cell").distinct().collect()]  # as many as the index has cells, at most
        asked = queries.select("query_id", F.col("embedding").alias("_query"))
        pairs = fetch(found.select("query_id", "id"), self.vectors.where(F.col("cell").isin(cells)).select("id", "embedding")).join(asked, "query_id")
        score = F.round(cosine(F.col("embedding"), F.col("_query")), 6) + F.lit(0.0)
        return _rank(pairs.select("query_id", "id", score.alias("score")), k)

    def bytes_read(self, queries: DataFrame, nprobe: int, rescored: int) -> DataFrame:
        """``code_bytes``, ``vector_bytes`` that each query has scored, next to ``all_bytes`` of all vectors."""
        books = self.books

        def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                batch = batch.filter(batch.column(1).is_valid())
                near = books.probes(_unit(_matrix(batch.column(1), books.dim)), nprobe)
                yield pa.record_batch([batch.column(0).take(pa.array(np.repeat(np.arange(len(near)), near.shape[1]))), pa.array(near.ravel(), pa.int32())], names=["query_id", "cell"])

        schema = T.StructType([queries.schema["query_id"], T.StructField("cell", T.IntegerType())])
        sizes = self.codes.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
        met = queries.select("query_id", "embedding").mapInArrow(probed, schema).join(F.broadcast(sizes), "cell")
        row = 4 * books.dim
        each = met.groupBy("query_id").agg((F.sum("n") * books.books.shape[0]).alias("code_bytes"), (F.least(F.sum("n"), F.lit(rescored)) * row).alias("vector_bytes"))
        return each.withColumn("all_bytes", F.lit(self.codes.count() * row))


def _best(n, ids, score, cells):
    """The ``n`` best by score, ties to the smaller id."""
    order = np.lexsort((ids, -score))[:n]
    return ids[order], score[order], cells[order]
