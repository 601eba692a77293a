"""A stored inverted index for BM25: compressed lists by block of documents, and the best k without scoring all blocks.

A task cuts its documents into blocks as it reads them and writes, for every term
of a block, one row: places and counts in few bytes, and the two numbers that
bound what the list can add to a score (its largest count and the length of its
shortest document). Rows are partitioned by a hash of the term, so that a search
reads the parts of its terms only. Beside the lists are the blocks (ids and
lengths) and the statistics of the corpus.

A search first bounds every (query, block) from the bounds alone, without reading
any list. The blocks with the highest bounds give each query a k-th score; only
blocks whose bound reaches it are scored then. Nothing that could be among the
best k is left out, also where a document without any term of the query, with
score 0, is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import durable, stored
from .rerank import EPSILON, CorpusStatistics, _gain, _idf, _tokens, query_terms
from .search import hit_schema, merged, table_topk

#: Documents of a block, at most; places in it take two bytes.
BLOCK_DOCS = 512
PARTS = 64
#: Blocks of each query that give it its first k-th score.
FIRST = 2
#: Scores are compared after rounding to six decimals.
_SLACK = 2e-6

_LIST = "block long, term string, n int, most int, shortest int, places binary, counts binary, ids array<{id}>, lengths array<int>"


def _lists(block_docs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for low in range(0, batch.num_rows, block_docs):
                piece = batch.slice(low, block_docs)
                yield from _block(block, piece)
                block += 1

    return run


def _block(block: int, piece: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    tokens = piece.column(1)
    length = np.diff(np.asarray(tokens.offsets)).astype(np.int32)
    coded = tokens.flatten().dictionary_encode()
    terms, doc = np.asarray(coded.indices).astype(np.int64), np.repeat(np.arange(len(length)), length)
    pair, tf = np.unique(terms * BLOCK_DOCS + doc, return_counts=True)
    term, place = np.divmod(pair, BLOCK_DOCS)
    starts = np.flatnonzero(np.append(True, term[1:] != term[:-1])) if len(term) else np.zeros(0, np.int64)
    ends = np.append(starts[1:], len(term)).astype(np.int64)
    rows = len(starts)
    places, counts = place.astype("<u2").tobytes(), tf.astype("<u4").tobytes()
    cut = lambda data, width: pa.array([data[width * a : width * b] for a, b in zip(starts.tolist(), ends.tolist())], pa.binary())
    kind = piece.column(0).type
    yield pa.record_batch([
        pa.array(np.full(rows, block, np.int64)), coded.dictionary.take(pa.array(term[starts])).cast(pa.string()), pa.array((ends - starts).astype(np.int32)),
        pa.array(np.maximum.reduceat(tf, starts).astype(np.int32) if rows else [], pa.int32()), pa.array(np.minimum.reduceat(length[place], starts) if rows else [], pa.int32()),
        cut(places, 2), cut(counts, 4), pa.nulls(rows, pa.list_(kind)), pa.nulls(rows, pa.list_(pa.int32())),
    ], names=_NAMES)
    whole = pa.array([0, len(length)], pa.int32())
    yield pa.record_batch([
        pa.array([block], pa.int64()), pa.nulls(1, pa.string()), pa.array([len(length)], pa.int32()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.int32()),
        pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()), pa.ListArray.from_arrays(whole, piece.column(0)), pa.ListArray.from_arrays(whole, pa.array(length)),
    ], names=_NAMES)


_NAMES = ["block", "term", "n", "most", "shortest", "places", "counts", "ids", "lengths"]


def build_index(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", block_docs: int = BLOCK_DOCS) -> None:
    """Write the index of ``docs`` below ``path``. The corpus is tokenised once and only lists are shuffled."""
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).alias("id"), _tokens(F.col(text_col)).alias("tokens"))
    schema = _LIST.format(id=base.schema["id"].dataType.simpleString())
    rows = stored(base.mapInArrow(_lists(min(block_docs, BLOCK_DOCS)), schema), "index-rows")
    lists = rows.where("term is not null").withColumn("part", F.pmod(F.xxhash64("term"), F.lit(PARTS)).cast("int"))
    lists = lists.select("part", "term", "block", "n", "most", "shortest", "places", "counts").repartition("part", F.pmod("block", F.lit(16)))
    lists.sortWithinPartitions("part", "term", "block").write.partitionBy("part").parquet(f"{path}/lists")
    rows.where("term is null").select("block", "ids", "lengths").write.parquet(f"{path}/blocks")
    spark.read.parquet(f"{path}/lists").groupBy("term").agg(F.sum("n").alias("df")).write.parquet(f"{path}/terms")
    total = spark.read.parquet(f"{path}/blocks").agg(F.coalesce(F.sum(F.size("ids")), F.lit(0)).alias("n"), F.sum(F.aggregate("lengths", F.lit(0).cast("bigint"), lambda a, x: a + x)).alias("length"))
    n, length = total.first()
    mean_idf = spark.read.parquet(f"{path}/terms").agg(F.avg(_idf(F.lit(float(n)), F.col("df")))).first()[0] or 0.0
    spark.createDataFrame([(n, length / n if n else 0.0, EPSILON * mean_idf)], "n long, mean_length double, floor double").coalesce(1).write.parquet(f"{path}/statistics")


@dataclass(frozen=True)
class TextIndex:
    lists: DataFrame
    blocks: DataFrame
    statistics: CorpusStatistics

    @staticmethod
    def open(spark: SparkSession, path: str) -> TextIndex:
        row = spark.read.parquet(f"{path}/statistics").first()
        stats = CorpusStatistics(spark.read.parquet(f"{path}/terms"), row["n"], row["mean_length"], row["floor"])
        return TextIndex(spark.read.parquet(f"{path}/lists"), spark.read.parquet(f"{path}/blocks"), stats)

    def search(self, queries: DataFrame, k: int, query_text: str = "text") -> DataFrame:
        """Top-k by BM25 (``query_id, id, score, rank``), the rows of ``bm25_corpus`` over the same documents."""
        return merged(self.hits(queries, k, query_text), k)

    def weighted(self, queries: DataFrame, query_text: str) -> DataFrame:
        stats = self.statistics
        idf = _idf(F.lit(float(stats.n)), F.col("df"))
        weight = F.col("qtf") * F.when(idf < 0, F.lit(stats.floor)).otherwise(idf)
        return query_terms(queries, query_text).join(stats.terms, "term").select("query_id", "term", weight.alias("weight"))

    def bounds(self, terms: DataFrame) -> DataFrame:
        """(query_id, block, bound): no document of the block scores above. Read without places and counts."""
        mean = F.lit(float(self.statistics.mean_length) or 1.0)
        rows = self._of(terms).select("term", "block", "most", "shortest").join(terms, "term")
        most, shortest = F.col("most").cast("double"), F.col("shortest").cast("double")
        return rows.groupBy("query_id", "block").agg(F.sum(F.greatest(F.lit(0.0), F.col("weight") * _gain(most, shortest, mean))).alias("bound"))

    def _of(self, terms: DataFrame) -> DataFrame:
        """The lists in the parts of the queries' terms: at most ``PARTS`` numbers are collected."""
        part = F.pmod(F.xxhash64("term"), F.lit(PARTS)).cast("int")
        parts = [r[0] for r in terms.select(part.alias("p")).distinct().collect()]
        return self.lists.where(F.col("part").isin(parts))

    def hits(self, queries: DataFrame, k: int, query_text: str = "text") -> DataFrame:
        # Written tables have the size of their files: small ones are sent to the lists, which then stay where they are.
        terms = stored(self.weighted(queries, query_text), "terms")
        bounds = stored(self.bounds(terms), "bounds")
        order = Window.partitionBy("query_id").orderBy(F.col("bound").desc(), F.col("block"))
        first = bounds.withColumn("r", F.row_number().over(order)).where(F.col("r") <= FIRST).select("query_id", "block")
        found = durable(merged(self._scored(first, terms, k), k))
        least = found.groupBy("query_id").agg(F.when(F.count(F.lit(1)) == k, F.min("score")).alias("least"))
        asked = stored(queries.select("query_id").join(least, "query_id", "left"), "thresholds")
        reach = bounds.join(asked, "query_id").where(F.col("least").isNull() | (F.col("bound") >= F.col("least") - _SLACK)).select("query_id", "block")
        # Where a score of 0 may be among the best, blocks without a term of the query count too: such a query meets all blocks.
        thin = asked.where(F.col("least").isNull() | (F.col("least") <= _SLACK)).select("query_id", F.when(F.col("query_id").isNotNull(), 0).alias("all"))
        every = self.blocks.select("block", F.when(F.col("block").isNotNull(), 0).alias("all"))
        if not thin.isEmpty():
            reach = reach.unionByName(thin.join(every, "all").select("query_id", "block")).distinct()
        return self._scored(reach, terms, k)

    def _scored(self, pairs: DataFrame, terms: DataFrame, k: int) -> DataFrame:
        """The best k of each block for each (query_id, block) given: lists and queries of a block meet in one task."""
        pairs = stored(pairs, "pairs")
        asked = pairs.join(terms, "query_id", "left")
        wanted = stored(asked.where("term is not null").select("block", "term").distinct(), "wanted")
        lists = self._of(terms).join(wanted, ["block", "term"], "left_semi").select("block", "term", "places", "counts")
        blocks = self.blocks.join(pairs.select("block").distinct(), "block", "left_semi")
        right = lists.unionByName(blocks, allowMissingColumns=True)
        schema = hit_schema(pairs.schema["query_id"].dataType, self.blocks.schema["ids"].dataType.elementType)
        grouped = asked.select(F.col("block").alias("block"), "query_id", "term", "weight").groupBy("block").cogroup(right.groupBy("block"))
        return grouped.applyInArrow(_scorer(k, float(self.statistics.mean_length)), schema)


def _scorer(k: int, mean_length: float):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        held, ids, length = {}, None, None
        for term, places, counts, names, lengths in zip(*(right.column(c) for c in ("term", "places", "counts", "ids", "lengths"))):
            if term.is_valid:
                held[term.as_py()] = (np.frombuffer(places.as_py(), "<u2"), np.frombuffer(counts.as_py(), "<u4").astype(np.float64))
            else:
                ids, length = names.values.to_numpy(zero_copy_only=False), np.asarray(lengths.values).astype(np.float64)
        asked = left.to_pandas()
        queries, owner = np.unique(asked["query_id"].to_numpy(), return_inverse=True)
        scores = np.zeros((len(ids), len(queries)))
        gains = {}
        for query, term, weight in zip(owner.tolist(), asked["term"], asked["weight"].tolist()):
            if term in held:
                places, tf = held[term]
                if term not in gains:
                    gains[term] = _gain(tf, length[places], mean_length)
                scores[places, query] += weight * gains[term]
        best = table_topk(ids, np.round(scores, 6) + 0.0, k)
        return pa.table({"query_id": pa.array(queries[best["q"].to_numpy(dtype=int)]), "id": pa.array(best["id"].to_numpy()), "score": pa.array(best["score"].to_numpy(dtype=float))})

    return run
