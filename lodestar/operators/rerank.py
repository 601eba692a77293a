"""Reranking candidate lists, corpus-wide BM25, diversity and retrieval metrics."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Iterator, Tuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.pieces import cut
from ..functions.strings import words
from ..session import durable
from .search import BLOCK_BYTES, best_rows, hit_batch, hit_schema, merged, scan_blocks, table_topk

K1 = 1.5
B = 0.75
EPSILON = 0.25
BLOCK_PARTS = 4_000_000
#: Tokens of documents, and cells of the score table, that a task works on at a time.
RUN_TOKENS, RUN_CELLS = 1 << 18, 1 << 18


def _ranked(scored: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("id"))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _tokens(text: Column) -> Column:
    return words(F.lower(F.coalesce(text, F.lit(""))))


def _idf(n: Column, df: Column) -> Column:
    return F.ln(n - df + 0.5) - F.ln(df + 0.5)


def _gain(tf, length, mean_length):
    """For columns and for arrays."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean_length))


def query_terms(queries: DataFrame, text_col: str) -> DataFrame:
    """query_id, term, qtf: a repeated query term counts repeatedly."""
    exploded = queries.select("query_id", F.explode(_tokens(F.col(text_col))).alias("term"))
    return exploded.groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))


@dataclass(frozen=True)
class CorpusStatistics:
    """Document frequencies (term, df) and three numbers; as large as the vocabulary, not as the corpus."""

    terms: DataFrame
    n: int
    mean_length: float
    floor: float


def corpus_statistics(docs: DataFrame, text_col: str = "text") -> CorpusStatistics:
    """One pass over the corpus, combined on the map side. Compute once, use for every batch of queries.

    Each document adds one row with a NULL term, which counts the documents and
    their lengths in the same aggregation.
    """
    tokens = docs.select(_tokens(F.col(text_col)).alias("tokens"))
    total = F.struct(F.lit(None).cast("string").alias("term"), F.size("tokens").cast("bigint").alias("length"))
    each = F.transform(F.array_distinct("tokens"), lambda w: F.struct(w.alias("term"), F.lit(0).cast("bigint").alias("length")))
    counted = tokens.select(F.inline_outer(F.concat(F.array(total), each))).groupBy("term").agg(
        F.count(F.lit(1)).alias("df"), F.sum("length").alias("length")
    )
    counted = durable(counted)
    whole = counted.where("term is null").first()
    n = whole["df"] if whole else 0
    terms = counted.where("term is not null").select("term", "df")
    mean_idf = terms.agg(F.avg(_idf(F.lit(float(n)), F.col("df")))).first()[0] or 0.0
    return CorpusStatistics(terms, n, whole["length"] / n if n else 0.0, EPSILON * mean_idf)


def bm25_corpus(
    queries: DataFrame, docs: DataFrame, k: int, query_text: str = "text", id_col: str = "doc_id", text_col: str = "text",
    statistics: CorpusStatistics | None = None, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Top-k by BM25 with statistics of the whole corpus.

    The corpus is tokenised once for the statistics and once for the scores. The
    second pass scores whole documents against the weighted terms of a block of
    queries and keeps each task's best k, so no pair of query and document leaves
    its task. A document without a query term scores 0 and takes its place among
    the others, also where scores are negative.
    """
    stats = statistics or corpus_statistics(docs, text_col)
    idf = _idf(F.lit(float(stats.n)), F.col("df"))
    weight = F.col("qtf") * F.when(idf < 0, F.lit(stats.floor)).otherwise(idf)
    weighed = query_terms(queries, query_text).join(stats.terms, "term").select("query_id", "term", weight.alias("weight"))
    # A query without a known term still gets its rows: the term NULL has no weight.
    asked = queries.select("query_id", F.lit(None).cast("string").alias("term"), F.lit(0.0).alias("weight"))
    terms = durable(weighed.unionByName(asked))
    base = docs.select(F.col(id_col).alias("id"), _tokens(F.col(text_col)).alias("tokens"))
    schema = hit_schema(terms.schema["query_id"].dataType, base.schema["id"].dataType)
    size = F.octet_length(F.col("query_id").cast("string")) + F.octet_length(F.coalesce("term", F.lit(""))) + 32
    hits = scan_blocks(terms, base, size, block_bytes, lambda head, rows: _scan_bm25(head, rows, k, stats.mean_length, schema), schema)
    return merged(hits, k)


def _scan_bm25(head: pd.DataFrame, corpus: DataFrame, k: int, mean_length: float, schema: T.StructType):
    """Hits of one block of (query_id, term, weight) rows, kept per task."""
    place, query_ids = pd.factorize(head["query_id"])
    known = head["term"].notna().to_numpy()
    term, names = pd.factorize(head["term"][known])
    order = np.argsort(term, kind="stable")
    starts = np.searchsorted(term[order], np.arange(len(names) + 1))
    sent = corpus.sparkSession.sparkContext.broadcast(
        (np.asarray(query_ids), list(names), starts, place[known][order], head["weight"].to_numpy(dtype=float)[known][order])
    )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, names, starts, owners, weights = sent.value
        wanted = pa.array(names, pa.string())
        # Rows of the score table are documents: as many at a time as keep it and their tokens small.
        step = max(1, RUN_CELLS // max(1, len(ids)))
        best = None
        for batch in batches:
            sizes = pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            for at, rows in cut(sizes, RUN_TOKENS, step):
                piece = batch.slice(at, rows)
                scores = _bm25_scores(piece.column(1), wanted, starts, owners, weights, len(ids), mean_length)
                part = table_topk(piece.column(0).to_numpy(zero_copy_only=False), scores, k)
                best = part if best is None else best_rows(pd.concat([best, part], ignore_index=True), k)
        if best is not None and len(best):
            yield hit_batch(best, ids)

    return corpus.mapInArrow(scan, schema), sent


def _bm25_scores(
    tokens: pa.ListArray, wanted: pa.Array, starts: np.ndarray, owners: np.ndarray, weights: np.ndarray, n_queries: int, mean_length: float
) -> np.ndarray:
    """Scores of some documents (rows) for all queries of a block (columns)."""
    n = len(tokens)
    length = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    found = pc.index_in(tokens.flatten(), value_set=wanted)
    hit = found.is_valid().to_numpy(zero_copy_only=False)
    doc = np.repeat(np.arange(n), length)[hit]
    pair, tf = np.unique(doc * max(1, len(wanted)) + found.drop_null().to_numpy(zero_copy_only=False), return_counts=True)
    doc, term = np.divmod(pair, max(1, len(wanted)))
    gain = _gain(tf, length[doc], mean_length) if mean_length else np.zeros(len(doc))
    fan = starts[term + 1] - starts[term]
    scores = np.zeros(n * n_queries)
    # Postings meet their queries' weights a bounded number at a time.
    cuts = np.searchsorted(np.cumsum(fan), np.arange(BLOCK_PARTS, fan.sum() + BLOCK_PARTS, BLOCK_PARTS), side="right")
    for a, b in zip([0, *cuts[:-1]], cuts):
        many = fan[a:b]
        at = np.repeat(starts[term[a:b]] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
        cell = np.repeat(doc[a:b], many) * n_queries + owners[at]
        scores += np.bincount(cell, weights[at] * np.repeat(gain[a:b], many), n * n_queries)
    return np.round(scores.reshape(n, n_queries), 6) + 0.0


def bm25_candidates(hits: DataFrame, queries: DataFrame, k: int, query_text: str = "query_text") -> DataFrame:
    """Rerank each query's own candidates (query_id, id, content, score) with their own statistics.

    The candidates are shuffled once by ``query_id``; counts, frequencies and
    means are windows over that one layout. They are at most k rows per query and
    are written once, so that a whole-corpus search before them is never repeated.
    """
    hits = durable(hits.select("query_id", "id", "content", "score"))
    by_query = Window.partitionBy("query_id")
    docs = hits.select("query_id", "id", _tokens(F.col("content")).alias("tokens")).withColumn("length", F.size("tokens"))
    docs = docs.withColumn("n", F.count(F.lit(1)).over(by_query)).withColumn("mean_length", F.avg("length").over(by_query))
    tf = (
        docs.select("query_id", "id", "length", "n", "mean_length", F.explode_outer("tokens").alias("term"))
        .groupBy("query_id", "id", "length", "n", "mean_length", "term")
        .agg(F.count(F.lit(1)).alias("tf"))
    )
    rated = tf.withColumn("df", F.when(F.col("term").isNotNull(), F.count(F.lit(1)).over(Window.partitionBy("query_id", "term"))))
    rated = rated.withColumn("idf", _idf(F.col("n"), F.col("df")))
    # A term stands in df rows, each of which carries its share: the mean is over distinct terms.
    mean_idf = F.sum(F.col("idf") / F.col("df")).over(by_query) / F.sum(1 / F.col("df")).over(by_query)
    rated = rated.withColumn("idf", F.when(F.col("idf") < 0, EPSILON * mean_idf).otherwise(F.col("idf")))
    asked = rated.join(query_terms(queries, query_text), ["query_id", "term"], "left")
    part = F.col("qtf") * F.col("idf") * _gain(F.col("tf"), F.col("length"), F.col("mean_length"))
    scored = asked.groupBy("query_id", "id").agg(F.round(F.coalesce(F.sum(part), F.lit(0.0)), 6).alias("score"))
    best = _ranked(scored, k)
    return best.join(hits.select("query_id", "id", "content", F.col("score").alias("original_score")), ["query_id", "id"])


def rerank_default(hits: DataFrame, k: int) -> DataFrame:
    """By the score the hits came with; a missing score counts 0."""
    return _ranked(hits.withColumn("score", F.coalesce("score", F.lit(0.0))), k)


def jaccard_overlap(query: Column, text: Column) -> Column:
    """Share of distinct lower-cased tokens that both sides have."""
    a, b = F.array_distinct(_tokens(query)), F.array_distinct(_tokens(text))
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def pair_model(load: Callable[[], Callable[[list[str], list[str]], np.ndarray]]) -> Callable[[Column, Column], Column]:
    """Hook for a cross-encoder: ``load`` runs once per worker. A batch that fails scores NULL."""

    @F.pandas_udf("double")
    def run(batches: Iterator[Tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        predict = load()
        for queries, texts in batches:
            try:
                yield pd.Series(np.asarray(predict(queries.tolist(), texts.tolist()), dtype=float))
            except Exception:
                yield pd.Series([None] * len(queries), dtype=float)

    return run


def rerank_model(hits: DataFrame, queries: DataFrame, k: int, scorer: Callable[[Column, Column], Column] = jaccard_overlap, query_text: str = "query_text") -> DataFrame:
    """Score every (query, content) pair. A pair that cannot be scored keeps its old score."""
    paired = hits.withColumnRenamed("rank", "original_rank").join(queries.select("query_id", query_text), "query_id")
    scored = paired.withColumn("original_score", F.col("score")).withColumn(
        "score", F.round(F.coalesce(scorer(F.col(query_text), F.col("content")), F.col("original_score"), F.lit(0.0)), 6)
    )
    return _ranked(scored.drop(query_text), k)


def _mmr_order(vectors: np.ndarray, relevance: np.ndarray, k: int, diversity: float) -> list[int]:
    size = np.linalg.norm(vectors, axis=1, keepdims=True)
    unit = np.divide(vectors, size, out=np.zeros_like(vectors), where=size > 0)
    closest = np.full(len(unit), -np.inf)
    left = np.ones(len(unit), dtype=bool)
    chosen: list[int] = []
    for _ in range(min(k, len(unit))):
        penalty = np.where(np.isinf(closest), 0.0, closest)
        value = np.round((1 - diversity) * relevance - diversity * penalty, 6)
        pick = int(np.argmax(np.where(left, value, -np.inf)))
        chosen.append(pick)
        left[pick] = False
        closest = np.maximum(closest, unit @ unit[pick])
    return chosen


def mmr(hits: DataFrame, k: int, diversity: float = 0.3) -> DataFrame:
    """Maximal marginal relevance over (query_id, id, score, embedding); ties go to the smaller id.

    A group is one query's candidate list, whose length the search before it bounds.
    """

    def pick(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("id", kind="stable").reset_index(drop=True)
        vectors = np.stack([np.asarray(v, dtype=np.float64) for v in frame["embedding"]])
        order = _mmr_order(vectors, frame["score"].to_numpy(dtype=float), k, diversity)
        out = frame.iloc[order][["query_id", "id", "score"]].copy()
        out["rank"] = np.arange(1, len(order) + 1, dtype=np.int32)
        return out

    fields = {f.name: f.dataType for f in hits.schema.fields}
    schema = T.StructType(
        [
            T.StructField("query_id", fields["query_id"]),
            T.StructField("id", fields["id"]),
            T.StructField("score", T.DoubleType()),
            T.StructField("rank", T.IntegerType()),
        ]
    )
    return hits.select("query_id", "id", "score", "embedding").groupBy("query_id").applyInPandas(pick, schema)


STRATEGIES: dict[str, Callable[..., DataFrame]] = {}


def register_strategy(name: str, strategy: Callable[..., DataFrame]) -> None:
    """``strategy(hits, queries, k, **options)``."""
    STRATEGIES[name.lower()] = strategy


register_strategy("default", lambda hits, queries, k, **_: rerank_default(hits, k))
register_strategy("bm25", lambda hits, queries, k, **_: bm25_candidates(hits, queries, k))
register_strategy("cross_encoder", lambda hits, queries, k, scorer=None, **_: (
    rerank_model(hits, queries, k, scorer) if scorer else rerank_default(hits, k)
))
register_strategy("model", lambda hits, queries, k, scorer=jaccard_overlap, **_: rerank_model(hits, queries, k, scorer))
register_strategy("mmr", lambda hits, queries, k, diversity=0.3, **_: mmr(hits, k, diversity))


def rerank(hits: DataFrame, queries: DataFrame, strategy: str = "default", k: int = 5, **options) -> DataFrame:
    """Dispatch by strategy name; an unknown name means ``default``."""
    return STRATEGIES.get(strategy.lower(), STRATEGIES["default"])(hits, queries, k, **options)


def query_metrics(queries: DataFrame, ranked: DataFrame, relevance: DataFrame) -> DataFrame:
    """Per query precision, recall and nDCG with binary gain.

    ``ranked`` is (query_id, id, rank), ``relevance`` is (query_id, id). Counts
    are combined before the shuffle, so long relevance lists cost no memory.
    """
    marked = ranked.join(relevance.select("query_id", "id").distinct().withColumn("_rel", F.lit(1)), ["query_id", "id"], "left")
    got = marked.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n_ranked"),
        F.count("_rel").alias("n_hit"),
        F.sum(F.when(F.col("_rel") == 1, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("dcg"),
    )
    rel = relevance.select("query_id", "id").distinct().groupBy("query_id").agg(F.count(F.lit(1)).alias("n_rel"))
    joined = queries.select("query_id").join(got, "query_id", "left").join(rel, "query_id", "left").fillna(0)
    depth = F.least("n_rel", "n_ranked").cast("int")
    ideal = F.when(
        depth > 0,
        F.aggregate(F.sequence(F.lit(1), depth), F.lit(0.0), lambda acc, i: acc + 1 / F.log2(i + 1)),
    ).otherwise(0.0)

    def ratio(a: Column, b: Column) -> Column:
        return F.when(b > 0, a / b).otherwise(0.0)

    return joined.select(
        "query_id",
        F.round(ratio(F.col("n_hit"), F.col("n_ranked")), 6).alias("precision"),
        F.round(ratio(F.col("n_hit"), F.col("n_rel")), 6).alias("recall"),
        F.round(ratio(F.col("dcg"), ideal), 6).alias("ndcg"),
    )


def evaluate(queries: DataFrame, ranked: DataFrame, relevance: DataFrame) -> DataFrame:
    """Means over all queries, those without hits included."""
    return query_metrics(queries, ranked, relevance).agg(
        *[F.round(F.avg(c), 6).alias(c) for c in ("precision", "recall", "ndcg")]
    )
