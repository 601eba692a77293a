"""Retrievers: one ``retrieve(queries, k)`` for vector, graph, community and hybrid search.

``queries`` is a table (query_id, query_text); hits are (query_id, id, content,
score, rank, …).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import communities, context, fusion, graph, rerank, search
from .registry import embedder_named

LISTED = ["query_id", "id", "content", "score", "rank"]


def _embedded(queries: DataFrame, embedder: Callable[[Column], Column]) -> DataFrame:
    return queries.select("query_id", "query_text", embedder(F.col("query_text")).alias("embedding"))


@dataclass
class VectorRetriever:
    """``corpus``: (id, content, embedding, payload columns used in filters). ``nan_first``: as in exact search."""

    corpus: DataFrame
    embedder: Callable[[Column], Column]
    filters: dict = field(default_factory=dict)
    min_score: float | None = None
    approximate: bool = False
    nan_first: bool = False

    def retrieve(self, queries: DataFrame, k: int) -> DataFrame:
        asked = _embedded(queries, self.embedder)
        if self.approximate:
            hits = search.knn_approx(asked, search.filtered(self.corpus, self.filters), k)
            if self.min_score is not None:
                hits = hits.where(F.col("score") >= self.min_score)
        else:
            hits = search.knn(asked, self.corpus, k, filters=self.filters, min_score=self.min_score, nan_first=self.nan_first)
        return search.fetch(hits, self.corpus.select("id", "content")).select(*LISTED)


@dataclass
class GraphRetriever:
    """``entities``: (name, embedding); ``edges``: (subject, predicate, object, description)."""

    entities: DataFrame
    edges: DataFrame
    embedder: Callable[[Column], Column]
    seeds: int = 5
    min_score: float = 0.7

    def retrieve(self, queries: DataFrame, k: int) -> DataFrame:
        asked = _embedded(queries, self.embedder)
        return graph.graph_retrieve(asked, self.entities, self.edges, k, self.seeds, self.min_score)


@dataclass
class CommunityRetriever:
    """Summaries of the communities named in texts found by another retriever."""

    notes: VectorRetriever
    membership: DataFrame
    summaries: DataFrame
    notes_k: int = 20

    def retrieve(self, queries: DataFrame, k: int) -> DataFrame:
        found = self.notes.retrieve(queries, self.notes_k)
        named = graph.entity_mentions(found, "query_id", "content").distinct()
        answers = communities.community_retrieve(named, self.membership, self.summaries)
        hits = answers.select(
            "query_id", F.col("community_id").alias("id"), F.col("summary").alias("content"), F.lit(1.0).alias("score")
        )
        return rerank.rerank_default(hits, k).select(*LISTED)


@dataclass
class HybridRetriever:
    """Either source may be missing; the other one then stands alone."""

    vector: VectorRetriever | None
    graph: GraphRetriever | None
    strategy: str = "weighted"
    vector_weight: float = 0.5
    graph_weight: float = 0.5
    dedup: bool = True

    def retrieve(self, queries: DataFrame, k: int) -> DataFrame:
        if self.vector is None and self.graph is None:
            raise ValueError("a hybrid retriever needs at least one source")
        v = self.vector.retrieve(queries, k).select(*[F.col(c).cast("string") if c == "id" else F.col(c) for c in LISTED]) if self.vector else None
        g = self.graph.retrieve(queries, k).select(*LISTED) if self.graph else None
        v = g.limit(0) if v is None else v
        g = v.limit(0) if g is None else g
        options = {"dedup": self.dedup}
        if self.strategy not in ("ensemble", "cascade"):
            options.update(vector_weight=self.vector_weight, graph_weight=self.graph_weight)
        return fusion.fuse(self.strategy, v, g, k, **options)


KINDS: dict[str, type] = {
    "vector": VectorRetriever,
    "graph": CommunityRetriever,
    "graph_v2": GraphRetriever,
    "hybrid": HybridRetriever,
}


def create_retriever(kind: str, **config):
    """Build a retriever by name; ``embedder`` may be given by its registered name."""
    if kind not in KINDS:
        raise ValueError(f"retriever kind is one of {sorted(KINDS)}")
    if isinstance(config.get("embedder"), str):
        config["embedder"] = embedder_named(config["embedder"])
    return KINDS[kind](**config)


def process(queries: DataFrame, retriever, k: int = 10, strategy: str | None = "default", rerank_k: int | None = None, **options) -> tuple[DataFrame, DataFrame]:
    """(documents, envelope): retrieve and, unless ``strategy`` is None, rerank to ``rerank_k`` or k."""
    hits = retriever.retrieve(queries, k)
    if strategy is None:
        return hits, context.answer_envelope(queries, hits, None)
    flat = hits.select("query_id", "id", "content", "score")
    best = rerank.rerank(flat, queries, strategy, rerank_k or k, **options)
    return best, context.answer_envelope(queries, hits, best)
