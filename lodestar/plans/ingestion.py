"""Documents and pages → indexed chunks. The same plan serves batch and stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.html import html_to_text, normalise_paragraphs, page_metadata, url_doc_id
from ..operators.chunking import chunk_tokens, with_chunk_ids
from ..operators.collections import latest_per_key
from ..operators.embedding import hash_embedder


def pages_to_documents(pages: DataFrame, fetch_time: Column | None = None) -> DataFrame:
    """(url, html) → (doc_id, text, metadata)."""
    return pages.select(
        url_doc_id(F.col("url")).alias("doc_id"),
        normalise_paragraphs(html_to_text(F.col("html"))).alias("text"),
        page_metadata(F.col("url"), F.col("html"), fetch_time).alias("metadata"),
    )


def one_version(docs: DataFrame, order_col: str | None) -> DataFrame:
    """One row per document: the highest ``order_col``, else the greatest text."""
    order = ([F.col(order_col).desc()] if order_col else []) + [F.col("text").desc()]
    return latest_per_key(docs, ["doc_id"], order)


def index_chunks(docs: DataFrame, size: int = 500, overlap: int = 100, embedder: Callable[[Column], Column] | None = None, order_col: str | None = None) -> DataFrame:
    """(chunk_id, doc_id, chunk_index, text, start, end, size, embedding), one version per document."""
    chunks = with_chunk_ids(chunk_tokens(one_version(docs, order_col), size=size, overlap=overlap), "tokens")
    return chunks.withColumn("embedding", (embedder or hash_embedder())(F.col("text"))).drop("source_ids")
