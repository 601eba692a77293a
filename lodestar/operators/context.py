"""Ranked hits → the text blocks shown to a reader or a model.

Every list here is at most k hits long per query, so gathering it is bounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.strings import is_blank

NOTHING_FOUND = "No relevant information found."
NO_KNOWLEDGE = "No knowledge base results."
NO_DATABASE = "No database results."
# Fixed value: the answer given when neither side has anything.
NO_ANSWER = "Tôi không có đủ thông tin để trả lời câu hỏi này."


def _joined(entries: Column, separator: str) -> Column:
    """Ordered gather of struct(n, t) → text."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(entries)), lambda e: e["t"]), separator)


def _metadata_text(metadata: Column) -> Column:
    shown = F.array_sort(F.map_entries(F.map_filter(metadata, lambda k, _: ~k.isin("content", "text"))))
    return F.array_join(F.transform(shown, lambda e: F.concat(e["key"], F.lit(": "), F.coalesce(e["value"], F.lit("")))), ", ")


def format_context(queries: DataFrame, hits: DataFrame, with_metadata: bool = False) -> DataFrame:
    """``[Document i]: content`` blocks in rank order; a query without hits says so."""
    block = F.concat(F.lit("[Document "), F.col("rank").cast("string"), F.lit("]: "), F.coalesce("content", F.lit("")))
    if with_metadata:
        block = F.when(F.col("metadata").isNull(), block).otherwise(
            F.concat(block, F.lit("\n[Metadata]: "), _metadata_text(F.col("metadata")))
        )
    texts = hits.groupBy("query_id").agg(_joined(F.struct(F.col("rank").alias("n"), block.alias("t")), "\n\n").alias("context"))
    return queries.select("query_id").join(texts, "query_id", "left").fillna(NOTHING_FOUND, ["context"])


def prompt_context(hits: DataFrame, n: int, with_source: bool = False, by_score: bool = False) -> DataFrame:
    """First ``n`` documents; blank ones are skipped but keep their number."""
    order = [F.col("score").desc(), F.col("rank")] if by_score else [F.col("rank")]
    numbered = hits.withColumn("_i", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    head = [F.lit("Document "), F.col("_i").cast("string")]
    if with_source:
        head += [F.lit(" ("), F.coalesce("source_type", F.lit("document")), F.lit(")")]
    text = F.concat(*head, F.lit(":\n"), F.col("content"))
    shown = numbered.where((F.col("_i") <= n) & ~is_blank(F.col("content")))
    return shown.groupBy("query_id").agg(_joined(F.struct(F.col("_i").alias("n"), text.alias("t")), "\n\n").alias("context"))


def shape_sources(hits: DataFrame, score_col: str = "original_score") -> DataFrame:
    """Non-blank hits with title and the remaining metadata beside them."""
    title = F.coalesce(F.try_element_at("metadata", F.lit("title")), F.lit("Unknown document"))
    return hits.where(~is_blank(F.col("content"))).select(
        "query_id",
        F.coalesce(F.col("id").cast("string"), F.lit("")).alias("id"),
        "content",
        F.coalesce(F.col(score_col), F.lit(0.0)).alias("score"),
        title.alias("title"),
        F.map_filter("metadata", lambda k, _: k != "title").alias("metadata"),
        "rank",
    )


def source_summary(sources: DataFrame, shown: int = 3) -> DataFrame:
    """Counts per source type and a bullet list of the best ``shown`` sources."""
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("rank"))
    numbered = sources.withColumn("_i", F.row_number().over(w))
    line = F.format_string("• %s (source: %s, relevance: %.2f)", F.col("title"), F.coalesce("source_type", F.lit("unknown")), F.col("score"))
    entry = F.when(F.col("_i") <= shown, F.struct(F.col("_i").alias("n"), line.alias("t")))
    total = F.count(F.lit(1))
    more = F.when(total > shown, F.concat(F.lit("\n• ... and "), (total - shown).cast("string"), F.lit(" more sources"))).otherwise("")
    return numbered.groupBy("query_id").agg(
        F.count_if(F.col("source_type") == "vector").alias("n_vector"),
        F.count_if(F.col("source_type") == "graph").alias("n_graph"),
        F.count_if(F.col("source_type") == "hybrid").alias("n_hybrid"),
        F.concat(_joined(entry, "\n"), more).alias("top_sources"),
    )


def answer_envelope(queries: DataFrame, hits: DataFrame, reranked: DataFrame | None) -> DataFrame:
    """Per query: total and returned counts and whether a rerank took place."""
    total = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("total_results"))
    final = hits if reranked is None else reranked
    returned = final.groupBy("query_id").agg(F.count(F.lit(1)).alias("returned_results"))
    joined = queries.select("query_id").join(total, "query_id", "left").join(returned, "query_id", "left")
    filled = joined.fillna(0, ["total_results", "returned_results"])
    return filled.withColumn("reranked", F.lit(reranked is not None) & (F.col("total_results") > 0))


def combine_contexts(knowledge: DataFrame, database: DataFrame) -> DataFrame:
    """Knowledge hits (query_id, rank, row) and database answers (query_id, sql_query, row_no, row) side by side.

    ``row`` is a STRUCT or MAP that becomes JSON. A side without rows gets its
    placeholder; ``verdict`` holds the fixed answer when both are empty.
    """
    kb = knowledge.where(F.col("rank").isNotNull()).groupBy("query_id").agg(
        F.concat(
            F.lit("["), _joined(F.struct(F.col("rank").alias("n"), F.to_json("row").alias("t")), ","), F.lit("]")
        ).alias("kb")
    )
    entry = F.when(F.col("row_no").isNotNull(), F.struct(F.col("row_no").alias("n"), F.to_json("row").alias("t")))
    db = database.groupBy("query_id", "sql_query").agg(
        F.count("row_no").alias("n_rows"), F.concat(F.lit("["), _joined(entry, ","), F.lit("]")).alias("rows")
    )
    both = kb.join(db, "query_id", "full_outer")
    db_text = F.concat(F.lit("SQL query: "), F.col("sql_query"), F.lit("\n\nData results: "), F.col("rows"))
    empty = F.col("kb").isNull() & (F.coalesce("n_rows", F.lit(0)) == 0)
    return both.select(
        "query_id",
        F.coalesce("kb", F.lit(NO_KNOWLEDGE)).alias("kb_context"),
        F.coalesce(db_text, F.lit(NO_DATABASE)).alias("db_context"),
        F.when(empty, NO_ANSWER).alias("verdict"),
    )
