"""Conversations and chat events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The modes a request may name, and the answer given when none could be made.
MODES = ("vector", "graph", "hybrid_rag", "database", "hybrid")
FALLBACK_ANSWER = "Tôi không thể xử lý câu hỏi của bạn lúc này. Vui lòng thử lại sau."


def assemble_stream(events: DataFrame) -> DataFrame:
    """Events (conn_id, seq, type, chunk) → the full answer of each connection.

    Empty chunks are skipped. After an ``error`` the next chunk is the fallback
    text and replaces everything before it. Without an end the stream failed.
    The gathered value is the answer itself, so it is as long as the result is.
    """
    entry = F.when(
        (F.col("type") == "stream_chunk") & (F.coalesce("chunk", F.lit("")) != ""), F.struct("seq", "chunk")
    )
    folded = events.groupBy("conn_id").agg(
        F.array_sort(F.collect_list(entry)).alias("chunks"),
        F.max(F.when(F.col("type") == "stream_end", 1).otherwise(0)).alias("ended"),
        F.max(F.when(F.col("type") == "error", F.col("seq"))).alias("err"),
    )
    err = F.col("err")
    used = folded.withColumn("used", F.filter("chunks", lambda e: err.isNull() | (e["seq"] > err)))
    n, failed = F.size("used"), err.isNotNull() & (F.size("used") == 0)
    answer = F.when(failed, F.lit(FALLBACK_ANSWER)).otherwise(F.array_join(F.transform("used", lambda e: e["chunk"]), ""))
    return used.select(
        "conn_id",
        answer.alias("answer"),
        n.cast("bigint").alias("n_chunks"),
        ((F.col("ended") == 1) & ~failed).alias("stream_success"),
    )


def trim_history(conversations: DataFrame, n: int = 20) -> DataFrame:
    """System turns, then the last ``n`` other turns. The limit is cut on the map side."""
    system = conversations.where(F.col("role") == "system")
    w = Window.partitionBy("conv_id").orderBy(F.col("turn").desc())
    rest = conversations.where(F.col("role") != "system").withColumn("_rn", F.row_number().over(w))
    return system.unionByName(rest.where(F.col("_rn") <= n).drop("_rn"))


def clear_history(conversations: DataFrame) -> DataFrame:
    return conversations.where(F.col("role") == "system")


def route_requests(requests: DataFrame, mode_col: str = "mode") -> tuple[DataFrame, DataFrame]:
    """(routed, errors): a missing mode means ``vector``, an unknown one is an error row."""
    mode = F.coalesce(F.col(mode_col), F.lit("vector"))
    tagged = requests.withColumn("route", mode)
    known = mode.isin(*MODES)
    message = F.concat(F.lit("Invalid mode: "), mode, F.lit(". Valid options are: " + ", ".join(MODES)))
    return tagged.where(known), tagged.where(~known).withColumn("message", message)


def step_latency(events: DataFrame, id_col: str, ts_col: str, step_col: str) -> DataFrame:
    """Per request: steps, distinct steps and seconds from first to last."""
    return events.groupBy(id_col).agg(
        F.count(F.lit(1)).alias("n_steps"),
        F.count_distinct(step_col).alias("n_step_kinds"),
        F.min(ts_col).alias("started"),
        F.max(ts_col).alias("finished"),
        (F.timestamp_diff("MICROSECOND", F.min(ts_col), F.max(ts_col)) / 1e6).alias("seconds"),
    )


def latency_quantiles(latencies: DataFrame, seconds_col: str) -> DataFrame:
    return latencies.agg(
        F.percentile_approx(seconds_col, 0.5).alias("p50"),
        F.percentile_approx(seconds_col, 0.95).alias("p95"),
    )


def latency_sketches(events: DataFrame, ts_col: str, seconds_col: str, unit: str = "hour", k: int = 200) -> DataFrame:
    """(span, n, sketch): a KLL sketch of the latencies of each ``unit`` of time.

    Sketches are a few kilobytes, however many values they hold, and merge: store
    them once and ask for any span. A rank is off by about 1.33 % for k = 200.
    """
    span = events.select(F.date_trunc(unit, F.col(ts_col)).alias("span"), F.col(seconds_col).cast("double").alias("x")).where("x IS NOT NULL")
    return span.groupBy("span").agg(F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double("x", k).alias("sketch"))


def merged_quantiles(sketches: DataFrame, quantiles: list[float], by: list[Column] | None = None) -> DataFrame:
    """``n`` and the quantiles (``p50`` for 0.5, …) of the merged sketches, over all spans or by groups of them."""
    merged = sketches.groupBy(*(by or [])).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("_all"))
    named = [F.kll_sketch_get_quantile_double("_all", F.lit(float(q))).alias(f"p{round(100 * q):02d}") for q in quantiles]
    return merged.select(*(c for c in merged.columns if c != "_all"), *named)


def rank_of(sketches: DataFrame, value: float) -> DataFrame:
    """One row: the share of values up to ``value`` by the merged sketches."""
    return sketches.agg(F.kll_sketch_get_rank_double(F.kll_merge_agg_double("sketch"), F.lit(float(value))).alias("rank"))
