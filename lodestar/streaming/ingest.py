"""Incremental ingestion: files arrive, chunks appear, a second delivery changes nothing.

Without a table format that can merge, every micro-batch owns one folder under
``chunks`` and one under ``docs``. Both are overwritten when the batch is run
again after a failure, and ``docs`` is written last, so a half-written batch is
never seen. ``current`` joins the two: of each document only its newest delivery
counts, which also retires the chunks of a longer older version.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..plans.ingestion import index_chunks, one_version


def write_batch(docs: DataFrame, batch_id: int, sink: str, embedder: Callable[[Column], Column] | None = None, **chunking) -> None:
    chunks = index_chunks(docs, embedder=embedder, **chunking)
    chunks.write.mode("overwrite").parquet(f"{sink}/chunks/batch_id={batch_id}")
    one_version(docs, chunking.get("order_col")).select("doc_id").write.mode("overwrite").parquet(f"{sink}/docs/batch_id={batch_id}")


def ingest_stream(
    spark: SparkSession, source: str, schema: StructType | str, sink: str, checkpoint: str, file_format: str = "parquet",
    max_files: int | None = None, embedder: Callable[[Column], Column] | None = None, available_now: bool = True, **chunking,
) -> StreamingQuery:
    """Start the stream of (doc_id, text, …) files from ``source`` into ``sink``."""
    reader = spark.readStream.format(file_format).schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    writer = (
        reader.load(source)
        .writeStream.foreachBatch(lambda df, batch_id: write_batch(df, batch_id, sink, embedder, **chunking))
        .option("checkpointLocation", checkpoint)
    )
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def current(spark: SparkSession, sink: str) -> DataFrame:
    """Chunks of the newest delivery of every document."""
    newest = spark.read.parquet(f"{sink}/docs").groupBy("doc_id").agg(F.max("batch_id").alias("batch_id"))
    return spark.read.parquet(f"{sink}/chunks").join(newest, ["doc_id", "batch_id"], "left_semi").drop("batch_id")


def compact(spark: SparkSession, sink: str, target: str) -> None:
    """Write the current chunks as batch 0 of a new sink folder."""
    current(spark, sink).write.mode("errorifexists").parquet(f"{target}/chunks/batch_id=0")
    newest = spark.read.parquet(f"{sink}/docs").select("doc_id").distinct()
    newest.write.mode("errorifexists").parquet(f"{target}/docs/batch_id=0")
