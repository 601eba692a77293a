import time

import pytest
from pyspark.sql import functions as F

from lodestar.operators.conversations import FALLBACK_ANSWER, assemble_stream
from lodestar.plans.ingestion import index_chunks, pages_to_documents
from lodestar.streaming import answers, appended, ingest

DOC = "doc_id long, text string"


def rows(df):
    return sorted((r.chunk_id, r.doc_id, r.chunk_index, r.text, tuple(r.embedding)) for r in df.collect())


def test_stream_equals_batch_and_redelivery_is_nothing_new(spark, t, tmp_path):
    docs = t("documents").select("doc_id", "text")
    source, sink, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    docs.repartition(3).write.parquet(source)

    def run():
        ingest.ingest_stream(spark, source, DOC, sink, checkpoint, max_files=1, size=200, overlap=20).awaitTermination()
        return rows(ingest.current(spark, sink))

    want = rows(index_chunks(docs, 200, 20))
    assert run() == want
    docs.limit(40).write.mode("append").parquet(source)
    assert run() == want
    target = str(tmp_path / "small")
    ingest.compact(spark, sink, target)
    assert rows(ingest.current(spark, target)) == want


def test_a_shorter_version_retires_old_chunks(spark, tmp_path):
    sink = str(tmp_path / "sink")
    ingest.write_batch(spark.createDataFrame([(1, "a b c d e f"), (2, "x y")], DOC), 0, sink, size=2, overlap=0)
    ingest.write_batch(spark.createDataFrame([(1, "a b")], DOC), 1, sink, size=2, overlap=0)
    got = sorted((r.doc_id, r.text) for r in ingest.current(spark, sink).collect())
    assert got == [(1, "a b"), (2, "x y")]
    # The same batch again, as after a failure.
    ingest.write_batch(spark.createDataFrame([(1, "a b")], DOC), 1, sink, size=2, overlap=0)
    assert ingest.current(spark, sink).count() == 2


def test_pages_feed_the_same_plan(t):
    made = index_chunks(pages_to_documents(t("pages").select("url", "html")), 50, 10)
    assert made.count() > t("pages").count()
    assert made.where(F.contains("text", F.lit("<p>"))).isEmpty()


EVENTS = "conn_id long, seq long, type string, chunk string"


@pytest.mark.parametrize("assemble", [answers.assemble_stream, appended.assemble_appended])
def test_answers_across_batches(spark, tmp_path, assemble):
    # State timeouts ask for empty batches without end; a run that should stop forgoes them.
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    first = [(1, 1, "stream_chunk", "Hel"), (2, 1, "stream_chunk", "lost"), (1, 3, "stream_chunk", "!"), (3, 1, "error", None), (1, 0, "stream_start", None)]
    second = [(1, 2, "stream_chunk", "lo"), (2, 2, "error", None), (2, 3, "stream_chunk", "fallback"), (1, 4, "stream_end", None), (1, 5, "stream_chunk", "")]
    third = [(2, 4, "stream_end", None), (3, 2, "stream_end", None)]
    source = str(tmp_path / "events")
    for part in (first, second, third):
        spark.createDataFrame(part, EVENTS).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(source)
    with appended.rocksdb(spark):
        query = (
            assemble(stream).writeStream.format("memory").queryName("assembled").outputMode("append")
            .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        )
        assert query.awaitTermination(60)
    got = sorted(map(tuple, spark.table("assembled").collect()))
    want = assemble_stream(spark.createDataFrame(first + second + third, EVENTS))
    assert got == sorted(map(tuple, want.collect()))
    assert (1, "Hello!", 3, True) in got and (2, "fallback", 1, True) in got and (3, FALLBACK_ANSWER, 0, False) in got


def test_a_silent_connection_is_given_out_and_late_events_are_dropped(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    source, out = str(tmp_path / "events"), str(tmp_path / "out")

    def deliver(rows):
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(source)
        with appended.rocksdb(spark):
            stream = appended.assemble_appended(spark.readStream.schema(EVENTS).parquet(source), 1500)
            stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()

    deliver([(1, 1, "stream_chunk", "half"), (2, 1, "stream_chunk", "whole"), (2, 2, "stream_end", None)])
    time.sleep(2)
    deliver([(2, 3, "stream_chunk", "late"), (3, 1, "stream_chunk", "x"), (3, 2, "stream_end", None)])
    got = sorted((r.conn_id, r.answer, r.stream_success) for r in spark.read.parquet(out).collect())
    assert got == [(1, "half", False), (2, "whole", True), (3, "x", True)]
