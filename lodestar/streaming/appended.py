"""Answer assembly with appended state: chunks go to a list as they come and are read once, at the end.

Needs the RocksDB state store, which appends to a list without reading it;
``rocksdb`` sets it for the queries that start inside.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .answers import NO_ERROR, OUTPUT, _answer

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb(spark: SparkSession):
    """Streams that start inside keep their state in RocksDB; those that run already keep what they have."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


class AnswerAssembly(StatefulProcessor):
    """One connection: a list of its chunks, the place of its last error, and a mark that its answer is out."""

    def __init__(self, timeout_ms: int):
        self.timeout_ms = timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.chunks = handle.getListState("chunks", "seq long, chunk string")
        self.error = handle.getValueState("error", "seq long")
        # The mark goes by itself, so that connections that are done leave no state.
        self.done = handle.getValueState("done", "at long", ttlDurationMs=self.timeout_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        if self.done.exists():
            self.done.update((now,))  # late events only keep the mark alive
            return
        ended, error = False, self.error.get()[0] if self.error.exists() else NO_ERROR
        worst = error
        for frame in rows:
            added = []
            for seq, kind, chunk in zip(frame["seq"], frame["type"], frame["chunk"]):
                if kind == "stream_chunk" and chunk:
                    added.append((int(seq), chunk))
                elif kind == "error":
                    worst = max(worst, int(seq))
                elif kind == "stream_end":
                    ended = True
            if added:
                self.chunks.appendList(added)
        if worst != error:
            self.error.update((worst,))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if ended:
            yield self._out(key, worst, True)
            self.done.update((now,))
        else:
            self.handle.registerTimer(now + self.timeout_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._out(key, self.error.get()[0] if self.error.exists() else NO_ERROR, False)
        self.done.update((timerValues.getCurrentProcessingTimeInMs(),))

    def _out(self, key, error: int, ended: bool) -> pd.DataFrame:
        held = list(self.chunks.get()) if self.chunks.exists() else []
        self.chunks.clear()
        self.error.clear()
        return _answer(key, [seq for seq, _ in held], [text for _, text in held], error, ended)

    def close(self) -> None:
        pass


def assemble_appended(events: DataFrame, timeout_ms: int = 60_000) -> DataFrame:
    """Events (conn_id, seq, type, chunk) → one row when a connection ends or falls silent for ``timeout_ms``.

    A batch costs what it brings: chunks are appended, and a long answer is not
    written again with each of them. Events of an answer that is out are dropped
    for ``timeout_ms`` after the last of them. Start the query inside ``rocksdb``.
    """
    return events.select("conn_id", "seq", "type", "chunk").groupBy("conn_id").transformWithStateInPandas(
        AnswerAssembly(timeout_ms), OUTPUT, "append", "ProcessingTime"
    )
