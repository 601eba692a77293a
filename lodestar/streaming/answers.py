"""Streaming form of answer assembly: state per connection until its end arrives."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.conversations import FALLBACK_ANSWER

OUTPUT = "conn_id bigint, answer string, n_chunks bigint, stream_success boolean"
STATE = "seqs array<bigint>, chunks array<string>, err bigint, closed boolean"
NO_ERROR = -1


def _answer(key: tuple, seqs: list, chunks: list, err: int, ended: bool) -> pd.DataFrame:
    kept = [text for seq, text in sorted(zip(seqs, chunks)) if err == NO_ERROR or seq > err]
    failed = err != NO_ERROR and not kept
    return pd.DataFrame(
        {
            "conn_id": [key[0]],
            "answer": [FALLBACK_ANSWER if failed else "".join(kept)],
            "n_chunks": [len(kept)],
            "stream_success": [ended and not failed],
        }
    )


def _collect(timeout_ms: int):
    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seqs, chunks, err, closed = state.get if state.exists else ([], [], NO_ERROR, False)
        seqs, chunks = list(seqs), list(chunks)
        if state.hasTimedOut:
            state.remove()
            if not closed:
                yield _answer(key, seqs, chunks, err, False)
            return
        if closed:
            # Late events of an answer that is out: they only keep the mark alive.
            state.update(([], [], NO_ERROR, True))
            state.setTimeoutDuration(timeout_ms)
            return
        ended = False
        for frame in frames:
            for seq, kind, chunk in zip(frame["seq"], frame["type"], frame["chunk"]):
                if kind == "stream_chunk" and chunk:
                    seqs.append(int(seq))
                    chunks.append(chunk)
                elif kind == "error":
                    err = max(err, int(seq))
                elif kind == "stream_end":
                    ended = True
        if ended:
            yield _answer(key, seqs, chunks, err, True)
            state.update(([], [], NO_ERROR, True))
        else:
            state.update((seqs, chunks, err, False))
        state.setTimeoutDuration(timeout_ms)

    return run


def assemble_stream(events: DataFrame, timeout_ms: int = 60_000) -> DataFrame:
    """Events (conn_id, seq, type, chunk) → one row when a connection ends or falls silent.

    State holds one unfinished answer per open connection. Of a finished one only
    a mark stays until the timeout, so that a chunk that comes after the end is
    dropped and no connection is answered twice.
    Timeouts need empty micro-batches; a run with ``availableNow`` ends only with
    ``spark.sql.streaming.noDataMicroBatches.enabled`` set to false.
    """
    return events.select("conn_id", "seq", "type", "chunk").groupBy("conn_id").applyInPandasWithState(
        _collect(timeout_ms), OUTPUT, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout
    )
