"""Arrow columns of long texts, a bounded number of bytes at a time.

Spark hands a Python worker up to ten thousand rows at once, however long their
texts. The rows of a batch stay in Arrow's buffers; Python's own objects, and the
results, are made for a short run of them at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes of text, and rows, of a run; a longer text is a run of its own.
RUN_BYTES, RUN_ROWS = 1 << 20, 1024


def cut(sizes: np.ndarray, limit: int, rows: int) -> Iterator[tuple[int, int]]:
    """(start, length) of runs of at most ``rows`` rows whose sizes add up to at most ``limit``, or of one row."""
    ends = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        before = int(ends[at - 1]) if at else 0
        stop = min(at + rows, max(at + 1, int(np.searchsorted(ends, before + limit, "right"))))
        yield at, stop - at
        at = stop


def runs(texts: pa.Array, limit: int = RUN_BYTES, rows: int = RUN_ROWS) -> Iterator[pa.Array]:
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    for at, length in cut(sizes, limit, rows):
        yield texts.slice(at, length)


def text_function(kind: str, start: Callable[[], Callable[[list[str | None]], pa.Array]]) -> Callable[[Column], Column]:
    """A column function of one text column; ``start`` gives each task its function from a run of texts to an Arrow array."""

    @F.arrow_udf(kind)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        made = start()
        for batch in batches:
            for texts in runs(batch):
                yield made(texts.to_pylist())

    return run
