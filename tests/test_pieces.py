"""Python workers make their objects for short runs of a batch, not for all of its rows."""

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestar.functions import pieces as P
from lodestar.operators import chunking as K
from lodestar.operators import embedding as D
from lodestar.operators import rerank as R


@pytest.mark.parametrize("limit, rows", [(1, 1000), (40, 1000), (1 << 20, 3), (1 << 20, 1000)])
def test_runs_are_bounded_and_whole(limit, rows):
    rng = np.random.default_rng(1)
    texts = [None if i % 9 == 0 else "x" * int(rng.integers(0, 60)) for i in range(200)]
    column = pa.array(["left out", *texts]).slice(1)
    found = list(P.runs(column, limit, rows))
    assert [x for run in found for x in run.to_pylist()] == texts
    for run in found:
        assert len(run) <= rows and (len(run) == 1 or sum(len(x or "") for x in run.to_pylist()) <= limit)
    assert list(P.runs(pa.array([], pa.string()))) == []


def test_a_task_is_given_short_runs(spark):
    def start():
        return lambda texts: pa.array([len(texts)] * len(texts), pa.int32())

    table = spark.range(9000).select(F.lit("a text").alias("text")).coalesce(1)
    longest = table.select(P.text_function("int", start)(F.col("text")).alias("n")).agg(F.max("n"), F.count("n")).first()
    assert tuple(longest) == (P.RUN_ROWS, 9000)


def test_rows_keep_their_own_results(spark):
    table = spark.range(5000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 7 > 0, F.concat_ws(" ", F.lit("word"), F.col("id"))).alias("text")).coalesce(1)
    chunks = {r.doc_id: (r.text, r.size) for r in K.chunk_fixed(table).collect()}
    assert chunks == {i: (f"word {i}", len(f"word {i}")) for i in range(5000) if i % 7}
    vectors = {r.doc_id: r.embedding for r in D.embed(table, "text", 16).collect()}
    assert np.array_equal([vectors[i] for i in range(5000)], D.hashed_vectors([f"word {i}" if i % 7 else None for i in range(5000)], 16).astype(np.float32))


class Here:
    """Stands for a corpus: a scan of its one batch runs in this process."""

    def __init__(self, batch):
        self.batch = batch
        self.sparkSession = self.sparkContext = self

    def broadcast(self, value):
        self.value = value
        return self

    def mapInArrow(self, scan, schema):
        return list(scan(iter([self.batch])))


def test_bm25_holds_few_tokens_and_cells(monkeypatch):
    seen, scores = [], R._bm25_scores

    def counted(tokens, wanted, starts, owners, weights, n_queries, mean_length):
        seen.append((len(tokens), len(tokens.flatten()), len(tokens) * n_queries))
        return scores(tokens, wanted, starts, owners, weights, n_queries, mean_length)

    monkeypatch.setattr(R, "_bm25_scores", counted)
    batch = pa.record_batch({"id": pa.array(range(3000)), "tokens": pa.array([["a", "b"] * (i % 200) for i in range(3000)], pa.list_(pa.string()))})
    head = pd.DataFrame({"query_id": range(500), "term": "a", "weight": 1.0})
    R._scan_bm25(head, Here(batch), 3, 200.0, None)
    assert sum(n for n, _, _ in seen) == 3000
    assert max(t for _, t, _ in seen) <= R.RUN_TOKENS and max(c for _, _, c in seen) <= R.RUN_CELLS
