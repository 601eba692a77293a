"""Texts whose words cancel each other in the hashed vector: SQL's cosine with a zero vector is NaN, above all numbers."""

import math
import shutil

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import check_oracles
from conftest import SMALL
from lodestar import workload
from lodestar.operators import embedding as D
from lodestar.operators import pivots as P
from lodestar.operators import search as S

NAMES = (
    "d03_blank_vectors e01_knn_documents e05_document_range e09_hybrid_search e10_shape_hits f01_rerank_default f02_bm25_candidates "
    "f03_rerank_overlap flagship_context g01_answer_envelope g01_process_vector g02_minmax g03_fuse_one_source g03_fuse_weighted "
    "g04_fuse_ensemble g05_fuse_cascade"
).split()


def cancelling(n: int) -> list[str]:
    """Pairs of words in one slot with opposite signs."""
    slots, words, found = D._Slots(64), {}, []
    for i in range(5000):
        words.setdefault(slots[f"w{i}"], f"w{i}")
    for slot in range(64):
        if slot in words and slot + 64 in words:
            found.append(f"{words[slot]} {words[slot + 64]}")
    assert not D.hashed_vectors(found, 64).any()
    return found[:n]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    target = tmp_path_factory.mktemp("zero")
    for name in check_oracles.TABLES:
        shutil.copyfile(f"{SMALL}/{name}.parquet", target / f"{name}.parquet")
    docs = pq.read_table(f"{SMALL}/documents.parquet")
    # Numbers divisible by 20 are queries of e05_document_range.
    made = [(100_000 + 5 * i, text, lang, "src1", len(text)) for i, (text, lang) in enumerate(zip(cancelling(6), ["en", "fr", "de", "es", "en", "fr"]))]
    more = pa.Table.from_pylist([dict(zip(("doc_id", "text", "lang", "source", "n_chars"), row)) for row in made]).select(docs.column_names).cast(docs.schema)
    pq.write_table(pa.concat_tables([docs, more]), target / "documents.parquet")
    return str(target)


@pytest.mark.parametrize("name", NAMES)
def test_cancelled_texts_are_as_in_sql(spark, folder, name):
    entry = workload.load()[name]
    assert check_oracles.compare(entry.run(spark, folder), check_oracles.duck(folder), entry.sql) is None


@pytest.mark.parametrize("limit", [1 << 20, 40])
def test_undefined_cosines(spark, tmp_path, limit):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 4)]) for i in range(200)] + [(200, [0.0] * 4), (201, [0.0] * 4)]
    corpus = spark.createDataFrame(rows, "id long, embedding array<double>").repartition(3)
    asked = spark.createDataFrame([(1, [1.0, 0.0, 0.0, 0.0]), (2, [0.0] * 4), (3, [0.0, 2.0, 1.0, 0.0])], "query_id long, embedding array<double>")
    plain = S.knn(asked, corpus, 5, min_score=0.9, block_bytes=limit)
    assert not plain.where("query_id = 2 or id >= 200").count()
    zeros = [i for i, v in rows if not any(v)][:5]
    P.build_pivots(corpus, str(tmp_path), P.choose_pivots(corpus, 3))
    index = P.PivotIndex.open(spark, str(tmp_path))
    for hits in (S.knn(asked, corpus, 5, min_score=0.9, block_bytes=limit, nan_first=True), index.search(asked, 0.9, 5, limit, nan_first=True)):
        got = {q: [(r.id, r.score) for r in sorted(hits.where(f"query_id = {q}").collect(), key=lambda r: r["rank"])] for q in (1, 2, 3)}
        assert [i for i, s in got[2]] == [0, 1, 2, 3, 4] and all(math.isnan(s) for _, s in got[2])
        for q in (1, 3):
            assert [i for i, s in got[q] if math.isnan(s)] == zeros and [i for i, _ in got[q]][: len(zeros)] == zeros
