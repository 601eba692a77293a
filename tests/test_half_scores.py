"""Cosines that end in half a millionth: SQL rounds them away from zero."""

import shutil

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import check_oracles
from conftest import SMALL
from lodestar import workload
from lodestar.operators import embedding as D
from lodestar.operators import search as S

#: Counts of words in different slots, of lengths 8 and 16: the cosine is 125/128.
ASKED, FOUND = (7, 3, 2, 1, 1, 0), (13, 8, 2, 3, 3, 1)
NAMES = "e01_knn_documents e05_document_range e09_hybrid_search e10_shape_hits f01_rerank_default f03_rerank_overlap g02_minmax g03_fuse_one_source".split()


def spelled(counts) -> str:
    slots, words = D._Slots(64), {}
    for i in range(2000):
        words.setdefault(slots[f"w{i}"], f"w{i}")
    positive = [words[slot] for slot in range(64) if slot in words]
    return " ".join(word for word, n in zip(positive, counts) for _ in range(n))


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    target = tmp_path_factory.mktemp("half")
    for name in check_oracles.TABLES:
        shutil.copyfile(f"{SMALL}/{name}.parquet", target / f"{name}.parquet")
    docs, items = pq.read_table(f"{SMALL}/documents.parquet"), pq.read_table(f"{SMALL}/benchmark.parquet")
    made = [(100_000 + 20 * i, spelled(counts), "en", "src1", 9) for i, counts in enumerate((ASKED, FOUND))]
    more = pa.Table.from_pylist([dict(zip(("doc_id", "text", "lang", "source", "n_chars"), row)) for row in made]).select(docs.column_names).cast(docs.schema)
    pq.write_table(pa.concat_tables([docs, more]), target / "documents.parquet")
    last = items.slice(0, 1).to_pylist()[0] | {"text": spelled(ASKED)}
    pq.write_table(pa.concat_tables([items.slice(1), pa.Table.from_pylist([last]).select(items.column_names).cast(items.schema)]), target / "benchmark.parquet")
    return str(target)


def test_half_millionths_go_away_from_zero():
    scores = S.score_matrix(np.array([FOUND, FOUND]) * np.array([[1.0], [-1.0]]), np.array([ASKED], float), "cosine")
    assert scores.ravel().tolist() == [0.976563, -0.976563]


@pytest.mark.parametrize("name", NAMES)
def test_half_scores_are_as_in_sql(spark, folder, name):
    entry = workload.load()[name]
    assert check_oracles.compare(entry.run(spark, folder), check_oracles.duck(folder), entry.sql) is None
