import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.operators import context as X
from lodestar.operators import fusion as U
from lodestar.operators import rerank as R

DOCS = {
    "a": "routers forward packets between networks",
    "b": "switches forward frames inside one network",
    "c": "the the the quick router",
    "d": "",
    "e": "bread needs flour water and salt",
}
QUERIES = {1: "router forward forward", 2: "the salt", 3: "nothing matches"}


def okapi(docs, query):
    tokens = {i: d.lower().split() for i, d in docs.items()}
    n, mean = len(docs), sum(map(len, tokens.values())) / len(docs)
    df = {}
    for words in tokens.values():
        for w in set(words):
            df[w] = df.get(w, 0) + 1
    idf = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    floor = 0.25 * sum(idf.values()) / len(idf)
    idf = {w: floor if v < 0 else v for w, v in idf.items()}
    out = {}
    for i, words in tokens.items():
        s = 0.0
        for q in query.lower().split():
            tf = words.count(q)
            s += idf.get(q, 0) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(words) / mean))
        out[i] = round(s, 6)
    return sorted(out.items(), key=lambda x: (-x[1], x[0]))


@pytest.fixture(scope="module")
def frames(spark):
    docs = spark.createDataFrame(list(DOCS.items()), "doc_id string, text string")
    queries = spark.createDataFrame(list(QUERIES.items()), "query_id long, query_text string")
    return docs, queries


def listed(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.id, r.score))
    return out


def test_bm25_over_the_corpus(frames):
    docs, queries = frames
    got = listed(R.bm25_corpus(queries, docs, 4, query_text="query_text"))
    assert got == {q: okapi(DOCS, text)[:4] for q, text in QUERIES.items()}


def test_bm25_over_candidates(frames):
    docs, queries = frames
    pick = {1: ["a", "b", "c"], 2: ["c", "d", "e"], 3: ["a", "e"]}
    rows = [(q, i, DOCS[i], 0.5) for q, ids in pick.items() for i in ids]
    hits = docs.sparkSession.createDataFrame(rows, "query_id long, id string, content string, score double")
    got = R.rerank(hits, queries, "BM25", 10)
    assert listed(got) == {q: okapi({i: DOCS[i] for i in ids}, QUERIES[q]) for q, ids in pick.items()}
    assert {r.original_score for r in got.collect()} == {0.5}


def test_statistics_serve_several_batches(frames):
    docs, queries = frames
    stats = R.corpus_statistics(docs)
    assert stats.n == 5
    one = listed(R.bm25_corpus(queries.where("query_id = 1"), docs, 3, query_text="query_text", statistics=stats))
    assert one[1] == okapi(DOCS, QUERIES[1])[:3]


def test_failing_model_keeps_the_old_score(frames):
    docs, queries = frames
    rows = [(1, "a", DOCS["a"], 0.2), (1, "b", DOCS["b"], 0.9)]
    hits = docs.sparkSession.createDataFrame(rows, "query_id long, id string, content string, score double")

    def broken():
        def predict(queries, texts):
            raise RuntimeError("no model")

        return predict

    def by_length():
        return lambda queries, texts: np.array([len(x) for x in texts], dtype=float)

    kept = R.rerank(hits, queries, "cross_encoder", 2, scorer=R.pair_model(broken))
    assert [i for i, _ in listed(kept)[1]] == ["b", "a"]
    scored = R.rerank(hits, queries, "cross_encoder", 2, scorer=R.pair_model(by_length))
    assert listed(scored)[1][0] == ("b", float(len(DOCS["b"])))
    assert [i for i, _ in listed(R.rerank(hits, queries, "cross_encoder", 2))[1]] == ["b", "a"]


def test_mmr_without_diversity_is_plain_order(spark):
    rng = np.random.default_rng(1)
    rows = [(q, i, float(s), [float(x) for x in rng.normal(size=4)]) for q in (1, 2) for i, s in enumerate(np.round(rng.random(12), 3))]
    hits = spark.createDataFrame(rows, "query_id long, id long, score double, embedding array<double>")
    plain = R.rerank_default(hits, 6)
    assert listed(R.mmr(hits, 6, 0.0)) == listed(plain)
    twins = spark.createDataFrame(
        [(1, 1, 1.0, [1.0, 0.0]), (1, 2, 0.99, [1.0, 0.0]), (1, 3, 0.5, [0.0, 1.0])], "query_id long, id long, score double, embedding array<double>"
    )
    assert [i for i, _ in listed(R.mmr(twins, 2, 0.5))[1]] == [1, 3]


def test_metrics_by_hand(spark):
    queries = spark.createDataFrame([(1,), (2,), (3,)], "query_id long")
    ranked = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", 3), (2, "x", 1)], "query_id long, id string, rank int")
    relevance = spark.createDataFrame([(1, "a"), (1, "c"), (1, "z"), (1, "z"), (3, "q")], "query_id long, id string")
    rows = {r.query_id: r for r in R.query_metrics(queries, ranked, relevance).collect()}
    ideal = 1 + 1 / math.log2(3) + 1 / math.log2(4)
    assert rows[1].precision == round(2 / 3, 6) and rows[1].recall == round(2 / 3, 6)
    assert rows[1].ndcg == round((1 + 1 / math.log2(4)) / ideal, 6)
    assert (rows[2].precision, rows[2].recall, rows[2].ndcg) == (0.0, 0.0, 0.0)
    assert (rows[3].precision, rows[3].recall, rows[3].ndcg) == (0.0, 0.0, 0.0)
    assert R.evaluate(queries, ranked, relevance).first().precision == round(round(2 / 3, 6) / 3, 6)


HITS = "query_id long, id string, content string, score double, rank int"


def test_fusion_weights_one_and_zero(spark):
    v = spark.createDataFrame([(1, "a", "one", 0.9, 1), (1, "b", "two", 0.5, 2)], HITS)
    g = spark.createDataFrame([(1, "g", "three", 5.0, 1), (1, "h", " ONE ", 1.0, 2)], HITS)
    full = U.fuse_weighted(v, g, 10, 1.0, 0.0).orderBy("rank").collect()
    assert [r.id for r in full] == ["a", "b", "g"]
    with pytest.raises(ValueError):
        U.fuse_weighted(v, g, 10, 1.5, 0.0)
    mixed = U.fuse("ensemble", v, g, 10, dedup=False).orderBy("rank").collect()
    assert [r.id for r in mixed] == ["a", "g", "b", "h"]
    assert [r.id for r in U.fuse("ensemble", v, g, 10).orderBy("rank").collect()] == ["a", "g", "b"]


def test_cascade_gate(spark):
    v = spark.createDataFrame([(1, "a", "same", 0.9, 1), (1, "b", "same", 0.8, 2), (2, "c", "x", 0.9, 1), (2, "d", "y", 0.1, 2)], HITS)
    g = spark.createDataFrame([(1, "g", "p", 1.0, 1), (2, "h", "q", 1.0, 1)], HITS)
    rows = U.fuse_cascade(v, g, 2).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.id) for r in rows] == [(1, "a"), (1, "b"), (2, "c"), (2, "d")]
    rows = U.fuse_cascade(v, g, 3).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.id) for r in rows] == [(1, "a"), (1, "g"), (2, "c"), (2, "d"), (2, "h")]


def test_dedup_is_exact_with_a_hot_passage(spark):
    rows = spark.range(9000).select(
        F.lit(1).alias("query_id"), "id", F.when(F.col("id") % 3 == 0, "hot passage").otherwise(F.col("id").cast("string")).alias("content")
    )
    assert U.dedup_prefix(rows, ["id"]).count() == 6001


def test_empty_context(spark):
    queries = spark.createDataFrame([(1,), (2,)], "query_id long")
    hits = spark.createDataFrame([(1, "a", "text", 0.1, 1)], HITS)
    rows = {r.query_id: r.context for r in X.format_context(queries, hits).collect()}
    assert rows == {1: "[Document 1]: text", 2: X.NOTHING_FOUND}


def test_combined_contexts_when_both_are_empty(spark):
    kb = spark.createDataFrame([], "query_id long, rank int, row struct<a:int>")
    db = spark.createDataFrame([(1, "SELECT 1", None, None)], "query_id long, sql_query string, row_no int, row struct<a:int>")
    row = X.combine_contexts(kb, db).first()
    assert row.verdict == X.NO_ANSWER and row.kb_context == X.NO_KNOWLEDGE
    assert row.db_context == "SQL query: SELECT 1\n\nData results: []"
