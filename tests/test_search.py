import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.operators import embedding as D
from lodestar.operators import search as S
from lodestar.workload.vectors import _vec, centroids


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(5)
    corpus = [(f"d{i:03d}", [float(x) for x in rng.integers(-2, 3, 6)], i % 3) for i in range(300)]
    corpus += [(f"copy{i:03d}", corpus[0][1], 0) for i in range(150)]  # A third are copies.
    corpus.append(("zero", [0.0] * 6, 1))
    queries = [(i, [float(x) for x in rng.integers(-2, 3, 6)]) for i in range(9)] + [(9, corpus[0][1])]
    c = spark.createDataFrame(corpus, "id string, embedding array<float>, label int").repartition(5)
    q = spark.createDataFrame(queries, "query_id long, embedding array<float>")
    return corpus, queries, c, q


def brute(corpus, queries, k, metric, keep=lambda r: True, floor=None):
    out = {}
    for qid, qv in queries:
        scored = []
        for id_, v, label in corpus:
            if not keep(label):
                continue
            a, b = np.array(qv), np.array(v)
            if metric == "dot":
                s = a @ b
            elif metric == "euclid":
                s = -np.linalg.norm(a - b)
            else:
                n = np.linalg.norm(a) * np.linalg.norm(b)
                s = a @ b / n if n else 0.0
            s = round(float(s), 6) + 0.0
            if floor is None or s >= floor:
                scored.append((-s, id_))
        out[qid] = [(i, abs(s) if metric == "euclid" else -s + 0.0) for s, i in sorted(scored)[:k]]
    return {q: h for q, h in out.items() if h}


def listed(hits):
    out = {}
    for r in hits.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.id, r.score))
    return out


@pytest.mark.parametrize("metric", S.METRICS)
@pytest.mark.parametrize("limit", [1 << 20, 150])
def test_exact_search(data, metric, limit):
    corpus, queries, c, q = data
    assert listed(S.knn(q, c, 7, metric, block_bytes=limit)) == brute(corpus, queries, 7, metric)


def test_a_block_for_each_query(data):
    corpus, queries, c, q = data
    assert listed(S.knn(q, c, 7, block_bytes=1)) == brute(corpus, queries, 7, "cosine")


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_fetch_by_either_way(data, limit):
    _, _, c, q = data
    hits = S.knn(q, c, 3)
    got = S.fetch(hits, c.select("id", "label"), limit=limit)
    assert sorted(map(tuple, got.select(*hits.columns, "label").collect())) == sorted(
        map(tuple, hits.join(c.select("id", "label"), "id").select(*hits.columns, "label").collect())
    )


def test_filter_and_threshold_both_apply(data):
    corpus, queries, c, q = data
    got = listed(S.knn(q, c, 5, filters={"label": 1}, min_score=0.5))
    assert got == brute(corpus, queries, 5, "cosine", lambda label: label == 1, 0.5)


def test_overfetch(data):
    corpus, queries, c, q = data
    want = {i: [x for x in h if x[1] >= 0.6][:4] for i, h in brute(corpus, queries, 8, "cosine").items()}
    assert listed(S.knn_overfetch(q, c, 4, 0.6)) == {i: h for i, h in want.items() if h}


def test_no_queries_no_hits(data):
    _, _, c, q = data
    assert S.knn(q.where("false"), c, 3).count() == 0
    assert S.knn(q, c.where("false"), 3).count() == 0


def test_approximate_search(t, monkeypatch):
    queries, corpus = centroids(t), _vec(t, "embeddings")
    exact = S.knn(queries, corpus, 10)
    approx = S.knn_approx(queries, corpus, 10, cells=8, nprobe=4)
    assert S.recall_at_k(approx, exact).first().recall >= 0.8
    # All cells probed is exact, also when crowded cells are split.
    monkeypatch.setattr(S, "CELL_BYTES", 50 * 8 * 64)
    monkeypatch.setattr(S, "PROBE_BYTES", 2 * 8 * 64)
    assert listed(S.knn_approx(queries, corpus, 10, cells=4, nprobe=4)) == listed(exact)


def test_benchmark_passages_find_their_documents(t):
    """A passage that stands in a document is found near the top of the chunk search."""
    from lodestar.operators import chunking as K

    passages = t("benchmark").select(F.col("item_id").alias("query_id"), "text")
    chunks = K.chunk_tokens(t("documents"), size=50, overlap=25)
    named = chunks.select(F.concat_ws("/", "doc_id", "chunk_index").alias("id"), "doc_id", "text")
    hits = S.knn(D.embed(passages, "text"), D.embed(named, "text"), 10)
    found = hits.join(named.select("id", "doc_id"), "id")
    holds = t("documents").select("doc_id", F.col("text").alias("body"))
    inside = passages.join(holds, F.contains("body", "text")).select("query_id", "doc_id")
    n = inside.select("query_id").distinct().count()
    good = found.join(inside, ["query_id", "doc_id"], "left_semi").select("query_id").distinct().count()
    assert n == 0 or good >= 0.8 * n


def test_embedding_is_repeatable_and_blank_is_zero(spark):
    df = spark.createDataFrame([(1, "Alpha beta"), (2, "alpha  BETA"), (3, " "), (4, None)], "id int, text string")
    rows = {r.id: r.embedding for r in D.embed(df, "text", 16).collect()}
    assert rows[1] == rows[2] and not any(rows[3]) and not any(rows[4])
    assert abs(sum(x * x for x in rows[1]) - 1) < 1e-6


def test_model_hook_sees_no_blanks(spark):
    def load():
        def encode(texts):
            assert all(x.strip() for x in texts)
            return np.array([[len(x), 1.0] for x in texts])

        return encode

    df = spark.createDataFrame([(1, "abc"), (2, ""), (3, "z")], "id int, text string")
    rows = {r.id: list(r.embedding) for r in D.embed(df, "text", 2, D.model_embedder(load, 2)).collect()}
    assert rows == {1: [3.0, 1.0], 2: [0.0, 0.0], 3: [1.0, 1.0]}


def test_cached_vectors_equal_fresh_ones(t):
    docs = t("documents").select("doc_id", "text")
    keys = docs.select(D.cache_key(F.col("text"), "n").alias("cache_key"), "text").dropDuplicates(["cache_key"])
    cache = D.embed(keys, "text").select("cache_key", "embedding").where("hash(cache_key) % 2 = 0")
    broken = cache.limit(5).withColumn("embedding", F.slice("embedding", 1, 3))
    vectors, fresh = D.embed_cached(docs, "text", cache.join(broken.select("cache_key"), "cache_key", "left_anti").unionByName(broken), "n")
    plain = D.embed(docs, "text").select("doc_id", F.col("embedding").alias("e"))
    assert vectors.count() == docs.count()
    assert vectors.join(plain, "doc_id").where("embedding <> e").isEmpty()
    assert fresh.join(cache, "cache_key", "left_semi").count() == broken.count()
