"""Input that the given tables do not hold: malformed pages, other scripts, vectors of other lengths."""

import pytest
from pyspark.sql import functions as F

from lodestar.functions import html as H
from lodestar.operators import chunking as K
from lodestar.operators import collections as C
from lodestar.operators import graph as G
from lodestar.operators import querylog as L
from lodestar.operators import rerank as R
from lodestar.operators import search as S
from lodestar.streaming import answers


def test_less_than_is_text(spark):
    page = spark.createDataFrame([("<p>if a < b and c > d</p><!-- x --><br/>1<2",)], "html string")
    assert page.select(H.html_to_text(F.col("html")).alias("t")).first().t == "if a < b and c > d 1<2"


def test_mentions_of_any_script(spark):
    notes = spark.createDataFrame([(1, "São Paulo -> located in -> Brasil\nHà Nội -> capital of -> Việt Nam")], "id long, note string")
    found = {r.name for r in G.entity_mentions(notes, "id", "note").collect()}
    assert found == {"São Paulo", "Brasil", "Hà Nội", "Việt Nam"}


@pytest.mark.parametrize("limit", [4096, 1])
def test_vectors_of_other_lengths(spark, limit):
    queries = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, embedding array<double>")
    good = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 1.0])], "id long, embedding array<double>")
    hits = S.knn(queries, good, 2, block_bytes=limit).collect()
    assert [r.id for r in sorted(hits, key=lambda r: r["rank"])] == [1, 3]
    ragged = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0]), (3, [1.0, 2.0, 3.0])], "id long, embedding array<double>")
    with pytest.raises(Exception, match="length|shape"):
        S.knn(queries, ragged, 2, block_bytes=limit).collect()


def test_documents_are_embedded_once(spark, t):
    from lodestar import workload

    plan = workload.load()["e01_knn_documents"].run(spark, t.folder)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") <= 1


@pytest.mark.parametrize("limit", [1 << 20, 1])
def test_bm25_where_most_documents_have_the_term(spark, limit):
    docs = spark.createDataFrame([(i, "common word" if i < 8 else "word other") for i in range(10)], "doc_id long, text string")
    queries = spark.createDataFrame([(1, "common"), (2, "unheard")], "query_id long, query_text string")
    hits = R.bm25_corpus(queries, docs, 3, query_text="query_text", block_bytes=limit).collect()
    found = {q: [r.id for r in sorted(hits, key=lambda r: r["rank"]) if r.query_id == q] for q in (1, 2)}
    # The mean idf is negative, so the two documents without the term stand before the others.
    assert found == {1: [8, 9, 0], 2: [0, 1, 2]}


@pytest.mark.parametrize("name", ["f02_bm25_candidates", "e10_shape_hits"])
def test_the_corpus_is_not_shuffled_for_texts(spark, t, name):
    from lodestar import workload

    plan = workload.load()[name].run(spark, t.folder)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(doc_id" not in plan


def test_every_entity_is_read_once(spark):
    page = spark.createDataFrame([("<p>caf&eacute; &#8217;x&#x2019; a&hellip; &amp;lt; &nosuch; R&D &#0;</p>",), (None,)], "html string")
    got = [r.t for r in page.select(H.html_to_text(F.col("html")).alias("t")).collect()]
    assert got == ["café ’x’ a… &lt; &nosuch; R&D \ufffd", None]


def test_a_script_that_never_ends(spark):
    page = spark.createDataFrame([("<p>kept</p><script>var hidden = 1;",)], "html string")
    assert page.select(H.html_to_text(F.col("html")).alias("t")).first().t == "kept"


def test_arrow_with_brackets_in_names(spark):
    rows = [("(OpenAI (company)) --[makes]--> (GPT-4)",), ("(a) --[b]--> (c (d))",), ("(a) --> (b)",), (None,)]
    got = spark.createDataFrame(rows, "x string").select(G.parse_arrow(F.col("x")).alias("p")).collect()
    assert [r.p and tuple(r.p) for r in got] == [("OpenAI (company)", "makes", "GPT-4"), ("a", "b", "c (d)"), None, None]


@pytest.mark.parametrize("parts", [1, 3])
def test_each_name_counts_once(spark, parts):
    items = spark.createDataFrame(
        [("one", [1.0, 0.0]), ("one", [1.0, 0.05]), ("one", [1.0, 0.1]), ("two", [1.0, 0.5])], "name string, embedding array<double>"
    ).repartition(parts)
    queries = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, embedding array<double>")
    hits = G.graph_vector_search(queries, items, k=2, min_score=0.5).collect()
    assert sorted((r["rank"], r.name, r.score) for r in hits) == [(1, "one", 1.0), (2, "two", 0.894427)]


def test_equal_versions_with_other_payloads(spark):
    schema = "id long, payload map<string,string>, version int"
    base = spark.createDataFrame([(1, {"k": "old"}, 1)], schema)
    rows = [(1, {"k": c, "other": "x"}, 2) for c in "abcdef"]
    ways = (spark.createDataFrame(r, schema).repartition(n) for r, n in ((rows, 1), (rows[::-1], 3), (rows[3:] + rows[:3], 2)))
    got = [C.upsert(base, updates, ["id"], "version").collect() for updates in ways]
    assert len(got[0]) == 1 and got[0] == got[1] == got[2]


def test_packing_a_repeated_id(spark):
    docs = spark.createDataFrame([(1, "a b c"), (1, "d e"), (2, "f g h")], "doc_id long, text string").coalesce(1)
    got = K.pack_tokens(docs, "doc_id", "text", 4, 0).orderBy("window_id").collect()
    assert [(r.text, r.token_count, r.source_ids) for r in got] == [("a b c d", 4, [1, 1]), ("e f g h", 4, [1, 2])]


def test_words_of_any_script_find_tables(spark):
    questions = spark.createDataFrame([(1, "Größe der Straße")], "question_id long, text string")
    columns = spark.createDataFrame([("lager", 1, "größe"), ("weg", 2, "länge")], "table_name string, table_no int, column_name string")
    assert L.rank_tables(questions, columns).where("rank = 1").first().table_name == "lager"


def test_chunks_after_the_end_start_no_second_answer(spark, tmp_path):
    schema = "conn_id long, seq long, type string, chunk string"
    parts = ([(1, 1, "stream_chunk", "a"), (1, 2, "stream_end", None)], [(1, 3, "stream_chunk", "late"), (1, 4, "stream_end", None)])
    source = str(tmp_path / "events")
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    query = (
        answers.assemble_stream(stream).writeStream.format("memory").queryName("answered_once").outputMode("append")
        .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    )
    assert query.awaitTermination(60)
    assert [tuple(r) for r in spark.table("answered_once").collect()] == [(1, "a", 1, True)]
