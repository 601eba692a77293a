"""Plan shapes, retrievers, sources and SQL functions."""

import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from lodestar import workload
from lodestar.functions import html as H
from lodestar.functions import sqltext
from lodestar.operators import embedding as D
from lodestar.operators import quality as Q
from lodestar.operators import search as S
from lodestar.plans import registry
from lodestar.plans.retrieval import create_retriever, process
from lodestar.sources import files, formats
from lodestar.workload.graphs import by_nation, relation_notes, summaries, triplets
from lodestar.workload.vectors import _vec, centroids, text_queries

REGISTRY = workload.load()


def plan(df):
    return df._jdf.queryExecution().toString()


# Elements of web pages need a stack, which built-in functions don't have.
STACKED = ("b01", "b02", "b03")
NATIVE = [n for n in REGISTRY if n[0] in "bjkl" and not n.startswith(STACKED) or n.startswith(("c03", "c05", "c06", "c07", "c08", "c09", "h01", "h04", "h07", "i01", "i09"))]


@pytest.mark.parametrize("name", NATIVE)
def test_native_queries_use_no_python(spark, name):
    text = plan(REGISTRY[name].run(spark, SMALL))
    assert "EvalPython" not in text and "InPandas" not in text and "MapInArrow" not in text


def test_filter_and_columns_reach_the_scan(t):
    text = plan(S.knn(centroids(t), _vec(t, "embeddings"), 3, filters={"label": 3}))
    assert "EqualTo(label,3)" in text
    text = plan(REGISTRY["j05_products_of_brand"].run(t.spark, SMALL))
    assert "EqualTo(p_brand,Brand#1)" in text and "p_size" not in text.split("== Physical Plan ==")[1]


@pytest.mark.parametrize("name", ["e01_knn_cosine", "a09_upsert_orders", "g06_dedup_prefix", "l03_trim_history", "f02_bm25_corpus"])
def test_ranks_are_cut_before_the_shuffle(spark, name):
    assert "WindowGroupLimit" in plan(REGISTRY[name].run(spark, SMALL))


def test_retrievers(spark, t):
    docs = D.embed(t("documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"), "lang"), "content")
    vector = create_retriever("vector", corpus=docs, embedder="hash", filters={"lang": "en"}, min_score=0.3)
    edges = triplets(t)
    graph = create_retriever("graph_v2", entities=D.entity_vectors(edges), edges=edges, embedder="hash", min_score=0.6)
    asked = text_queries(t).unionByName(
        t("nation").select((F.col("n_nationkey") + 1000).cast("bigint").alias("query_id"), F.col("n_name").alias("query_text"))
    )
    for strategy in ("weighted", "ensemble", "cascade"):
        hits, envelope = process(asked, create_retriever("hybrid", vector=vector, graph=graph, strategy=strategy), 5, rerank_k=3)
        assert hits.groupBy("query_id").count().where("count > 3").isEmpty()
        assert envelope.count() == asked.count()
        assert not hits.where("query_id >= 1000").isEmpty()
    alone, envelope = process(asked, create_retriever("hybrid", vector=vector, graph=None), 5, strategy=None)
    assert not alone.isEmpty() and not envelope.first().reranked
    notes = relation_notes(t).select(F.col("s_suppkey").cast("string").alias("id"), F.col("note").alias("content"))
    community = create_retriever(
        "graph", notes=create_retriever("vector", corpus=D.embed(notes, "content"), embedder="hash"), membership=by_nation(t), summaries=summaries(t)
    )
    assert not community.retrieve(asked, 3).isEmpty()
    with pytest.raises(ValueError):
        create_retriever("other")
    with pytest.raises(ValueError):
        registry.embedder_named("other")


def test_sql_functions(spark, t):
    registry.register_sql_functions(spark)
    t("documents").createOrReplaceTempView("docs_for_sql")
    sql = spark.sql("SELECT d.doc_id, w.chunk_index, w.text, w.start, w.stop FROM docs_for_sql d, LATERAL token_windows(d.text, 50, 10) w")
    from lodestar.operators.chunking import chunk_tokens

    made = chunk_tokens(t("documents"), size=50, overlap=10).select("doc_id", "chunk_index", "text", "start", F.col("end").alias("stop"))
    assert sql.count() == made.count() and sql.exceptAll(made).isEmpty()
    row = spark.sql("SELECT squeeze_text(' a\n b ') AS s, text_words('a  b') AS w, vector_dot(array(1D,2D), array(3D,4D)) AS d").first()
    assert (row.s, row.w, row.d) == ("a b", ["a", "b"], 11.0)


PAGE = """<!DOCTYPE html><html><head><title> A &amp; B </title><meta name="description" content="About it">
<meta property="og:title" content="Old"><meta content="New &lt;1&gt;" property="og:title"><meta property='og:image' content='x.png'>
<meta property="article:published_time" content="2024-05-01"></head><body><header>top</header><nav>menu</nav><aside>ad</aside>
<script>var x = "</p>";</script><h1>One</h1><p>First <a href="u">link</a>. Second&nbsp;part! <img src=a>Third?<p>Open<table><tr><td>in<table><tr><td>deep</td></tr></table></td></tr></table>
<!-- c --><footer>end</footer></body></html>"""


def test_page_extraction(spark):
    df = spark.createDataFrame([("http://x/y", PAGE), ("http://x/z", "<p>no head</p>")], "url string, html string")
    rows = {
        r.url: r
        for r in df.select(
            "url", H.html_to_text(F.col("html")).alias("text"), H.page_metadata(F.col("url"), F.col("html"), F.lit("now")).alias("m"),
            H.normalise_paragraphs(H.html_to_text(F.col("html"))).alias("lines"), H.extract_tags(F.col("html"), ["title", "h1"]).alias("tags"),
        ).collect()
    }
    page = rows["http://x/y"]
    assert page.text == "A & B One First link. Second part! Third? Open in deep"
    assert page.lines == "A & B One First link.\n\nSecond part! Third? Open in deep"
    assert page.tags == "A & B\n\nOne"
    assert page.m == {
        "url": "http://x/y", "fetch_time": "now", "title": "A & B", "description": "About it", "published_date": "2024-05-01",
        "og_title": "New <1>", "og_image": "x.png",
    }
    assert rows["http://x/z"].m == {"url": "http://x/z", "fetch_time": "now"}


def test_metadata_merge(spark):
    row = spark.sql("SELECT map('a','1','b','2') AS x, map('b','3') AS y").select(H.merge_metadata(F.col("x"), F.col("y")).alias("m")).first()
    assert row.m == {"a": "1", "b": "3"}


def test_files_in_and_out(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "a.TXT").write_bytes(b"ok \xff")
    (tmp_path / "in" / "deep" / "b.md").write_text("text")
    (tmp_path / "in" / "c.pdf").write_text("x")
    found = files.scan_files(spark, str(tmp_path / "in"), ["txt", ".md"], content=True)
    texts = sorted(r.x for r in found.select(files.decode_text(F.col("content")).alias("x")).collect())
    assert texts == ["ok �", "text"]
    assert files.scan_files(spark, str(tmp_path / "in")).count() == 3
    files.write_jsonl(spark.range(5), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 5


def test_routes(spark):
    paths = ["sharepoint://a/b.pdf", "onedrive://x", "a/b.PDF", "x.csv", "y.ppt", "z.wav", "q.md", "none", "http://h/p.xlsx"]
    kinds = [r.reader_kind for r in formats.route_formats(spark.createDataFrame([(p,) for p in paths], "p string").coalesce(1), "p").collect()]
    assert kinds == ["sharepoint", "onedrive", "pdf", "excel", "slides", "audio", "text", "text", "excel"]


def test_xml_lists_and_blanks(spark):
    df = spark.createDataFrame([("<r><a> x </a><a>y</a><b></b></r>",)], "xml string")
    assert formats.xml_to_json(df, "xml", "a array<string>, b string").first().json == '{"a":["x","y"]}'


def test_sql_text_columns(spark):
    rows = [
        ("SELECT last_updated FROM Orders o JOIN customers c ON 1=1 join Orders x",), ("WITH x AS (SELECT 1) SELECT 'dollar'",),
        ("SELECT 1",), ("```sql\nSELECT a FROM s.t, u\n```",), ("delete from t",),
    ]
    df = spark.createDataFrame(rows, "q string").coalesce(1)
    got = df.select(
        sqltext.unsafe_keyword(F.col("q"), False).alias("a"), sqltext.unsafe_keyword(F.col("q"), True).alias("b"),
        sqltext.tables_used(F.col("q")).alias("t"), sqltext.extract_sql(F.col("q")).alias("x"),
    ).collect()
    assert [r.a for r in got] == ["UPDATE", "WITH", None, None, "DELETE"]
    assert [r.b for r in got] == [None, "WITH", None, None, "DELETE"]
    assert got[0].t == ["Orders", "customers"] and got[3].t == ["s"] and got[3].x == "SELECT a FROM s.t, u"


def test_constraints(spark):
    df = spark.createDataFrame([(1, None, 5), (1, "x", -1), (2, "y", None)], "k int, s string, n int")
    assert [(r.k, r.n) for r in Q.check_unique(df, ["k"]).collect()] == [(1, 2)]
    assert Q.check_not_null(df, ["s", "n"]).count() == 2
    assert [r.n for r in Q.check_predicate(df, F.col("n") > 0).collect()] == [-1]
    parent = spark.createDataFrame([(1,)], "id int")
    assert [r.k for r in Q.check_fk(df, parent, [("k", "id")]).collect()] == [2]
    assert Q.fill_defaults(df, {"n": F.lit(0)}).where("n is null").isEmpty()


def test_json_rows_make_decimals_plain(spark):
    df = spark.sql("SELECT 1 AS a, CAST(2.50 AS DECIMAL(10,2)) AS b")
    assert files.json_rows(df).first().row_json == '{"a":1,"b":2.5}'
    assert files.preview(spark.range(20), ["id"]).count() == 3 and files.preview(spark.range(4), ["id"]).count() == 4
