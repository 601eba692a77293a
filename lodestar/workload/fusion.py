"""Fusing two ranked lists and turning hits into text.

The ``vector`` list holds the documents nearest to a passage, the ``graph`` list
those with the best keyword score; both carry the whole document as content.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.strings import WS
from ..operators import context as X
from ..operators import fusion as U
from ..operators import rerank as R
from .base import query
from .ranking import SQL_CONTENT_HITS, content_hits, sql_bm25_corpus, text_queries, with_content

K = 10
LISTED = ["query_id", "id", "content", "score", "rank"]


def vector_list(t) -> DataFrame:
    return content_hits(t, K).select(*LISTED)


def graph_list(t) -> DataFrame:
    hits = R.bm25_corpus(text_queries(t), t.texts("documents"), K, query_text="query_text")
    return with_content(t, hits).select(*LISTED)


SQL_VECTOR = SQL_CONTENT_HITS
SQL_GRAPH = f"SELECT h.*, d.text AS content FROM ({sql_bm25_corpus(K)}) h JOIN documents d ON d.doc_id = h.id"


def sql_key(x: str, prefix: int | None = 100) -> str:
    stripped = f"regexp_replace(coalesce({x},''), '^{WS}+|{WS}+$', '', 'g')"
    return f"lower({stripped})" if prefix is None else f"lower(substr({stripped}, 1, {prefix}))"


def sql_minmax(source: str, weight: float = 1.0) -> str:
    return f"""SELECT query_id, id, content, rank, {weight}::DOUBLE * CASE WHEN max(score) OVER w = min(score) OVER w THEN 1.0::DOUBLE
      ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS score FROM ({source}) WINDOW w AS (PARTITION BY query_id)"""


def sql_both(vector: str, graph: str) -> str:
    return f"""SELECT query_id, id, content, score, rank AS p, 0 AS src, 'vector' AS source_type FROM ({vector})
      UNION ALL SELECT query_id, id, content, score, rank, 1, 'graph' FROM ({graph})"""


def sql_dedup(source: str, order: str) -> str:
    return f"SELECT * FROM ({source}) QUALIFY row_number() OVER (PARTITION BY query_id, {sql_key('content')} ORDER BY {order}) = 1"


def sql_top(source: str, order: str, k: int) -> str:
    return f"""SELECT query_id, id, source_type, round(score,6) AS score, CAST(r AS INTEGER) AS rank FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {order}) AS r FROM ({source})) WHERE r <= {k}"""


def shown(hits: DataFrame) -> DataFrame:
    return hits.select("query_id", "id", "source_type", F.round("score", 6).alias("score"), "rank")


SQL_WEIGHTED = sql_top(sql_dedup(sql_both(sql_minmax(SQL_VECTOR, 0.6), sql_minmax(SQL_GRAPH, 0.4)), "src, p"), "score DESC, src, p", K)

query("g02_minmax", f"SELECT query_id, id, round(score,6) AS score FROM ({sql_minmax(SQL_VECTOR)})")(
    lambda t: U.minmax(vector_list(t), ["query_id"]).select("query_id", "id", F.round("score", 6).alias("score"))
)
query("g03_fuse_weighted", SQL_WEIGHTED)(lambda t: shown(U.fuse("weighted", vector_list(t), graph_list(t), K, vector_weight=0.6, graph_weight=0.4)))
query("g03_fuse_one_source", sql_top(sql_dedup(sql_both(sql_minmax(SQL_VECTOR, 0.5), f"SELECT * FROM ({SQL_GRAPH}) WHERE false"), "src, p"), "score DESC, src, p", K))(
    lambda t: shown(U.fuse("unknown", vector_list(t), graph_list(t).limit(0), K))
)
query("g04_fuse_ensemble", sql_top(sql_dedup(sql_both(SQL_VECTOR, SQL_GRAPH), "p, src"), "p, src", K))(
    lambda t: shown(U.fuse("ensemble", vector_list(t), graph_list(t), K))
)
query("g05_fuse_cascade", f"""
  WITH gate AS (SELECT query_id FROM ({SQL_VECTOR}) GROUP BY 1 HAVING count(*) >= 8 AND round(avg(score) FILTER (rank <= 8),6) > 0.7),
  both_lists AS ({sql_both(SQL_VECTOR, SQL_GRAPH)}),
  rest AS (SELECT * FROM both_lists WHERE query_id NOT IN (SELECT query_id FROM gate)),
  alone AS (SELECT * FROM both_lists WHERE src = 0 AND query_id IN (SELECT query_id FROM gate))
  {sql_top('SELECT * FROM alone UNION ALL ' + sql_dedup('SELECT * FROM rest', 'src, p'), 'src, p', 8)}""")(
    lambda t: shown(U.fuse("cascade", vector_list(t), graph_list(t), 8))
)
query("g06_dedup_prefix", f"""
  SELECT doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY {sql_key('text')} ORDER BY doc_id) = 1""")(
    lambda t: U.dedup_prefix_global(t.texts("documents").select("doc_id", F.col("text").alias("content")), "doc_id").select("doc_id")
)
query("g06_dedup_whole", f"""
  SELECT doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY {sql_key('text', None)} ORDER BY doc_id) = 1""")(
    lambda t: U.dedup_prefix_global(t.texts("documents").select("doc_id", F.col("text").alias("content")), "doc_id", None).select("doc_id")
)


@query("g07_normalise_graph_hits", """
  SELECT lang AS query_id, doc_id AS position, md5(text) AS content_md5,
         CASE WHEN source = 'src0' THEN 1.0::DOUBLE ELSE coalesce(quality, 1.0)::DOUBLE END AS score,
         CASE WHEN source = 'src0' THEN 'graph_' || doc_id END AS result_id
  FROM documents LEFT JOIN labels USING (doc_id)""")
def normalise_graph_hits(t):
    """Rows of one source arrive as bare strings, the others with content and confidence."""
    docs = t.texts("documents").join(t("labels"), "doc_id", "left")
    full = F.col("source") != "src0"
    foreign = docs.select(
        F.col("lang").alias("query_id"),
        F.col("doc_id").alias("position"),
        "text",
        F.when(full, F.col("text")).alias("content"),
        F.col("quality").cast("double").alias("confidence"),
        F.create_map(F.lit("source"), F.col("source")).alias("metadata"),
    )
    out = U.normalise_graph_hits(foreign)
    return out.select(
        "query_id", "position", F.md5("content").alias("content_md5"), "score", F.try_element_at("metadata", F.lit("result_id")).alias("result_id")
    )


def rich_hits(t) -> DataFrame:
    """All hits, with metadata; German contents are blank, French ones have no title."""
    hits = with_content(t, content_hits(t, K).drop("content", "lang"))
    title = F.when(F.col("lang") != "fr", F.concat(F.lit("doc "), F.col("id").cast("string")))
    entries = F.map_from_entries(
        F.filter(
            F.array(
                F.struct(F.lit("lang").alias("key"), F.col("lang").alias("value")),
                F.struct(F.lit("title").alias("key"), title.alias("value")),
            ),
            lambda e: e["value"].isNotNull(),
        )
    )
    return hits.select(
        "query_id", "id", "rank", "score", F.col("score").alias("original_score"), "lang",
        F.when(F.col("lang") == "de", F.lit("  ")).otherwise(F.col("content")).alias("content"),
        entries.alias("metadata"),
        F.when(F.col("lang") == "en", "vector").otherwise("graph").alias("source_type"),
    )


SQL_RICH = f"""SELECT h.query_id, h.id, h.rank, h.score, d.lang, CASE WHEN d.lang='de' THEN '  ' ELSE d.text END AS content,
    CASE WHEN d.lang <> 'fr' THEN 'doc ' || h.id END AS title, CASE WHEN d.lang='en' THEN 'vector' ELSE 'graph' END AS source_type
  FROM ({SQL_VECTOR}) h JOIN documents d ON d.doc_id=h.id"""
NL2 = "chr(10)||chr(10)"

query("g08_format_context", f"""
  SELECT b.item_id AS query_id, coalesce(context, 'No relevant information found.') AS context FROM benchmark b LEFT JOIN (
    SELECT query_id, string_agg('[Document '||rank||']: '||content, {NL2} ORDER BY rank) AS context FROM ({SQL_RICH}) GROUP BY 1) c ON c.query_id = b.item_id""")(
    lambda t: X.format_context(text_queries(t), rich_hits(t))
)
query("g08_format_context_metadata", f"""
  SELECT b.item_id AS query_id, coalesce(context, 'No relevant information found.') AS context FROM benchmark b LEFT JOIN (
    SELECT query_id, string_agg('[Document '||rank||']: '||content||chr(10)||'[Metadata]: lang: '||lang||coalesce(', title: '||title,''), {NL2} ORDER BY rank) AS context
    FROM ({SQL_RICH}) GROUP BY 1) c ON c.query_id = b.item_id""")(
    lambda t: X.format_context(text_queries(t), rich_hits(t), with_metadata=True)
)
query("g09_prompt_context", f"""
  SELECT query_id, string_agg('Document '||rank||':'||chr(10)||content, {NL2} ORDER BY rank) AS context
  FROM ({SQL_RICH}) WHERE rank <= 3 AND lang <> 'de' GROUP BY 1""")(lambda t: X.prompt_context(rich_hits(t), 3))
query("g09_prompt_context_hybrid", f"""
  SELECT query_id, string_agg('Document '||r||' ('||source_type||'):'||chr(10)||content, {NL2} ORDER BY r) AS context
  FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank) AS r FROM ({SQL_RICH})) WHERE r <= 5 AND lang <> 'de' GROUP BY 1""")(
    lambda t: X.prompt_context(rich_hits(t), 5, with_source=True, by_score=True)
)
query("g10_shape_sources", f"""
  SELECT query_id, CAST(id AS VARCHAR) AS id, md5(content) AS content_md5, score, coalesce(title,'Unknown document') AS title, lang, rank
  FROM ({SQL_RICH}) WHERE lang <> 'de'""")(
    lambda t: X.shape_sources(rich_hits(t)).select(
        "query_id", "id", F.md5("content").alias("content_md5"), "score", "title", F.col("metadata")["lang"].alias("lang"), "rank"
    )
)
query("g11_source_summary", f"""
  SELECT query_id, count(*) FILTER (source_type='vector') AS n_vector, count(*) FILTER (source_type='graph') AS n_graph,
         count(*) FILTER (source_type='hybrid') AS n_hybrid,
         string_agg('• '||title||' (source: '||source_type||', relevance: '||format('{{:.2f}}', score)||')', chr(10) ORDER BY r) FILTER (r <= 3)
           || CASE WHEN count(*) > 3 THEN chr(10)||'• ... and '||(count(*)-3)||' more sources' ELSE '' END AS top_sources
  FROM (SELECT query_id, source_type, coalesce(title,'Unknown document') AS title, round(score,2) AS score,
               row_number() OVER (PARTITION BY query_id ORDER BY round(score,2) DESC, rank) AS r FROM ({SQL_RICH}) WHERE lang <> 'de') GROUP BY 1""")(
    lambda t: X.source_summary(
        rich_hits(t).where("lang <> 'de'").withColumn("score", F.round("score", 2)).withColumn(
            "title", F.coalesce(F.try_element_at("metadata", F.lit("title")), F.lit("Unknown document"))
        )
    )
)


@query("g12_combine_contexts", f"""
  WITH kb AS (SELECT query_id, '[' || string_agg('{{"id":'||id||',"lang":"'||lang||'"}}', ',' ORDER BY rank) || ']' AS kb FROM ({SQL_RICH}) GROUP BY 1),
  db AS (SELECT r_regionkey::BIGINT AS query_id, 'SELECT n_name FROM nation WHERE region = '||r_name AS sql_query, count(n_name) AS n,
           '[' || coalesce(string_agg('{{"n_name":"'||n_name||'"}}', ',' ORDER BY n_nationkey) FILTER (n_name IS NOT NULL), '') || ']' AS rws
         FROM region LEFT JOIN (SELECT * FROM nation WHERE n_regionkey <> 0) ON n_regionkey = r_regionkey GROUP BY 1, 2)
  SELECT query_id, coalesce(kb, 'No knowledge base results.') AS kb_context,
         coalesce('SQL query: '||sql_query||{NL2}||'Data results: '||rws, 'No database results.') AS db_context,
         CASE WHEN kb IS NULL AND coalesce(n,0)=0 THEN '{X.NO_ANSWER}' END AS verdict
  FROM kb FULL JOIN db USING (query_id)""")
def combine(t):
    """Passage hits next to a database answer per region; one region's answer has no rows."""
    knowledge = rich_hits(t).select("query_id", "rank", F.struct("id", "lang").alias("row"))
    nations = t("nation").where("n_regionkey <> 0")
    joined = t("region").join(nations, F.col("r_regionkey") == F.col("n_regionkey"), "left")
    database = joined.select(
        F.col("r_regionkey").cast("bigint").alias("query_id"),
        F.concat(F.lit("SELECT n_name FROM nation WHERE region = "), "r_name").alias("sql_query"),
        F.col("n_nationkey").alias("row_no"),
        F.struct("n_name").alias("row"),
    )
    return X.combine_contexts(knowledge, database)
