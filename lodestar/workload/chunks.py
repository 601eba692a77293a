"""Chunking. Whole documents, every token of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.strings import WS
from ..operators import chunking as K
from .base import query
from .ingestion import sql_squeeze

SQL_WORDS = f"list_filter(regexp_split_to_array(text, '{WS}+'), lambda t: t <> '')"


def sql_windows(size: int, overlap: int, source: str = "documents", key: str = "doc_id", text: str = "text") -> str:
    """Token windows: doc_id, chunk_index, text, start, end, size."""
    step = size - overlap
    words = SQL_WORDS.replace("(text,", f"({text},")
    return f"""
      SELECT doc_id, CAST(s // {step} AS INTEGER) AS chunk_index, array_to_string(toks[s+1:s+{size}], ' ') AS text,
             CAST(s AS INTEGER) AS start, CAST(least(s+{size}, n) AS INTEGER) AS "end", CAST(least(s+{size}, n) - s AS INTEGER) AS size
      FROM (SELECT doc_id, toks, n, unnest(range(0, n, {step})) AS s
            FROM (SELECT doc_id, toks, len(toks) AS n FROM (SELECT {key} AS doc_id, {words} AS toks FROM {source})))"""


def sql_semantic(low: int, high: int, overlap: int, length: str = "length({x})") -> str:
    """Sentence packing as a recursion over the sentences of each document."""

    def size(x: str) -> str:
        return length.replace("{x}", x)

    tail = f"""CASE WHEN length(cur) <= {overlap} THEN ''
        WHEN regexp_matches(right(cur,{overlap}), '[.!?] ') THEN regexp_replace(right(cur,{overlap}), '^.*[.!?] ', '')
        WHEN contains(right(cur,{overlap}), ' ') THEN substr(right(cur,{overlap}), strpos(right(cur,{overlap}),' ')+1)
        ELSE right(cur,{overlap}) END"""
    return f"""
      WITH RECURSIVE base AS (SELECT doc_id, {sql_squeeze('text')} AS x FROM documents),
      sents AS (SELECT doc_id, list_filter(string_split(regexp_replace(x, '([.!?]) ', '\\1' || chr(1), 'g'), chr(1)), lambda s: s <> '') AS ss FROM base WHERE x <> ''),
      flat AS (SELECT doc_id, unnest(ss) AS s, unnest(range(1, len(ss)+1)) AS i FROM sents),
      fold AS (
        SELECT doc_id, i, s AS cur, CAST(NULL AS VARCHAR) AS done FROM flat WHERE i = 1
        UNION ALL
        SELECT doc_id, i, CASE WHEN flush THEN CASE WHEN tail = '' THEN s ELSE tail || ' ' || s END ELSE cur || ' ' || s END, CASE WHEN flush THEN cur END
        FROM (SELECT f.doc_id, flat.i, flat.s, f.cur, {tail.replace('cur', 'f.cur')} AS tail,
                     {size('f.cur')} >= {low} AND {size("(f.cur || ' ' || flat.s)")} > {high} AS flush
              FROM fold f JOIN flat ON flat.doc_id = f.doc_id AND flat.i = f.i + 1)),
      pieces AS (
        SELECT doc_id, i, done AS text FROM fold WHERE done IS NOT NULL
        UNION ALL SELECT doc_id, i + 1, cur FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i DESC) AS r FROM fold) WHERE r = 1)
      SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS chunk_index, text, CAST({size('text')} AS INTEGER) AS size
      FROM pieces"""


COLUMNS = ["doc_id", "chunk_index", "text", "start", "end", "size"]

query("c01_chunk_semantic", sql_semantic(500, 1500, 100))(
    lambda t: K.chunk_semantic(t.texts("documents")).select("doc_id", "chunk_index", "text", "size")
)
query("c10_chunk_semantic_by_tokens", sql_semantic(80, 200, 100, "(length({x}) - length(replace({x}, ' ', '')) + 1)"))(
    lambda t: K.chunk_semantic(t.texts("documents"), low=80, high=200, length="tokens").select("doc_id", "chunk_index", "text", "size")
)


def sql_stop(a: str) -> str:
    """End of the 1500-character window that starts at ``a``."""
    return f"""CASE WHEN {a}+1500 >= length(x) THEN length(x)
        WHEN regexp_matches(substr(x, {a}+1401, 100), '[.!?] ') THEN {a}+1400+length(regexp_extract(substr(x, {a}+1401, 100), '^(.*?[.!?] )', 1))
        WHEN contains(substr(x, {a}+1451, 50), ' ') THEN {a}+1501-strpos(reverse(substr(x, {a}+1451, 50)), ' ')
        ELSE {a}+1500 END"""


query("c02_chunk_fixed", f"""
  WITH RECURSIVE base AS (SELECT * FROM (SELECT doc_id, {sql_squeeze('text')} AS x FROM documents) WHERE x <> ''),
  walk AS (
    SELECT doc_id, 0::BIGINT AS i, 0::BIGINT AS a, ({sql_stop('0')})::BIGINT AS b FROM base
    UNION ALL
    SELECT doc_id, i, a, ({sql_stop('a')})::BIGINT FROM (
      SELECT w.doc_id, w.i + 1 AS i, base.x AS x,
        CASE WHEN 100 >= w.b - w.a THEN w.a + 1
             WHEN strpos(substr(base.x, w.b - 99, 100), ' ') > 0 THEN w.b - 100 + strpos(substr(base.x, w.b - 99, 100), ' ')
             ELSE w.b - 100 END AS a
      FROM walk w JOIN base USING (doc_id) WHERE w.b < length(base.x)))
  SELECT doc_id, CAST(i AS INTEGER) AS chunk_index, CAST(a AS INTEGER) AS start, CAST(b AS INTEGER) AS "end", substr(x, a+1, b-a) AS text
  FROM walk JOIN base USING (doc_id)""")(
    lambda t: K.chunk_fixed(t.texts("documents")).select("doc_id", "chunk_index", "start", "end", "text")
)

query("c03_chunk_tokens", sql_windows(50, 10))(lambda t: K.chunk_tokens(t.texts("documents"), size=50, overlap=10).select(*COLUMNS))
query("c03_chunk_tokens_api_sizes", sql_windows(500, 100))(lambda t: K.chunk_tokens(t.texts("documents"), size=500, overlap=100).select(*COLUMNS))


query("c04_source_index", """
  SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS source_index FROM documents""")(
    lambda t: K.source_index(t.texts("documents"), "doc_id")
)

query("c05_pack_tokens", f"""
  WITH toks AS (SELECT doc_id, {SQL_WORDS} AS toks FROM documents),
  flat AS (SELECT doc_id, unnest(toks) AS tok, unnest(range(1, len(toks)+1)) AS i FROM toks),
  pos AS (SELECT doc_id, tok, row_number() OVER (ORDER BY doc_id, i) - 1 AS p FROM flat),
  wins AS (SELECT doc_id, tok, p, unnest(range(greatest(0, CAST(ceil((p - 499) / 400.0) AS BIGINT)), p // 400 + 1)) AS window_id FROM pos)
  SELECT window_id, string_agg(tok, ' ' ORDER BY p) AS text, window_id*400 AS token_start, window_id*400 + count(*) AS token_end,
         count(*) AS token_count, count(DISTINCT doc_id) AS n_sources
  FROM wins GROUP BY window_id""")(
    lambda t: K.pack_tokens(t.texts("documents"), "doc_id", "text", 500, 100).select(
        "window_id", "text", "token_start", "token_end", F.col("token_count").cast("bigint").alias("token_count"), "n_sources"
    )
)

query("c06_split_tokens", f"SELECT doc_id, text FROM ({sql_windows(200, 40, 'benchmark', 'item_id')})")(
    lambda t: t("benchmark").select(F.col("item_id").alias("doc_id"), F.explode(K.split_tokens(F.col("text"), 200, 40)).alias("text"))
)
query("c07_chunk_ids", f"""
  SELECT md5(doc_id || '|tokens|' || chunk_index) AS chunk_id, doc_id, chunk_index, size FROM ({sql_windows(50, 10)})""")(
    lambda t: K.with_chunk_ids(K.chunk_tokens(t.texts("documents"), size=50, overlap=10), "tokens").select("chunk_id", "doc_id", "chunk_index", "size")
)
query("c08_chunk_dual", f"""
  SELECT doc_id, 'fine' AS resolution, chunk_index, md5(text) AS text_md5, start, "end" FROM ({sql_windows(500, 100)})
  UNION ALL SELECT doc_id, 'coarse', chunk_index, md5(text), start, "end" FROM ({sql_windows(1000, 200)})""")(
    lambda t: K.chunk_dual(t.texts("documents")).select("doc_id", "resolution", "chunk_index", F.md5("text").alias("text_md5"), "start", "end")
)
query("c09_chunk_stats", f"""
  SELECT doc_id, count(*) AS n_chunks, min(length(text)) AS min_chars, max(length(text)) AS max_chars,
         round(avg(length(text)),6) AS avg_chars, CAST(sum(size) AS BIGINT) AS total_size FROM ({sql_windows(50, 10)}) GROUP BY 1""")(
    lambda t: K.chunk_stats(K.chunk_tokens(t.texts("documents"), size=50, overlap=10))
)


@query("c11_ingest_batch", f"""
  SELECT 'chunks' AS part, count(*) AS n, count(DISTINCT doc_id) AS sources FROM
     ({sql_windows(100, 20, "(SELECT doc_id, text FROM documents WHERE source <> 'src0')")})
  UNION ALL SELECT 'errors', count(*), count(DISTINCT doc_id) FROM documents WHERE source = 'src0'""")
def ingest(t):
    """One source's files arrive unreadable; the others go through."""
    files = t.texts("documents").select(
        F.col("doc_id").cast("string").alias("path"), F.when(F.col("source") != "src0", F.encode("text", "UTF-8")).alias("content")
    )
    chunks, errors = K.ingest_batch(files, size=100, overlap=20)
    counted = chunks.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("sources")).select(F.lit("chunks").alias("part"), "n", "sources")
    return counted.unionByName(
        errors.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("path").alias("sources")).select(F.lit("errors").alias("part"), "n", "sources")
    )
