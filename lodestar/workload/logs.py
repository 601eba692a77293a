"""Query log, semantic cache, conversations and events.

Questions and their generated SQL are derived from ``events``: one question per
user and day, one attempt per event, worded by event type.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import sqltext
from ..operators import conversations as V
from ..operators import embedding as D
from ..operators import querylog as L
from ..operators.keyed_store import KeyedStore
from ..session import shared_folder, stored
from ..sources import files
from .base import query
from .vectors import DIM, sql_embed, sql_rank

# Wording and generated SQL per event type.
WORDING = {
    "view": ("show orders with o_totalprice above {}", "SELECT o_orderkey FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey join orders p ON true"),
    "click": ("which customer has c_acctbal under {}", "```sql\nSELECT c_name, last_updated FROM Customer\n```"),
    "purchase": ("sum of l_quantity per part and p_brand over {}", "WITH x AS (SELECT * FROM lineitem) SELECT 'dollar' FROM x JOIN part ON true"),
    "signup": ("list every nation and region name {}", "SELECT n_name, created_at FROM tpch.nation, region"),
    "error": ("what happened at {}", "DROP TABLE orders; SELECT 1 FROM orders"),
}
DATABASES = {"view": "sales", "click": "sales", "purchase": "sales", "signup": "geo", "error": "geo"}


def _pick(values: dict[str, str]):
    out = None
    for kind, value in values.items():
        hit = F.col("event_type") == kind
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out


def _sql_pick(values: dict[str, str]) -> str:
    quoted = {k: v.replace("'", "''").replace("\n", "'||chr(10)||'") for k, v in values.items()}
    return "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in quoted.items()) + " END"


def log(t) -> DataFrame:
    """Event → question text, SQL, database."""
    amount = F.floor("value").cast("string")
    wording = F.replace(_pick({k: v[0] for k, v in WORDING.items()}), F.lit("{}"), amount)
    return t("events").select(
        "event_id", "user_id", "event_type", "value", "ts", wording.alias("text"),
        _pick({k: v[1] for k, v in WORDING.items()}).alias("response"), _pick(DATABASES).alias("database_name"),
    )


SQL_LOG = f"""SELECT event_id, user_id, event_type, value, ts, replace({_sql_pick({k: v[0] for k, v in WORDING.items()})}, '{{}}', CAST(floor(value) AS BIGINT)::VARCHAR) AS text,
  {_sql_pick({k: v[1] for k, v in WORDING.items()})} AS response, {_sql_pick(DATABASES)} AS database_name FROM events"""

NAMES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")
KEYS = {"region": ["r_regionkey"], "nation": ["n_nationkey"], "customer": ["c_custkey"], "supplier": ["s_suppkey"], "part": ["p_partkey"], "orders": ["o_orderkey"]}
LINKS = [
    ("nation", "n_regionkey", "region", "r_regionkey"), ("customer", "c_nationkey", "nation", "n_nationkey"),
    ("supplier", "s_nationkey", "nation", "n_nationkey"), ("orders", "o_custkey", "customer", "c_custkey"),
    ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"),
]


def catalog(t):
    return L.catalog_tables(t.spark, {n: t(n) for n in NAMES}, KEYS, LINKS)


_TYPE = "CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double' WHEN 'VARCHAR' THEN 'string' ELSE 'timestamp_ntz' END"
SQL_CATALOG = f"""SELECT table_name, CAST(list_position({list(NAMES)}, table_name) - 1 AS INTEGER) AS table_no, column_name,
    CAST(ordinal_position - 1 AS INTEGER) AS ordinal, {_TYPE} AS data_type, NOT is_primary AS is_nullable, is_primary FROM (
  SELECT *, column_name IN ({', '.join(f"'{k[0]}'" for k in KEYS.values())}) AS is_primary FROM information_schema.columns WHERE table_name IN {NAMES})"""


@query("i02_catalog", f"""
  SELECT c.*, coalesce(n, 0) AS n_questions FROM ({SQL_CATALOG}) c LEFT JOIN (
    SELECT word, count(*) AS n FROM (SELECT DISTINCT event_id, unnest(regexp_extract_all(lower(text), '\\w+')) AS word FROM ({SQL_LOG})) GROUP BY 1)
  ON word = column_name""")
def catalog_columns(t):
    """The catalogue, with the number of questions that name each column."""
    found = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\w+"), F.lit(0)))
    used = log(t).select(F.explode(found).alias("column_name")).groupBy("column_name").agg(F.count(F.lit(1)).alias("n_questions"))
    return catalog(t)[0].join(used, "column_name", "left").fillna(0, ["n_questions"])


SQL_RANKED = f"""
  WITH cat AS ({SQL_CATALOG}),
  w AS (SELECT word, table_name, table_no, sum(weight) AS weight FROM (
    SELECT DISTINCT table_name AS word, table_name, table_no, 2 AS weight FROM cat UNION ALL SELECT column_name, table_name, table_no, 1 FROM cat) GROUP BY ALL),
  q AS (SELECT DISTINCT event_id, unnest(regexp_extract_all(lower(text), '\\w+')) AS word FROM ({SQL_LOG})),
  s AS (SELECT event_id, table_name, table_no, sum(weight) AS score FROM q JOIN w USING (word) GROUP BY ALL),
  f AS (SELECT * FROM s UNION ALL SELECT e.event_id, c.table_name, c.table_no, 0 FROM events e, (SELECT DISTINCT table_name, table_no FROM cat) c
        WHERE e.event_id NOT IN (SELECT event_id FROM s))
  SELECT event_id AS question_id, table_name, CAST(score AS BIGINT) AS score,
         CAST(row_number() OVER (PARTITION BY event_id ORDER BY score DESC, table_no) AS INTEGER) AS rank FROM f"""


def ranked(t) -> DataFrame:
    return L.rank_tables(log(t).select(F.col("event_id").alias("question_id"), "text"), catalog(t)[0])


query("i01_rank_tables", SQL_RANKED)(ranked)
query("i03_schema_blocks", f"""
  WITH r AS ({SQL_RANKED}), b AS (SELECT table_name, chr(10)||'- '||table_name||':'||chr(10)||string_agg('  - '||column_name||': '||data_type||
      CASE WHEN is_primary THEN ' (PRIMARY KEY)' ELSE '' END||CASE WHEN is_nullable THEN ' NULL' ELSE ' NOT NULL' END||chr(10), '' ORDER BY ordinal) AS block
    FROM ({SQL_CATALOG}) GROUP BY 1)
  SELECT question_id, md5(string_agg(block, '' ORDER BY rank)) AS info_md5 FROM r JOIN b USING (table_name) GROUP BY 1""")(
    lambda t: L.render_schema(ranked(t), catalog(t)[0]).select("question_id", F.md5("table_info").alias("info_md5"))
)
_LINKS_SQL = "(VALUES " + ", ".join(str(x) for x in LINKS) + ") l(st, sc, tt, tc)"
query("i03_relation_blocks", f"""
  WITH r AS ({SQL_RANKED}), h AS (SELECT DISTINCT question_id, '- '||st||'.'||sc||' -> '||tt||'.'||tc||chr(10) AS line FROM r JOIN {_LINKS_SQL} ON table_name = st OR table_name = tt)
  SELECT question_id, 'TABLE RELATIONSHIPS:'||chr(10)||string_agg(line, '' ORDER BY line) AS relations_info FROM h GROUP BY 1""")(
    lambda t: L.render_relations(ranked(t), catalog(t)[1])
)

SQL_FENCED = "CASE WHEN regexp_matches(response, '(?s)```sql\\s*(.*?)\\s*```') THEN trim(regexp_extract(response, '(?s)```sql\\s*(.*?)\\s*```', 1)) ELSE trim(response) END"
query("i04_extract_sql", f"SELECT event_id, {SQL_FENCED} AS sql_query FROM ({SQL_LOG})")(
    lambda t: log(t).select("event_id", sqltext.extract_sql(F.col("response")).alias("sql_query"))
)
SQL_USED = """array_to_string(list_transform(list_filter(list_zip(u, range(1, len(u)+1)), lambda p: list_position(u, p[1]) = p[2]), lambda p: p[1]), ',')"""
query("i05_tables_used", f"""
  SELECT event_id, {SQL_USED} AS tables_used FROM (SELECT event_id, regexp_extract_all(response, '(?i)(?:FROM|JOIN)\\s+([a-zA-Z0-9_]+)', 1) AS u FROM ({SQL_LOG}))""")(
    lambda t: L.with_tables_used(log(t), "response").select("event_id", F.array_join("tables_used", ",").alias("tables_used"))
)


def _sql_flag(template: str) -> str:
    return "CASE " + " ".join(f"WHEN {template.replace('@', k)} THEN '{k}'" for k in sqltext.UNSAFE_KEYWORDS) + " END"


query("i06_safety_flags", f"""
  SELECT event_id, {_sql_flag("contains(upper(response), '@')")} AS flag_substring, {_sql_flag("regexp_matches(upper(response), '\\b@\\b')")} AS flag_token,
         '{sqltext.SAFETY_REASON}' || {_sql_flag("contains(upper(response), '@')")} AS reason FROM ({SQL_LOG})""")(
    lambda t: L.safety_flags(log(t), "response").select("event_id", "flag_substring", "flag_token", "reason")
)


def query_log(t) -> DataFrame:
    """Errors fail; the result text of the others is longer than the cache keeps."""
    return log(t).select(
        F.col("text").alias("natural_query"),
        sqltext.extract_sql(F.col("response")).alias("sql_query"),
        "database_name",
        (F.col("event_type") != "error").alias("execution_success"),
        F.repeat(F.concat(F.lit('{"value":'), F.floor("value").cast("string"), F.lit("}")), 100).alias("execution_result"),
        F.col("value").alias("execution_time"),
        F.col("event_id").alias("timestamp"),
    )


SQL_CACHE = f"""SELECT md5(database_name||'|'||text) AS id, text AS natural_query, {SQL_FENCED} AS sql_query, database_name,
    substr(repeat('{{"value":'||CAST(floor(value) AS BIGINT)||'}}', 100), 1, 1000) AS execution_result, value AS execution_time, event_id AS timestamp
  FROM ({SQL_LOG}) WHERE event_type <> 'error' QUALIFY row_number() OVER (PARTITION BY database_name, text ORDER BY event_id DESC) = 1"""


def cache(t) -> DataFrame:
    return L.cache_store(query_log(t), None, D.hash_embedder(DIM))


query("i07_cache_store", f"SELECT id, natural_query, sql_query, database_name, md5(execution_result) AS result_md5, execution_time, timestamp FROM ({SQL_CACHE})")(
    lambda t: cache(t).select("id", "natural_query", "sql_query", "database_name", F.md5("execution_result").alias("result_md5"), "execution_time", "timestamp")
)


@query("i07_cache_parts", f"SELECT id, natural_query, sql_query, database_name, md5(execution_result) AS result_md5, execution_time, timestamp FROM ({SQL_CACHE})")
def cache_parts(t):
    """The same cache, stored, after two deliveries of the log; later ones read and write the parts of their questions only."""
    store = KeyedStore(t.spark, shared_folder(t.spark, "cache"), "id", "timestamp")
    late = F.pmod(F.xxhash64("timestamp", "natural_query"), F.lit(2))
    for delivery in (0, 1):
        L.cache_into(store, query_log(t).where(late == delivery), D.hash_embedder(DIM))
    return store.read().select("id", "natural_query", "sql_query", "database_name", F.md5("execution_result").alias("result_md5"), "execution_time", "timestamp")


def asked(t) -> DataFrame:
    """One question per event type: its commonest wording, less the number."""
    kinds = t("events").groupBy("event_type").agg(F.min("event_id").alias("query_id"))
    text = F.replace(_pick({k: v[0] for k, v in WORDING.items()}), F.lit("{}"), F.lit("10"))
    return D.embed(kinds.select("query_id", text.alias("text")), "text", DIM)


SQL_ASKED = f"(SELECT min(event_id) AS query_id, replace({_sql_pick({k: v[0] for k, v in WORDING.items()})}, '{{}}', '10') AS text FROM events GROUP BY event_type)"
SQL_LOOKUP = sql_rank(f"""SELECT q.id AS query_id, d.id AS id, round(list_cosine_similarity(q.v, d.v),6) AS score
    FROM ({sql_embed(SQL_ASKED, 'query_id', 'text')}) q, ({sql_embed(f"(SELECT * FROM ({SQL_CACHE}) WHERE database_name='sales')", 'id', 'natural_query')}) d
    WHERE round(list_cosine_similarity(q.v, d.v),6) >= 0.85""", 5)
query("i08_cache_lookup", f"SELECT l.*, c.natural_query, c.sql_query, c.database_name FROM ({SQL_LOOKUP}) l JOIN ({SQL_CACHE}) c USING (id)")(
    lambda t: L.cache_lookup(asked(t), cache(t), "sales")
)
query("i03_example_blocks", f"""
  SELECT query_id AS question_id, 'SIMILAR QUERIES:'||chr(10)||string_agg('Example '||rank||':'||chr(10)||'Question: '||natural_query||chr(10)||'SQL: '||sql_query||chr(10)||chr(10), '' ORDER BY rank) AS examples_info
  FROM ({SQL_LOOKUP}) l JOIN ({SQL_CACHE}) c USING (id) WHERE rank <= 3 GROUP BY 1""")(
    lambda t: L.render_examples(L.cache_lookup(asked(t), cache(t), "sales").withColumnRenamed("query_id", "question_id"))
)


def attempts(t) -> DataFrame:
    """A user's events on one day are the attempts at one question."""
    from pyspark.sql import Window

    day = F.concat_ws("/", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd"))
    w = Window.partitionBy("question_id").orderBy("event_id")
    return log(t).select(
        day.alias("question_id"), "event_id", F.col("response").alias("sql_query"), (F.col("event_type") != "error").alias("success"),
        F.when(F.col("event_type") == "error", F.concat(F.lit("failed: "), "text")).alias("error"), F.col("value").alias("seconds"),
    ).withColumn("attempt_no", F.row_number().over(w) - 1).drop("event_id")


SQL_FOLDED = f"""
  SELECT question_id, arg_max(response, a) AS sql_query, arg_max(event_type <> 'error', a) AS success,
         CASE WHEN arg_max(event_type, a) = 'error' THEN 'failed: ' || arg_max(text, a) END AS error, count(*) - 1 AS retries, sum(value) AS execution_time
  FROM (SELECT *, user_id||'/'||strftime(ts, '%Y-%m-%d') AS question_id, row_number() OVER (PARTITION BY user_id, strftime(ts, '%Y-%m-%d') ORDER BY event_id) - 1 AS a FROM ({SQL_LOG}))
  WHERE a <= 2 GROUP BY 1"""
query("i09_fold_attempts", f"SELECT question_id, sql_query, success, error, retries, round(execution_time,4) AS execution_time FROM ({SQL_FOLDED})")(
    lambda t: L.fold_attempts(attempts(t)).drop("tables_used").withColumn("execution_time", F.round("execution_time", 4))
)
query("i09_dropped_attempts", f"""
  SELECT question_id, count(*) AS dropped FROM (SELECT user_id||'/'||strftime(ts, '%Y-%m-%d') AS question_id,
    row_number() OVER (PARTITION BY user_id, strftime(ts, '%Y-%m-%d') ORDER BY event_id) - 1 AS a FROM ({SQL_LOG})) WHERE a > 2 GROUP BY 1""")(
    lambda t: L.dropped_attempts(attempts(t))
)
query("i09_fold_all_attempts", f"SELECT question_id, sql_query, success, error, retries, round(execution_time,4) AS execution_time FROM ({SQL_FOLDED.replace('WHERE a <= 2', '')})")(
    lambda t: L.fold_attempts(attempts(t), None).drop("tables_used").withColumn("execution_time", F.round("execution_time", 4))
)
query("i10_batch_summary", f"""
  SELECT count(*) AS total, round(avg(execution_time),6) AS mean_time, round(count(*) FILTER (success)::DOUBLE/count(*),6) AS success_rate,
         CAST(sum(retries) AS BIGINT) AS retries FROM ({SQL_FOLDED})""")(lambda t: L.batch_summary(L.fold_attempts(attempts(t))))
query("i11_json_rows", """
  SELECT c_custkey, '{"c_custkey":'||c_custkey||',"c_name":"'||c_name||'","c_nationkey":'||c_nationkey||'}' AS row_json FROM customer""")(
    lambda t: files.json_rows(t("customer"), ["c_custkey", "c_name", "c_nationkey"]).select("c_custkey", "row_json")
)
query("i11_preview", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 3")(
    lambda t: files.preview(t("orders").select("o_orderkey", "o_custkey"), ["o_orderkey"])
)

# Conversations and events.


def chat_events(t) -> DataFrame:
    """Turns as chunks. System turns stand for errors; a conversation ends where an assistant speaks."""
    kind = F.when(F.col("role") == "system", "error").when(F.col("role") == "assistant", "stream_end").otherwise("stream_chunk")
    turns = t("conversations").select(F.col("conv_id").alias("conn_id"), F.col("turn").alias("seq"), kind.alias("type"), "text")
    return turns.select("conn_id", "seq", "type", F.when(F.col("type") == "stream_chunk", F.col("text")).alias("chunk"))


SQL_ANSWERS = f"""
  SELECT conn_id, CASE WHEN err IS NOT NULL AND n = 0 THEN '{V.FALLBACK_ANSWER}' ELSE answer END AS answer, n AS n_chunks, ended AND NOT (err IS NOT NULL AND n = 0) AS stream_success FROM (
    SELECT conv_id AS conn_id, coalesce(string_agg(text, '' ORDER BY turn) FILTER (role='user' AND text <> '' AND (err IS NULL OR turn > err)), '') AS answer,
           count(*) FILTER (role='user' AND text <> '' AND (err IS NULL OR turn > err)) AS n, bool_or(role='assistant') AS ended, any_value(err) AS err
    FROM (SELECT *, max(CASE WHEN role='system' THEN turn END) OVER (PARTITION BY conv_id) AS err FROM conversations) GROUP BY 1)"""
query("l02_assemble_stream", SQL_ANSWERS)(
    lambda t: V.assemble_stream(chat_events(t))
)
query("l03_trim_history", """
  SELECT conv_id, turn, role, text FROM conversations QUALIFY role='system' OR row_number() OVER (PARTITION BY conv_id, role='system' ORDER BY turn DESC) <= 3""")(
    lambda t: V.trim_history(t("conversations"), 3)
)
query("l03_clear_history", "SELECT conv_id, turn, role, text FROM conversations WHERE role='system'")(lambda t: V.clear_history(t("conversations")))
_MODES = {"view": "vector", "click": "graph", "purchase": "database", "signup": "hybrid"}
query("l04_route_requests", """
  SELECT event_id, coalesce(CASE event_type WHEN 'view' THEN 'vector' WHEN 'click' THEN 'graph' WHEN 'purchase' THEN 'database' WHEN 'signup' THEN 'hybrid' END, 'vector') AS route FROM events""")(
    lambda t: V.route_requests(t("events").withColumn("mode", _pick(_MODES)))[0].select("event_id", "route")
)
query("l04_route_errors", """
  SELECT event_id, 'Invalid mode: '||event_type||'. Valid options are: vector, graph, hybrid_rag, database, hybrid' AS message FROM events""")(
    lambda t: V.route_requests(t("events"), "event_type")[1].select("event_id", "message")
)
query("l05_step_latency", """
  SELECT user_id, count(*) AS n_steps, count(DISTINCT event_type) AS n_step_kinds, min(ts) AS started, max(ts) AS finished,
    date_diff('microsecond', min(ts), max(ts)) / 1e6 AS seconds FROM events GROUP BY 1""")(
    lambda t: V.step_latency(t("events"), "user_id", "ts", "event_type")
)


@query("l05_latency_sketches", """
  WITH s AS (SELECT date_trunc('hour', min(ts)) AS span, date_diff('microsecond', min(ts), max(ts)) / 1e6 AS x FROM events GROUP BY user_id)
  SELECT 'all' AS name, count(*) AS n, true AS p50_near, true AS p95_near FROM s
  UNION ALL SELECT 'spans', count(DISTINCT span), true, true FROM s""")
def latency_sketches(t):
    """Sketches by hour are stored, opened again and merged; their quantiles stand within 2 % of the exact ranks."""
    latency = V.step_latency(t("events"), "user_id", "ts", "event_type")
    kept = stored(V.latency_sketches(latency, "started", "seconds"), "sketches")
    total = V.merged_quantiles(kept, [0.5, 0.95]).first()
    ranks = [F.avg((F.col("seconds") <= total[p]).cast("double")) for p in ("p50", "p95")]
    below = [F.avg((F.col("seconds") < total[p]).cast("double")) for p in ("p50", "p95")]
    # A quantile is near if the ranks that its value holds come within 2 % of the one asked for.
    near = [(low - 0.02 <= q) & (high + 0.02 >= q) for low, high, q in zip(below, ranks, (0.5, 0.95))]
    row = latency.agg(near[0].alias("p50_near"), near[1].alias("p95_near"))
    every = row.select(F.lit("all").alias("name"), F.lit(total["n"]).cast("bigint").alias("n"), "p50_near", "p95_near")
    return every.unionByName(kept.agg(F.lit("spans").alias("name"), F.count(F.lit(1)).alias("n"), F.lit(True).alias("p50_near"), F.lit(True).alias("p95_near")))


query("l05_latency_quantiles", """
  SELECT quantile_disc(seconds, 0.5) AS p50, quantile_disc(seconds, 0.95) AS p95 FROM (
    SELECT date_diff('microsecond', min(ts), max(ts)) / 1e6 AS seconds FROM events GROUP BY user_id)""")(
    lambda t: V.latency_quantiles(V.step_latency(t("events"), "user_id", "ts", "event_type"), "seconds")
)
