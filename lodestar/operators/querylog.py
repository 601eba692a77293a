"""Work around generated SQL: table ranking, prompt blocks, safety, caching and retries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.sqltext import SAFETY_REASON, tables_used, unsafe_keyword
from .collections import upsert
from .keyed_store import KeyedStore
from .search import knn

MAX_RESULT_CHARS = 1000
MAX_RETRIES = 2


def catalog_tables(
    spark: SparkSession, frames: dict[str, DataFrame], primary: dict[str, list[str]] | None = None, foreign: list[tuple[str, str, str, str]] | None = None
) -> tuple[DataFrame, DataFrame]:
    """(columns, relations) read from DataFrame schemas: as many rows as columns exist, none of the data."""
    rows = []
    for position, (name, frame) in enumerate(frames.items()):
        for ordinal, field in enumerate(frame.schema.fields):
            key = field.name in (primary or {}).get(name, [])
            rows.append((name, position, field.name, ordinal, field.dataType.simpleString(), field.nullable and not key, key))
    columns = spark.createDataFrame(
        rows,
        "table_name string, table_no int, column_name string, ordinal int, data_type string, is_nullable boolean, is_primary boolean",
    )
    relations = spark.createDataFrame(
        foreign or [], "source_table string, source_column string, target_table string, target_column string"
    )
    return columns, relations


#: Letters, digits and underscores of any script.
WORD = r"[\p{L}\p{N}_]+"


def _word_rows(df: DataFrame, text: Column, *keep: str) -> DataFrame:
    found = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)))
    return df.select(*keep, F.explode(found).alias("word"))


#: Questions that one task ranks, some 7 rows each; the steps after it go on in the same tasks.
TASK_QUESTIONS = 1 << 16


def _in_tasks(questions: DataFrame) -> DataFrame:
    """Dealt once by ``question_id``, by their counted number: rows that compress well would otherwise meet in few tasks."""
    return questions.repartition(max(1, -(-questions.count() // TASK_QUESTIONS)), "question_id")


def rank_tables(questions: DataFrame, columns: DataFrame) -> DataFrame:
    """Tables whose name (weight 2) or column names (weight 1) share words with a question.

    Words meet in an equi-join, so only matching (question, table) pairs are
    ever built; the catalogue, which comes from the driver, is sent to the questions. A question that matches nothing gets every table with score 0,
    in catalogue order.
    """
    tables = columns.select("table_name", "table_no").distinct()
    name_words = _word_rows(tables, F.col("table_name"), "table_name", "table_no").withColumn("weight", F.lit(2))
    column_words = _word_rows(columns, F.col("column_name"), "table_name", "table_no", "column_name").withColumn(
        "weight", F.lit(1)
    )
    weights = (
        name_words.unionByName(column_words.drop("column_name"))
        .groupBy("word", "table_name", "table_no")
        .agg(F.sum("weight").alias("weight"))
    )
    zero = F.lit(0).cast("bigint").alias("score")
    every = tables.agg(F.collect_list(F.struct("table_no", "table_name", zero))).scalar()
    # Outer on both sides: a question without any known word keeps one empty row.
    found = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0)))
    asked = _in_tasks(questions.select("question_id", "text")).select("question_id", F.explode_outer(found).alias("word")).join(F.broadcast(weights), "word", "left")
    scored = asked.groupBy("question_id", "table_name", "table_no").agg(F.sum("weight").alias("score"))
    hits = F.count("table_name").over(Window.partitionBy("question_id"))
    own = F.array(F.struct("table_no", "table_name", "score"))
    rows = F.when(F.col("table_name").isNotNull(), own).when(F.col("_hits") == 0, every)
    listed = scored.withColumn("_hits", hits).select("question_id", F.inline(rows))
    w = Window.partitionBy("question_id").orderBy(F.col("score").desc(), "table_no")
    return listed.select("question_id", "table_name", "score", F.row_number().over(w).alias("rank"))


def _gathered(n: Column, text: Column, separator: str) -> Column:
    ordered = F.array_sort(F.collect_list(F.struct(n.alias("n"), text.alias("t"))))
    return F.array_join(F.transform(ordered, lambda e: e["t"]), separator)


def render_schema(ranked: DataFrame, columns: DataFrame) -> DataFrame:
    """Table blocks of each question's tables, best first."""
    line = F.concat(
        F.lit("  - "), "column_name", F.lit(": "), "data_type",
        F.when(F.col("is_primary"), " (PRIMARY KEY)").otherwise(""),
        F.when(F.col("is_nullable"), " NULL").otherwise(" NOT NULL"), F.lit("\n"),
    )
    blocks = columns.groupBy("table_name").agg(
        F.concat(F.lit("\n- "), F.col("table_name"), F.lit(":\n"), _gathered(F.col("ordinal"), line, "")).alias("block")
    )
    return ranked.join(F.broadcast(blocks), "table_name").groupBy("question_id").agg(
        _gathered(F.col("rank"), F.col("block"), "").alias("table_info")
    )


def render_relations(ranked: DataFrame, relations: DataFrame) -> DataFrame:
    """Foreign keys of which either side is among the question's tables."""
    line = F.concat(
        F.lit("- "), "source_table", F.lit("."), "source_column", F.lit(" -> "), "target_table", F.lit("."), "target_column", F.lit("\n")
    )
    sides = relations.select(line.alias("line"), F.explode(F.array_distinct(F.array("source_table", "target_table"))).alias("table_name"))
    hit = ranked.select("question_id", "table_name").join(F.broadcast(sides), "table_name").select("question_id", "line").distinct()
    return hit.groupBy("question_id").agg(
        F.concat(F.lit("TABLE RELATIONSHIPS:\n"), _gathered(F.col("line"), F.col("line"), "")).alias("relations_info")
    )


def render_examples(similar: DataFrame, shown: int = 3) -> DataFrame:
    """Up to ``shown`` similar questions (question_id, rank, natural_query, sql_query) as examples."""
    text = F.concat(
        F.lit("Example "), F.col("rank").cast("string"), F.lit(":\nQuestion: "), "natural_query", F.lit("\nSQL: "), "sql_query", F.lit("\n\n")
    )
    return similar.where(F.col("rank") <= shown).groupBy("question_id").agg(
        F.concat(F.lit("SIMILAR QUERIES:\n"), _gathered(F.col("rank"), text, "")).alias("examples_info")
    )


def with_tables_used(df: DataFrame, sql_col: str) -> DataFrame:
    return df.withColumn("tables_used", tables_used(F.col(sql_col)))


def safety_flags(df: DataFrame, sql_col: str) -> DataFrame:
    """Both readings of the keyword test: any substring, and whole words only."""
    sql = F.col(sql_col)
    flagged = df.withColumn("flag_substring", unsafe_keyword(sql, False)).withColumn("flag_token", unsafe_keyword(sql, True))
    return flagged.withColumn("reason", F.concat(F.lit(SAFETY_REASON), F.col("flag_substring")))


def cache_rows(log: DataFrame, embedder, result_chars: int | None = MAX_RESULT_CHARS) -> DataFrame:
    """Successful log rows as cache entries: id from database and question, vector of the question, result cut to ``result_chars`` (None: whole)."""
    good = log.where(F.col("execution_success"))
    return good.select(
        F.md5(F.concat_ws("|", "database_name", "natural_query")).alias("id"),
        "natural_query",
        "sql_query",
        tables_used(F.col("sql_query")).alias("tables_used"),
        "database_name",
        (F.col("execution_result") if result_chars is None else F.substring(F.col("execution_result"), 1, result_chars)).alias("execution_result"),
        "execution_time",
        "timestamp",
        embedder(F.col("natural_query")).alias("embedding"),
    )


def cache_store(log: DataFrame, cache: DataFrame | None, embedder) -> DataFrame:
    """Upsert: the latest success of a question in a database stands."""
    fresh = cache_rows(log, embedder)
    return upsert(fresh.limit(0) if cache is None else cache, fresh, ["id"], "timestamp")


def cache_into(store: KeyedStore, log: DataFrame, embedder, result_chars: int | None = MAX_RESULT_CHARS) -> list[int]:
    """``cache_store`` into a stored cache (keyed by ``id``, ordered by ``timestamp``): only the parts of the log's questions are read and written."""
    return store.upsert(cache_rows(log, embedder, result_chars))


def cache_lookup(questions: DataFrame, cache: DataFrame, database: str | None = None, k: int = 5, min_score: float = 0.85) -> DataFrame:
    """Similar cached questions of a question table (query_id, embedding)."""
    filters = {"database_name": database} if database else None
    hits = knn(questions, cache, k, filters=filters, min_score=min_score)
    return hits.join(cache.select("id", "natural_query", "sql_query", "database_name"), "id")


def fold_attempts(attempts: DataFrame, retries: int | None = MAX_RETRIES) -> DataFrame:
    """Attempts (question_id, attempt_no, sql_query, success, error, seconds) → one outcome per question.

    At most the first try and ``retries`` more count (None: all); the outcome is the last of them.
    ``dropped_attempts`` says how many more a question has.
    """
    used = attempts if retries is None else attempts.where(F.col("attempt_no") <= retries)
    return _folded(used)


def dropped_attempts(attempts: DataFrame, retries: int = MAX_RETRIES) -> DataFrame:
    """``question_id``, ``dropped``: the attempts that ``fold_attempts`` leaves out, for questions that have any."""
    return attempts.where(F.col("attempt_no") > retries).groupBy("question_id").agg(F.count(F.lit(1)).alias("dropped"))


def _folded(used: DataFrame) -> DataFrame:
    no = F.col("attempt_no")
    folded = used.groupBy("question_id").agg(
        F.max_by("sql_query", no).alias("sql_query"),
        F.max_by("success", no).alias("success"),
        F.max_by(F.struct("error"), no)["error"].alias("error"),
        (F.count(F.lit(1)) - 1).alias("retries"),
        F.sum("seconds").alias("execution_time"),
    )
    return folded.withColumn("error", F.when(~F.col("success"), F.col("error"))).withColumn(
        "tables_used", tables_used(F.col("sql_query"))
    )


def batch_summary(results: DataFrame) -> DataFrame:
    return results.agg(
        F.count(F.lit(1)).alias("total"),
        F.round(F.avg("execution_time"), 6).alias("mean_time"),
        F.round(F.count_if("success") / F.count(F.lit(1)), 6).alias("success_rate"),
        F.sum("retries").cast("bigint").alias("retries"),
    )
