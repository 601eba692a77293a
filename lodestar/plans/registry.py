"""Named hooks and the functions offered to SQL users."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, SparkSession

from ..functions.strings import WS
from ..operators.embedding import hash_embedder

Embedder = Callable[[Column], Column]
EMBEDDERS: dict[str, Callable[..., Embedder]] = {"hash": hash_embedder}


def register_embedder(name: str, factory: Callable[..., Embedder]) -> None:
    """``factory(**config)`` returns a function from a text Column to a vector Column."""
    EMBEDDERS[name] = factory


def embedder_named(name: str, **config) -> Embedder:
    if name not in EMBEDDERS:
        raise ValueError(f"embedder is one of {sorted(EMBEDDERS)}")
    return EMBEDDERS[name](**config)


# SQL functions, expanded by the analyzer into built-in expressions.
SQL_FUNCTIONS = (
    rf"""CREATE OR REPLACE TEMPORARY FUNCTION squeeze_text(t STRING) RETURNS STRING
    RETURN trim(regexp_replace(t, r'{WS}+', ' '))""",
    rf"""CREATE OR REPLACE TEMPORARY FUNCTION text_words(t STRING) RETURNS ARRAY<STRING>
    RETURN filter(split(t, r'{WS}+'), w -> w <> '')""",
    """CREATE OR REPLACE TEMPORARY FUNCTION vector_dot(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE
    RETURN aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)""",
    # The inner array binds the words to a name, so that the windows don't split the text again.
    """CREATE OR REPLACE TEMPORARY FUNCTION token_window_list(t STRING, size INT, overlap INT)
    RETURNS ARRAY<STRUCT<chunk_index: INT, text: STRING, start: INT, stop: INT>>
    RETURN transform(array(text_words(t)), toks -> CASE WHEN size(toks) > 0 THEN
      transform(sequence(0, size(toks) - 1, token_window_list.size - token_window_list.overlap), (s, i) -> named_struct(
        'chunk_index', i, 'text', array_join(slice(toks, s + 1, token_window_list.size), ' '), 'start', s, 'stop', least(s + token_window_list.size, size(toks)))) END)[0]""",
    # Beside a table, Spark joins a table function's rows by the whole text: for large tables take the list as a column, and a LATERAL VIEW of it.
    """CREATE OR REPLACE TEMPORARY FUNCTION token_windows(t STRING, size INT, overlap INT)
    RETURNS TABLE(chunk_index INT, text STRING, start INT, stop INT)
    RETURN SELECT w.* FROM (
      SELECT explode(transform(sequence(0, size(toks) - 1, token_windows.size - token_windows.overlap), (s, i) -> named_struct(
        'chunk_index', i, 'text', array_join(slice(toks, s + 1, token_windows.size), ' '), 'start', s, 'stop', least(s + token_windows.size, size(toks))))) AS w
      FROM (SELECT text_words(token_windows.t) AS toks) WHERE size(toks) > 0)""",
)


def register_sql_functions(spark: SparkSession) -> None:
    """``squeeze_text``, ``text_words``, ``vector_dot``, ``token_window_list`` and the table function ``token_windows``."""
    for statement in SQL_FUNCTIONS:
        spark.sql(statement)
