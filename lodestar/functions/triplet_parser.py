"""Triplet parsers of one's own as table functions.

A parser is a function from a text to its triplets, each a sequence of four
texts. ``register_triplet_parser`` offers it to SQL as a polymorphic table
function: it takes a whole table, by partitions, keeps the columns named first,
and gives a row for each triplet, cleaned as ``parse_triplets`` does.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from ..operators.graph import triplets_of

Parser = Callable[[str], Iterable[tuple[int, Sequence[str]]]]


def bracketed(text: str) -> Iterable[tuple[int, Sequence[str]]]:
    """(line, the four fields) of the lines ``(s, p, o, description)``: up to the first closing bracket, exactly four fields."""
    for number, line in enumerate(text.split("\n")):
        opened, closed = line.find("("), line.find(")")
        fields = [f.strip() for f in line[opened + 1 : closed].split(",")] if 0 <= opened < closed else []
        if len(fields) == 4 and all(fields[:3]) and all(len(f.encode()) <= 128 for f in line[opened + 1 : closed].split(",")):
            yield number, fields


def triplet_parser(parse: Parser):
    """The table function of a parser: ``f(TABLE(t) PARTITION BY (…), 'id column', 'text column')``."""

    class Triplets:
        @staticmethod
        def analyze(rows: AnalyzeArgument, id_col: AnalyzeArgument, text_col: AnalyzeArgument) -> AnalyzeResult:
            if not rows.isTable:
                raise ValueError("the first argument is a table")
            names = {f.name: f.dataType for f in rows.dataType.fields}
            for name in (id_col.value, text_col.value):
                if name not in names:
                    raise ValueError(f"the table has no column {name!r}")
            schema = T.StructType().add(id_col.value, names[id_col.value]).add("line_no", T.IntegerType())
            return AnalyzeResult(schema.add("fields", T.ArrayType(T.StringType())))

        def eval(self, row, id_col: str, text_col: str):
            for number, fields in parse(row[text_col]) if row[text_col] is not None else ():
                if len(fields) == 4:
                    yield row[id_col], number, list(fields)

    return udtf(Triplets)


def register_triplet_parser(spark: SparkSession, name: str, parse: Parser = bracketed) -> None:
    """Offer ``parse`` to SQL under ``name``."""
    spark.udtf.register(name, triplet_parser(parse))


def parsed(spark: SparkSession, name: str, table: str, id_col: str, text_col: str) -> DataFrame:
    """(id, line_no, subject, predicate, object, description) of a view's texts by a registered parser."""
    rows = spark.sql(f"SELECT * FROM {name}(TABLE({table}) PARTITION BY ({id_col}), '{id_col}', '{text_col}')")
    entry = F.struct("line_no", "fields")
    clean = rows.select(id_col, F.get(triplets_of(F.array(entry)), F.lit(0)).alias("t"))
    return clean.select(F.col(id_col).alias("doc_id"), "t.*")
