"""Columns over SQL strings kept in a query log."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .strings import strip

# Fixed values, in the order in which the first hit becomes the reason.
UNSAFE_KEYWORDS = (
    "DROP", "DELETE", "TRUNCATE", "UPDATE", "INSERT", "ALTER", "CREATE",
    "GRANT", "REVOKE", "WITH", "COPY", "EXECUTE", "DO",
)
SAFETY_REASON = "Query contains potentially harmful operation: "
FENCE = r"(?s)```sql\s*(.*?)\s*```"
TABLE_REFERENCE = r"(?i)(?:FROM|JOIN)\s+([a-zA-Z0-9_]+)"


def extract_sql(col: Column) -> Column:
    """Content of the first fenced block, else the trimmed text."""
    fenced = F.regexp_extract(col, FENCE, 1)
    return F.when(F.regexp_like(col, F.lit(FENCE)), strip(fenced)).otherwise(strip(col))


def tables_used(col: Column) -> Column:
    """Names after FROM or JOIN, first seen first."""
    return F.array_distinct(F.regexp_extract_all(col, F.lit(TABLE_REFERENCE), F.lit(1)))


def unsafe_keyword(col: Column, whole_words: bool) -> Column:
    """First keyword the query contains, or NULL when it is safe.

    ``whole_words=False`` is a plain substring test and so flags
    ``last_updated`` too; ``True`` looks at whole words.
    """
    text = F.upper(col)
    hit = None
    for keyword in UNSAFE_KEYWORDS:
        found = F.regexp_like(text, F.lit(rf"\b{keyword}\b")) if whole_words else F.contains(text, F.lit(keyword))
        hit = F.when(found, keyword) if hit is None else hit.when(found, keyword)
    return hit
