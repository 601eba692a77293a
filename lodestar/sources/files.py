"""Files in, JSON lines out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def extension_of(path: Column) -> Column:
    """Lower-cased extension with its dot, or an empty string."""
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def scan_files(spark: SparkSession, root: str, extensions: list[str] | None = None, content: bool = False) -> DataFrame:
    """Recursive listing of ``root``: path, extension, length, modification time.

    File bytes are read only when ``content`` is set; without it the scan
    never opens a file.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    columns = ["path", "modificationTime", "length"] + (["content"] if content else [])
    listed = files.select(*columns, extension_of(F.col("path")).alias("extension"))
    if extensions:
        wanted = [e.lower() if e.startswith(".") else f".{e.lower()}" for e in extensions]
        listed = listed.where(F.col("extension").isin(wanted))
    return listed


def decode_text(content: Column) -> Column:
    """Bytes as UTF-8; each bad sequence becomes U+FFFD."""
    return F.make_valid_utf8(content.cast("string"))


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON object per row."""
    df.write.mode(mode).json(path)


def json_safe(df: DataFrame) -> DataFrame:
    """Decimals become doubles so that rows print as plain JSON numbers."""
    return df.select(
        *[
            F.col(name).cast("double").alias(name) if kind.startswith("decimal") else F.col(name)
            for name, kind in df.dtypes
        ]
    )


def json_rows(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One JSON text per row, next to the row's own columns."""
    chosen = columns or df.columns
    safe = json_safe(df)
    return safe.withColumn("row_json", F.to_json(F.struct(*[F.col(c) for c in chosen])))


def preview(df: DataFrame, order: list[str], threshold: int = 5, shown: int = 3) -> DataFrame:
    """First ``shown`` rows when there are more than ``threshold``, else all of them."""
    head = df.orderBy(*order).limit(threshold + 1)
    size = head.agg(F.count(F.lit(1))).scalar()
    first = df.orderBy(*order).limit(threshold)
    numbered = first.select(*df.columns, F.row_number().over(_window(order)).alias("_n"))
    keep = F.when(size > threshold, F.lit(shown)).otherwise(F.lit(threshold))
    return numbered.where(F.col("_n") <= keep).drop("_n")


def _window(order):
    from pyspark.sql import Window

    # Only over the handful of rows that the limit above has left.
    return Window.orderBy(*order)
