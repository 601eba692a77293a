"""Format routing, table-to-text rendering, part assembly and conversions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .files import extension_of

# Which reader and chunker serve which kind of input.
READER_BY_EXTENSION = {
    "pdf": [".pdf"],
    "text": [".txt", ".md"],
    "excel": [".csv", ".xlsx", ".xls"],
    "slides": [".pptx", ".ppt"],
    "audio": [".mp3", ".wav", ".ogg", ".m4a"],
}
READER_BY_SCHEME = {"sharepoint": "sharepoint", "onedrive": "onedrive"}
CHUNKER_BY_CONTENT = {
    "table": ["table", "spreadsheet"],
    "slides": ["slides", "presentation"],
}


def reader_kind(path: Column) -> Column:
    """Scheme first, then extension; anything unknown is read as text."""
    scheme = F.regexp_extract(path, r"^([^:]*)://", 1)
    kind = None
    for name, reader in READER_BY_SCHEME.items():
        kind = F.when(scheme == name, reader) if kind is None else kind.when(scheme == name, reader)
    for reader, extensions in READER_BY_EXTENSION.items():
        kind = kind.when(extension_of(path).isin(extensions), reader)
    return kind.otherwise("text")


def chunker_kind(content_type: Column) -> Column:
    kind = None
    for chunker, contents in CHUNKER_BY_CONTENT.items():
        hit = content_type.isin(contents)
        kind = F.when(hit, chunker) if kind is None else kind.when(hit, chunker)
    return kind.otherwise("text")


def route_formats(df: DataFrame, path_col: str, content_type_col: str | None = None) -> DataFrame:
    content_type = F.col(content_type_col) if content_type_col else F.lit("text")
    return df.withColumn("reader_kind", reader_kind(F.col(path_col))).withColumn(
        "chunker_kind", chunker_kind(content_type)
    )


def csv_as_text(df: DataFrame, group_cols: list[str], order_cols: list[str]) -> DataFrame:
    """Rows of one source file as the text that gets indexed: a header and a JSON array."""
    row = F.struct(
        F.struct(*[F.col(c) for c in order_cols]).alias("k"),
        F.to_json(F.struct(*[F.col(c) for c in df.columns if c not in group_cols])).alias("j"),
    )
    ordered = F.transform(F.array_sort(F.collect_list(row)), lambda r: r["j"])
    return df.groupBy(*group_cols).agg(
        F.concat(F.lit("CSV Data:\n["), F.array_join(ordered, ","), F.lit("]")).alias("text")
    )


# How a part is announced in the assembled text.
PART_STYLES = {
    "pages": ("", "\n\n--- Page ", " ---\n\n", ""),
    "slides": ("PowerPoint Presentation:\n\n", "Slide ", ":\n", "\n\n"),
    "tables": ("", "\n\nTable ", ":\n", "\n"),
}


def assemble_parts(
    parts: DataFrame, doc_col: str, no_col: str, text_col: str, style: str, start: int | None = None, end: int | None = None
) -> DataFrame:
    """Ordered parts of each document as one text; ``start``/``end`` are inclusive part numbers."""
    opening, before, after, closing = PART_STYLES[style]
    if start is not None:
        parts = parts.where(F.col(no_col) >= start)
    if end is not None:
        parts = parts.where(F.col(no_col) <= end)
    rendered = F.concat(
        F.lit(before), F.col(no_col).cast("string"), F.lit(after), F.coalesce(F.col(text_col), F.lit("")), F.lit(closing)
    )
    entry = F.struct(F.col(no_col).alias("n"), rendered.alias("t"))
    ordered = F.transform(F.array_sort(F.collect_list(entry)), lambda p: p["t"])
    return parts.groupBy(doc_col).agg(
        F.concat(F.lit(opening), F.array_join(ordered, "")).alias("text"),
        F.count(F.lit(1)).alias("n_parts"),
    )


def _ddl(schema: str | T.StructType) -> str:
    return schema if isinstance(schema, str) else ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)


def csv_to_json(df: DataFrame, csv_col: str, schema: str | T.StructType) -> DataFrame:
    """CSV lines in a column → one JSON record per row."""
    return df.withColumn("json", F.to_json(F.from_csv(F.col(csv_col), _ddl(schema))))


def json_to_csv(df: DataFrame, json_col: str, schema: str | T.StructType) -> DataFrame:
    return df.withColumn("csv", F.to_csv(F.from_json(F.col(json_col), _ddl(schema))))


def json_to_xml(df: DataFrame, json_col: str, schema: str | T.StructType, root: str = "root") -> DataFrame:
    parsed = F.from_json(F.col(json_col), _ddl(schema))
    return df.withColumn("xml", F.to_xml(parsed, {"rowTag": root}))


def xml_to_json(df: DataFrame, xml_col: str, schema: str | T.StructType) -> DataFrame:
    """Repeated child tags are arrays in ``schema``; leaf text is trimmed, empty is null."""
    parsed = F.from_xml(F.col(xml_col), _ddl(schema), {"ignoreSurroundingSpaces": "true", "nullValue": ""})
    return df.withColumn("json", F.to_json(parsed))
