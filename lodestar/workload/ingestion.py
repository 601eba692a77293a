"""Files, formats and web pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import html as H
from ..functions.strings import WS
from ..sources import files, formats
from .base import query

# --- SQL pieces shared by the page checks -----------------------------------


def sql_squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '{WS}+', ' ', 'g'))"


def sql_quote(text: str) -> str:
    return text.replace("'", "''")


#: Pages cut at each "<": what stands before the first, then the name and the rest of each tag; and how deep it is in boilerplate.
SQL_PIECES = f"""(SELECT *, sum(step) OVER (PARTITION BY page_id ORDER BY i) AS depth FROM (
  SELECT *, CASE WHEN name IN ({', '.join(f"'{t}'" for t in H.BOILERPLATE_TAGS)}) THEN 1 WHEN name IN ({', '.join(f"'/{t}'" for t in H.BOILERPLATE_TAGS)}) THEN -1 ELSE 0 END AS step
  FROM (SELECT page_id, i, s, CASE WHEN i = 1 THEN '' ELSE lower(split_part(split_part(s, '>', 1), ' ', 1)) END AS name,
    CASE WHEN i = 1 THEN s WHEN starts_with(s, '!--') THEN substr(s, instr(s, '-->') + 3) ELSE substr(s, instr(s, '>') + 1) END AS rest
    FROM (SELECT page_id, unnest(string_split(html, '<')) AS s, generate_subscripts(string_split(html, '<'), 1) AS i FROM pages))))"""
SQL_STRIPPED = f"""(SELECT page_id, string_agg(CASE WHEN i = 1 OR step = -1 OR starts_with(s, '!') THEN rest ELSE '<' || s END, '' ORDER BY i) AS x FROM {SQL_PIECES} WHERE depth = 0 GROUP BY page_id)"""
_EDGES = ", ".join(f"'{t}', '/{t}'" for t in H.WORD_EDGES)
SQL_TEXT = f"""(SELECT page_id, string_agg(CASE WHEN name IN ({_EDGES}) THEN ' ' || rest ELSE rest END, '' ORDER BY i) AS x FROM {SQL_PIECES} WHERE depth = 0 GROUP BY page_id)"""


def sql_unescape(x: str) -> str:
    for entity, char in H.ENTITIES:
        x = f"replace({x}, '{sql_quote(entity)}', '{sql_quote(char)}')"
    return x


def sql_paragraphs(x: str) -> str:
    lines = f"string_split(replace({sql_squeeze(x)}, '. ', '.' || chr(10)), chr(10))"
    return f"array_to_string(list_filter(list_transform({lines}, lambda l: trim(l)), lambda l: l <> ''), chr(10)||chr(10))"


@query("a01_scan_files")
def scan(t):
    """Listing of the folder the tables lie in. No SQL sees files."""
    found = files.scan_files(t.spark, t.folder, ["parquet"])
    return found.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), "length", "extension")


query("a02_route_formats", """
  SELECT page_id, CASE WHEN regexp_extract(url,'^([^:]*)://',1)='sharepoint' THEN 'sharepoint'
    WHEN regexp_extract(url,'^([^:]*)://',1)='onedrive' THEN 'onedrive'
    WHEN e='.pdf' THEN 'pdf' WHEN e IN ('.txt','.md') THEN 'text' WHEN e IN ('.csv','.xlsx','.xls') THEN 'excel'
    WHEN e IN ('.pptx','.ppt') THEN 'slides' WHEN e IN ('.mp3','.wav','.ogg','.m4a') THEN 'audio' ELSE 'text' END AS reader_kind,
    CASE WHEN ct IN ('table','spreadsheet') THEN 'table' WHEN ct IN ('slides','presentation') THEN 'slides' ELSE 'text' END AS chunker_kind
  FROM (SELECT page_id, url, lower(regexp_extract(url,'(\\.[^./]+)$',1)) AS e,
        CASE WHEN html LIKE '%<table%' THEN 'table' WHEN html LIKE '%<h1%' THEN 'presentation' ELSE 'text' END AS ct FROM pages)""")(
    lambda t: formats.route_formats(
        t.texts("pages").withColumn(
            "ct", F.when(F.contains("html", F.lit("<table")), "table").when(F.contains("html", F.lit("<h1")), "presentation").otherwise("text")
        ),
        "url",
        "ct",
    ).select("page_id", "reader_kind", "chunker_kind")
)

query("a03_decode_text", "SELECT doc_id, md5(text) AS text_md5, CAST(length(text) AS INTEGER) AS n FROM documents")(
    lambda t: t.texts("documents").select("doc_id", files.decode_text(F.encode("text", "UTF-8")).alias("x")).select(
        "doc_id", F.md5("x").alias("text_md5"), F.length("x").alias("n")
    )
)

query("a04_csv_as_text", """
  SELECT n_regionkey, 'CSV Data:' || chr(10) || '[' ||
    string_agg('{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '"}', ',' ORDER BY n_nationkey) || ']' AS text
  FROM nation GROUP BY 1""")(lambda t: formats.csv_as_text(t("nation"), ["n_regionkey"], ["n_nationkey"]))

for _style, _sql in (
    ("pages", "chr(10)||chr(10)||'--- Page '||turn||' ---'||chr(10)||chr(10)||text"),
    ("slides", "'Slide '||turn||':'||chr(10)||text||chr(10)||chr(10)"),
    ("tables", "chr(10)||chr(10)||'Table '||turn||':'||chr(10)||text||chr(10)"),
):
    _open = "'PowerPoint Presentation:'||chr(10)||chr(10)||" if _style == "slides" else ""
    query(f"a05_assemble_{_style}", f"""
      SELECT conv_id, {_open}string_agg({_sql}, '' ORDER BY turn) AS text, count(*) AS n_parts
      FROM conversations GROUP BY 1""")(
        lambda t, style=_style: formats.assemble_parts(t("conversations"), "conv_id", "turn", "text", style)
    )

# A range of pages is asked for by the caller; without one all parts are assembled.
query("a05_page_range", """
  SELECT conv_id, string_agg(chr(10)||chr(10)||'--- Page '||turn||' ---'||chr(10)||chr(10)||text, '' ORDER BY turn) AS text, count(*) AS n_parts
  FROM conversations WHERE turn >= 1 AND turn <= 3 GROUP BY 1""")(
    lambda t: formats.assemble_parts(t("conversations"), "conv_id", "turn", "text", "pages", 1, 3)
)


@query("a06_csv_json_round_trip", "SELECT c_custkey, c_name, c_mktsegment FROM customer")
def csv_json(t):
    lines = t("customer").select("c_custkey", F.to_csv(F.struct("c_custkey", "c_name", "c_mktsegment")).alias("csv_in"))
    schema = "c_custkey bigint, c_name string, c_mktsegment string"
    back = formats.json_to_csv(formats.csv_to_json(lines, "csv_in", schema), "json", schema)
    return back.select(F.from_csv("csv", schema).alias("r")).select("r.*")


@query("a07_json_xml_round_trip", "SELECT c_custkey, c_name, c_mktsegment FROM customer")
def json_xml(t):
    rows = t("customer").select(F.to_json(F.struct("c_custkey", "c_name", "c_mktsegment")).alias("json_in"))
    schema = "c_custkey bigint, c_name string, c_mktsegment string"
    back = formats.xml_to_json(formats.json_to_xml(rows, "json_in", schema, "customer"), "xml", schema)
    return back.select(F.from_json("json", schema).alias("r")).select("r.*")


query("b01_strip_boilerplate", f"""
  SELECT page_id, md5(x) AS html_md5, CAST(length(x) AS INTEGER) AS n FROM {SQL_STRIPPED}""")(
    lambda t: t.texts("pages").select("page_id", H.strip_boilerplate(F.col("html")).alias("x")).select(
        "page_id", F.md5("x").alias("html_md5"), F.length("x").alias("n")
    )
)
query("b02_html_to_text", f"SELECT page_id, {sql_squeeze(sql_unescape('x'))} AS text FROM {SQL_TEXT}")(
    lambda t: t.texts("pages").select("page_id", H.html_to_text(F.col("html")).alias("text"))
)
query("b03_extract_tags", f"""
  WITH p AS MATERIALIZED {SQL_PIECES},
  inside AS (SELECT page_id, tag, i, rest, sum(CASE name WHEN tag THEN 1 ELSE 0 END) OVER w AS n, sum(CASE name WHEN tag THEN 1 WHEN '/' || tag THEN -1 ELSE 0 END) OVER w AS open
    FROM p, (VALUES ('h1'), ('title')) AS v(tag) WHERE depth = 0 WINDOW w AS (PARTITION BY page_id, tag ORDER BY i)),
  found AS (SELECT page_id, tag, n, {sql_squeeze(sql_unescape("string_agg(rest, '' ORDER BY i)"))} AS x FROM inside WHERE open = 1 GROUP BY ALL)
  SELECT page_id, coalesce(string_agg(x, chr(10)||chr(10) ORDER BY tag, n) FILTER (x <> ''), '') AS text FROM pages LEFT JOIN found USING (page_id) GROUP BY page_id""")(
    lambda t: t.texts("pages").select("page_id", H.extract_tags(F.col("html"), ["h1", "title"]).alias("text"))
)
query("b04_normalise_paragraphs", f"SELECT doc_id, md5({sql_paragraphs('text')}) AS text_md5 FROM documents")(
    lambda t: t.texts("documents").select("doc_id", F.md5(H.normalise_paragraphs(F.col("text"))).alias("text_md5"))
)
query("b05_page_metadata", f"""
  SELECT page_id, url, CASE WHEN regexp_matches(html, '{H.tag_pattern("title")}')
     THEN {sql_squeeze(sql_unescape(f"regexp_extract(html, '{H.tag_pattern('title')}', 1)"))} END AS title,
     CAST(CASE WHEN regexp_matches(html, '{H.tag_pattern("title")}') THEN 2 ELSE 1 END AS INTEGER) AS n_keys FROM pages""")(
    lambda t: t.texts("pages").select("page_id", H.page_metadata(F.col("url"), F.col("html")).alias("m")).select(
        "page_id", F.col("m")["url"].alias("url"), F.try_element_at("m", F.lit("title")).alias("title"), F.size("m").alias("n_keys")
    )
)
query("b06_url_doc_id", "SELECT page_id, md5(url) AS doc_id FROM pages")(
    lambda t: t.texts("pages").select("page_id", H.url_doc_id(F.col("url")).alias("doc_id"))
)
query("b07_merge_metadata", """
  SELECT doc_id, lang AS language, 'batch' AS source, CAST(doc_id AS VARCHAR) AS document_id FROM documents""")(
    lambda t: t.texts("documents").select(
        "doc_id",
        H.merge_metadata(
            F.create_map(F.lit("language"), F.col("lang"), F.lit("source"), F.col("source")),
            F.create_map(F.lit("source"), F.lit("batch"), F.lit("document_id"), F.col("doc_id").cast("string")),
        ).alias("m"),
    ).select("doc_id", F.col("m")["language"].alias("language"), F.col("m")["source"].alias("source"), F.col("m")["document_id"].alias("document_id"))
)
