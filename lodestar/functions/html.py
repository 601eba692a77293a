"""Web pages to text: elements by a token stream, entities and spaces by expressions inside the JVM."""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from .markup import element_text, element_texts, without_elements
from .strings import squeeze

# Subtrees that carry no content,
# tags at whose edges words part, and the commonest entities (ampersand last).
BOILERPLATE_TAGS = ("script", "style", "header", "footer", "nav", "aside")
BLOCK_TAGS = (
    "div", "p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "tr", "td", "th", "table", "ul", "ol", "article", "section",
)
ENTITIES = (
    ("&copy;", "©"),
    ("&middot;", "·"),
    ("&nbsp;", " "),
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&#39;", "'"),
    ("&amp;", "&"),
)

WORD_EDGES = (*BLOCK_TAGS, "br", "img")
BLOCK_EDGE = r"(?i)</?(?:" + "|".join(BLOCK_TAGS) + r")(?:\s[^>]*)?>|<br\s*/?>|<img(?:\s[^>]*)?>"
# A tag begins with a letter, a slash, or the sign of a declaration; any other "<" is text.
ANY_TAG = r"</?[a-zA-Z][^>]*>|<[!?][^>]*>"


def strip_boilerplate(html: Column) -> Column:
    """The page without its boilerplate elements, nested or never closed ones too, and without comments."""
    return without_elements(html, BOILERPLATE_TAGS)


ENTITY = r"&(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-zA-Z][a-zA-Z0-9]*);"
# The commonest first, since a map is searched from its front. A hard space is a space here.
_NAMED = {entity[1:-1]: char for entity, char in ENTITIES if entity[1] != "#"}
_NAMED.update((name[:-1], char) for name, char in html5.items() if name.endswith(";") and name[:-1] not in _NAMED)


def _code_point(number: Column) -> Column:
    """The character of a code point; what is none becomes U+FFFD."""
    valid = ((number > 0) & (number < 0xD800)) | ((number > 0xDFFF) & (number <= 0x10FFFF))
    safe = F.when(valid, number).otherwise(0xFFFD)
    char = F.decode(F.unhex(F.lpad(F.hex(safe), 8, "0")), "UTF-32")
    return F.when(number == 0xA0, " ").otherwise(char)


def unescape(col: Column) -> Column:
    """Every named or numbered character reference, once; names that are unknown stay."""
    named = F.from_json(F.lit(json.dumps(_NAMED)), "map<string,string>")

    def char(name: Column) -> Column:
        hexadecimal = F.conv(F.substring(name, 3, 6), 16, 10).cast("bigint")
        decimal = F.substring(name, 2, 7).try_cast("bigint")
        return (
            F.when(F.lower(F.substring(name, 1, 2)) == "#x", _code_point(hexadecimal))
            .when(F.startswith(name, F.lit("#")), _code_point(decimal))
            .otherwise(F.coalesce(F.try_element_at(named, name), F.concat(F.lit("&"), name, F.lit(";"))))
        )

    # An entity ends the text before it; the last piece has none.
    chars = F.transform(F.regexp_extract_all(col, F.lit(ENTITY), F.lit(1)), char)
    pieces = F.zip_with(F.split(col, ENTITY, -1), chars, lambda text, c: F.concat(text, F.coalesce(c, F.lit(""))))
    return F.when(F.contains(col, F.lit("&")), F.array_join(pieces, "")).otherwise(col)


def fragment_text(html: Column) -> Column:
    """Text of a piece of HTML: blocks and images become spaces, links keep their words."""
    spaced = F.regexp_replace(html, BLOCK_EDGE, " ")
    return squeeze(unescape(F.regexp_replace(spaced, ANY_TAG, "")))


def html_to_text(html: Column) -> Column:
    return squeeze(unescape(element_text(html, BOILERPLATE_TAGS, WORD_EDGES)))


def tag_pattern(tag: str) -> str:
    return rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}\s*>"


def extract_tags(html: Column, tags: list[str]) -> Column:
    """Text inside the given tags: in the order of the list, then of the page."""
    texts = F.transform(element_texts(html, tags, BOILERPLATE_TAGS, WORD_EDGES), lambda x: squeeze(unescape(x)))
    return F.array_join(F.filter(texts, lambda t: t != ""), "\n\n")


def normalise_paragraphs(text: Column) -> Column:
    """One sentence per paragraph."""
    lines = F.split(F.replace(squeeze(text), F.lit(". "), F.lit(".\n")), "\n")
    trimmed = F.transform(lines, lambda line: F.trim(line))
    return F.array_join(F.filter(trimmed, lambda line: line != ""), "\n\n")


def _attribute(tag: Column, name: str) -> Column:
    return F.regexp_extract(tag, rf"""(?is)\s{name}\s*=\s*["']([^"']*)["']""", 1)


def page_metadata(url: Column, html: Column, fetch_time: Column | None = None) -> Column:
    """MAP of url, fetch_time, title, description, og_* and published_date.

    Keys without a value on the page are left out; a repeated ``og:`` property
    keeps its last value.
    """
    metas = F.regexp_extract_all(html, F.lit(r"(?is)<meta\s[^>]*>"), F.lit(0))
    title = F.regexp_extract(html, tag_pattern("title"), 1)
    has_title = F.regexp_like(html, F.lit(tag_pattern("title")))

    def first_content(attribute: str, value: str) -> Column:
        return F.get(
            F.transform(
                F.filter(metas, lambda m: F.lower(_attribute(m, attribute)) == value),
                lambda m: unescape(_attribute(m, "content")),
            ),
            F.lit(0),
        )

    fixed = F.array(
        F.struct(F.lit("url").alias("key"), url.alias("value")),
        F.struct(
            F.lit("fetch_time").alias("key"),
            (F.lit(None) if fetch_time is None else fetch_time).cast("string").alias("value"),
        ),
        F.struct(
            F.lit("title").alias("key"),
            F.when(has_title, squeeze(unescape(title))).alias("value"),
        ),
        F.struct(F.lit("description").alias("key"), first_content("name", "description").alias("value")),
        F.struct(
            F.lit("published_date").alias("key"),
            first_content("property", "article:published_time").alias("value"),
        ),
    )
    graph = F.transform(
        F.filter(metas, lambda m: F.length(_attribute(m, "property")) > 3),
        lambda m: F.struct(
            F.regexp_replace(_attribute(m, "property"), "^og:", "og_").alias("key"),
            unescape(_attribute(m, "content")).alias("value"),
        ),
    )
    graph = F.filter(graph, lambda e: e["key"].startswith("og_"))
    names = F.array_distinct(F.transform(graph, lambda e: e["key"]))
    last = F.transform(
        names,
        lambda n: F.struct(
            n.alias("key"),
            F.element_at(F.filter(graph, lambda e: e["key"] == n), -1)["value"].alias("value"),
        ),
    )
    return F.map_from_entries(F.filter(F.concat(fixed, last), lambda e: e["value"].isNotNull()))


def url_doc_id(url: Column) -> Column:
    return F.md5(url)


def merge_metadata(base: Column, over: Column) -> Column:
    """Union of two MAPs; entries of ``over`` win."""
    kept = F.map_filter(base, lambda k, _: ~F.array_contains(F.map_keys(over), k))
    return F.when(over.isNull(), base).when(base.isNull(), over).otherwise(F.map_concat(kept, over))
