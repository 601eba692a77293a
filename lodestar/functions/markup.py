"""HTML as a stream of tokens with a stack of open elements.

A page is read once, from left to right. Scripts and styles hold raw text up to
their own end tag, void elements have no content, some elements end where another
begins, and an end tag closes everything opened inside its element. What is open
at the end of the page ends there. No regular expression spans more than one tag,
so the time is in proportion to the page.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column

from .pieces import text_function

# Fixed values of the HTML standard: elements without content, with raw text, and those that end an open one of the same group.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset(("script", "style"))
ITEMS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
#: An item ends the one before it in the same list or table only.
HOLDERS = frozenset(("ul", "ol", "dl", "select", "table"))

# Possessive: a tag that is never closed is given up at once.
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:=\s*+"[^"]*+"|=\s*+'[^']*+'|[^>])*+)>""")
_OTHER = re.compile(r"<[!?][^>]*+>")

TEXT, OPEN, CLOSE, NOTE = range(4)


def tokens(page: str) -> Iterator[tuple[int, str, int, int]]:
    """(kind, name, start, end) of texts, tags, and comments with declarations, in order and without gaps."""
    at = start = 0
    last = page.rfind(">")  # no tag begins behind it
    while (at := page.find("<", at)) >= 0 and (at < last or page.startswith("<!--", at)):
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            kind, name, end = NOTE, "", len(page) if end < 0 else end + 3
        elif found := _TAG.match(page, at):
            kind, name, end = CLOSE if found[1] else OPEN, found[2].lower(), found.end()
        elif found := _OTHER.match(page, at):
            kind, name, end = NOTE, "", found.end()
        else:
            at += 1  # a sign in the text
            continue
        if start < at:
            yield TEXT, "", start, at
        yield kind, name, at, end
        at = start = end
        if kind == OPEN and name in RAW and page[end - 2] != "/":
            closing = re.compile(rf"</{name}[\s/>]", re.I).search(page, end)
            at = closing.start() if closing else len(page)
            if start < at:
                yield TEXT, "", start, at
                start = at
    if start < len(page):
        yield TEXT, "", start, len(page)


def elements(page: str) -> Iterator[tuple[int, str, int, int, tuple[int, ...]]]:
    """The tokens of ``tokens`` with the numbers of the elements that end before each of them.

    A number is the count of elements open outside of it. The last token is (NOTE, "", n, n).
    """
    stack: list[str] = []

    def ended(size: int) -> tuple[int, ...]:
        gone = tuple(range(len(stack) - 1, size - 1, -1))
        del stack[size:]
        return gone

    for kind, name, start, end in tokens(page):
        gone: tuple[int, ...] = ()
        if kind == OPEN:
            if name in ITEMS:
                first = None
                for size in range(len(stack) - 1, -1, -1):
                    if stack[size] in HOLDERS:
                        break
                    if stack[size] in ITEMS[name]:
                        first = size
                if first is not None:
                    gone = ended(first)
            yield kind, name, start, end, gone
            if name not in VOID and page[end - 2] != "/":
                stack.append(name)
        elif kind == CLOSE and name in stack:
            size = len(stack) - 1 - stack[::-1].index(name)
            yield kind, name, start, end, ended(size)
        else:
            yield kind, name, start, end, gone
    yield NOTE, "", len(page), len(page), ended(0)


def kept_pieces(page: str, dropped: frozenset[str]) -> Iterator[tuple[int, str, int, int]]:
    """The tokens outside the dropped elements, without comments and declarations."""
    depth, cut = 0, None
    for kind, name, start, end, gone in elements(page):
        depth -= len(gone)
        inside = cut is not None
        if inside and depth <= cut:
            cut = None
            # The end tag of the dropped element itself goes with it; any other token stands outside.
            inside = kind == CLOSE and depth == min(gone) and name in dropped
        if not inside and cut is None and kind == OPEN and name in dropped:
            if name not in VOID and page[end - 2] != "/":
                cut = depth
            inside = True
        if not inside and cut is None and kind != NOTE:
            yield kind, name, start, end
        if kind == OPEN and name not in VOID and page[end - 2] != "/":
            depth += 1


def without(page: str, dropped: frozenset[str]) -> str:
    return "".join(page[start:end] for _, _, start, end in kept_pieces(page, dropped))


def text_of(page: str, dropped: frozenset[str], edges: frozenset[str]) -> str:
    """Texts outside the dropped elements, with a space for each tag at whose edges words part. Entities stay."""
    return "".join(page[start:end] if kind == TEXT else " " if name in edges else "" for kind, name, start, end in kept_pieces(page, dropped))


def texts_in(page: str, names: list[str], dropped: frozenset[str], edges: frozenset[str]) -> list[str]:
    """The text of each element of the names, in the order of the names, then of the page; an element inside another stands in both."""
    body = without(page, dropped)
    found: dict[str, list[list]] = {name: [] for name in names}
    open_: list[tuple[int, list]] = []
    depth = 0
    for kind, name, start, end, gone in elements(body):
        depth -= len(gone)
        open_ = [(size, out) for size, out in open_ if size < depth]
        piece = body[start:end] if kind == TEXT else " " if name in edges else ""
        for _, out in open_:
            out.append(piece)
        if kind == OPEN and name not in VOID and body[end - 2] != "/":
            if name in found:
                found[name].append([])
                open_.append((depth, found[name][-1]))
            depth += 1
    return ["".join(out) for name in names for out in found[name]]


def _column(fn, kind: str):
    form = pa.list_(pa.string()) if kind == "array<string>" else pa.string()
    return text_function(kind, lambda: lambda pages: pa.array([None if page is None else fn(page) for page in pages], form))


def without_elements(html: Column, dropped: tuple[str, ...]) -> Column:
    names = frozenset(dropped)
    return _column(lambda page: without(page, names), "string")(html)


def element_text(html: Column, dropped: tuple[str, ...], edges: tuple[str, ...]) -> Column:
    names, parts = frozenset(dropped), frozenset(edges)
    return _column(lambda page: text_of(page, names, parts), "string")(html)


def element_texts(html: Column, tags: list[str], dropped: tuple[str, ...], edges: tuple[str, ...]) -> Column:
    names, parts, wanted = frozenset(dropped), frozenset(edges), [t.lower() for t in tags]
    return _column(lambda page: texts_in(page, wanted, names, parts), "array<string>")(html)
