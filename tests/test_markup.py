"""The token stream of web pages."""

import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestar.functions import markup as K
from lodestar.functions.html import BOILERPLATE_TAGS, WORD_EDGES

DROPPED, EDGES = frozenset(BOILERPLATE_TAGS), frozenset(WORD_EDGES)

PAGES = [
    ("<nav>a<nav>b</nav>tail</nav>x", "x"),
    ("<header>h<footer>f</header>t</footer>u", "tu"),
    ("<div><nav>a<b>c</div>tail", "  tail"),
    ("<nav>never closed <p>z", ""),
    ("a<script>if (a<b) '<!-- </nav>'</script>b", "ab"),
    ("<script>x</SCRIPT >y", "y"),
    ("<style>never closed", ""),
    ("a < b and c<3 <b>d</b>", "a < b and c<3 d"),
    ("<p title='a>b'>q</p>", " q "),
    ("<!-- <nav> -->k", "k"),
    ("k<!-- never closed <p>z", "k"),
    ("</nav>x<nav/>y", "xy"),
    ("a<br/>b<img src=x>c", "a b c"),
    ("<!DOCTYPE html><HTML><NAV>n</NAV>text", "text"),
    ("", ""),
]


@pytest.mark.parametrize("page,want", PAGES)
def test_text(page, want):
    assert K.text_of(page, DROPPED, EDGES) == want


def test_items_end_where_the_next_begins():
    assert K.texts_in("<ul><li>a<ul><li>b<li>c</ul>d<li>e</ul>", ["li"], DROPPED, frozenset()) == ["abcd", "b", "c", "e"]
    assert K.texts_in("<table><tr><td>1<td>2<tr><td>3</table>", ["tr", "td"], DROPPED, frozenset()) == ["12", "3", "1", "2", "3"]
    assert K.texts_in("<h1>a<nav>n</nav><b>x</b></h1><title>t</title><h1>z", ["title", "h1"], DROPPED, EDGES) == ["t", "ax", "z"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["<nav>", "</nav>", "<p>", "</p>", "<li>", "a", " ", "<", ">", "<!--", "-->", "<script>", "</script>", "<br>", "'", '"', "="]), max_size=25).map("".join))
def test_tokens_cover_the_page_and_elements_end_once(page):
    spans = list(K.tokens(page))
    assert "".join(page[a:b] for _, _, a, b in spans) == page
    depth = 0
    for kind, name, start, end, gone in K.elements(page):
        assert list(gone) == list(range(depth - 1, depth - 1 - len(gone), -1))
        depth -= len(gone)
        if kind == K.OPEN and name not in K.VOID and page[end - 2] != "/":
            depth += 1
    assert depth == 0
    assert "nav" not in [name for kind, name, *_ in K.tokens(K.without(page, DROPPED)) if kind == K.OPEN] or "<" in page


@pytest.mark.parametrize("bad", ["<a ", '<a x="', "<!--", "<a ='", "<script>", "<li>", "</p", "<"])
def test_malformed_pages_take_time_in_proportion(bad):
    began = time.perf_counter()
    K.text_of(bad * 5000, DROPPED, EDGES)
    assert time.perf_counter() - began < 5
