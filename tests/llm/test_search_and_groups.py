"""Lexical search, SimHash and spelling against brute force, and on odd input."""

import base64
import gzip
import hashlib
import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from conftest import SMALL
from lodestar.llm import chat, jaccard, lexical, mixing, rules, simhash, spelling, urls, warc

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ODD = [
    (1, "one two three four five six seven"), (2, "One  two three\nfour five six SEVEN"), (3, None), (4, ""), (5, " \t\n"),
    (6, " ".join(f"w{i % 977}" for i in range(90_000))), (7, "one, two: été où"), (7, "one, two: été où"), (None, "one two three four five six seven"), (8, "a b"), (9, "x" * 5000),
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "s", 1, 2, "k", 0.5, 3) for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, block int, n int, term string, score double, fp int")


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


def ranked(docs, items, k):
    held = [(i, Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in docs]
    n_docs, n_terms = sum(bool(c) for _, c in held), sum(sum(c.values()) for _, c in held)
    df = Counter(w for _, c in held for w in c)
    out = []
    for item, text in items:
        found = []
        for doc, c in held:
            n, score = sum(c.values()), 0
            for w in TERM.findall((text or "").translate(LOWER)):
                if c[w]:
                    weight = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1)))
                    score += weight * (10**9 * c[w] // (1000 * c[w] + 12 * (75 + 25 * n * n_docs // n_terms)))
            if score > 0:
                found.append((-score, doc is None, doc or 0, doc))
        out += [(item, r + 1, doc, -score) for r, (score, _, _, doc) in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


ASKED = [("a", "one ONE seven"), ("a", "w1 w2 b"), (None, "été"), ("c", None), ("d", "nothing like it"), ("e", "")]


@pytest.mark.parametrize("k", [2, 20])
def test_lexical_search_on_odd_input(spark, odd, none, k, monkeypatch):
    items = spark.createDataFrame([(i, t, 7, 1) for i, t in ASKED], "item_id string, text string, q int, doc_id int")
    monkeypatch.setattr(lexical, "BLOCK_DOCS", 2)
    monkeypatch.setattr(lexical, "BUNDLE_ITEMS", 2)
    got = [tuple(r) for r in lexical.rank_documents(odd, items, k).collect()]
    assert sorted(got, key=str) == ranked(ODD, ASKED, k)
    if k == 2:
        assert lexical.rank_documents(none, items, k).count() == 0 and lexical.rank_documents(odd, items.limit(0), k).count() == 0


def test_lexical_search_in_many_blocks(spark, monkeypatch):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{SMALL}/benchmark.parquet").where("item_id < 40").select("item_id", "text")
    monkeypatch.setattr(lexical, "BLOCK_DOCS", 16)
    monkeypatch.setattr(lexical, "BUNDLE_ITEMS", 15)
    got = [tuple(r) for r in lexical.rank_documents(docs, items, 5).collect()]
    assert sorted(got, key=str) == ranked([tuple(r) for r in docs.collect()], [tuple(r) for r in items.collect()], 5)


def fingerprint(text):
    words = SPACED.findall((text or "").translate(LOWER))
    runs = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashed = [xxhash.xxh64_intdigest(s.encode(), 42) for s in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in hashed) > len(hashed))


def linked(prints):
    parent = {}

    def top(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for (i, a), (j, b) in itertools.combinations(prints, 2):
        if (a ^ b).bit_count() <= 2:
            x, y = sorted((top(i), top(j)))
            parent[y] = x
    return {(i, f"{f:016x}", top(i)) for i, f in prints}


def test_simhash_on_odd_input(odd, none):
    got = simhash.simhash_components(odd).collect()
    want = linked([(i, fingerprint(t)) for i, t in ODD if i is not None])
    assert len(got) == len(ODD) and {tuple(r) for r in got if r.doc_id is not None} == want
    assert [tuple(r) for r in got if r.doc_id is None] == [(None, f"{fingerprint(ODD[0][1]):016x}", None)]
    assert simhash.simhash_components(none).count() == 0


@pytest.mark.parametrize("full,tile", [(512, 1024), (3, 2)])
def test_linked_fingerprints(spark, full, tile, monkeypatch):
    rng = np.random.default_rng(4)
    base = [int(x) for x in rng.integers(0, 1 << 63, 40)]
    prints = {b ^ sum(1 << int(i) for i in rng.choice(64, rng.integers(0, 4), replace=False)) for b in base for _ in range(4)} | {0, 1, 3, 7, (1 << 64) - 1}
    monkeypatch.setattr(simhash, "FULL", full)
    monkeypatch.setattr(simhash, "TILE", tile)
    table = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in prints], "fp long")
    edges = [(r.a % (1 << 64), r.b % (1 << 64)) for r in simhash.linked(table).collect()]
    assert all((a ^ b).bit_count() <= 2 * 64 for a, b in edges)
    want = {(i, c) for i, _, c in linked([(x, x) for x in prints])}
    parent = {x: x for x in prints}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((top(a), top(b)))
        parent[y] = x
    assert {(x, top(x)) for x in prints} == want


def test_parts_leave_no_pair_out():
    for parts in (1, 2, 3, 5, 8):
        bounds, steps = simhash.part_bounds(parts), set(simhash.neighbours(parts, 2))
        code = lambda x: sum(((x >> a) & ((1 << b - a) - 1)).bit_count() << 7 * (parts - 1 - i) for i, (a, b) in enumerate(zip(bounds, bounds[1:])))
        for i, j in itertools.combinations(range(64), 2):
            for x in (0, (1 << 64) - 1, 0xF0F0123456789ABC):
                step = code(x ^ 1 << i ^ 1 << j) - code(x)
                assert step in steps or -step in steps


def spelled(rows):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    form, out = {}, []
    found = {w: [v for v in counts if near(w, v)] for w in counts}
    for w, n in counts.items():
        best = min(found[w], key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best and counts[best] >= 2 * n else None
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, n, len(found[w]), form[w], counts.get(form[w]), root))
    return sorted(out)


VARIANTS = [(i, "colour colour colour color color color coulour  MÜLLER müller muller Muller Müllers  aaaaa aaaaab baaaaa abababab") for i in range(6)] + [
    (90, "colour " * 20 + "coolour " * 3 + "resume " * 4 + "résume " * 9), (None, "aaaaa " * 9), (91, None), (92, ""), (93, "z" * 3000 + " " + "z" * 2999 + " " + "z" * 3000),
    (93, "z" * 3000 + " " + "z" * 2999), (94, "z" * 2999), (95, "abcde " * 4 + "edcba " * 4 + "abced " * 3),
]


@pytest.mark.parametrize("cell,leaf", [(1 << 14, 32), (2, 1)])
def test_spelling_on_odd_input(spark, cell, leaf, monkeypatch):
    monkeypatch.setattr(spelling, "CELL", cell)
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in VARIANTS], "doc_id long, text string, n int, word string")
    got = sorted(tuple(r) for r in spelling.spelling_variants(docs).select("word", "n", "n_near", "form", "form_n", "root").collect())
    assert got == spelled(VARIANTS)
    if leaf == 1:
        assert spelling.spelling_variants(docs.limit(0)).count() == 0


def test_lower_tree_finds_what_a_scan_finds():
    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list("abcdeé"), 6)) for _ in range(700)]
    vectors = spelling.count_vectors(words)
    tree = spelling.LowerTree(vectors)
    found = {(int(a), int(b)) for who, what in tree.within(vectors, 2) for a, b in zip(who, what)}
    far = np.abs(vectors[:, None].astype(int) - vectors[None]).sum(axis=2)
    assert found == {(int(a), int(b)) for a, b in zip(*np.nonzero(far <= 2))}
    a, b = spelling._letters(["abcde", "abcde"]), spelling._letters(["abde", "acbd"])
    assert spelling.one_taken_out(a, b).tolist() == [True, False]


def test_a_malformed_turn_takes_time_in_proportion():
    with pytest.raises(ValueError):
        chat.parse_turn("### user: " + "a" * 100_000)
    with pytest.raises(ValueError):
        chat.parse_turn("### user: " + "\\<a " * 30_000 + "</turn>")


def test_mixing_with_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b c", "s", "x", 5), (2, "d e", "r", "y", 6)], "doc_id long, text string, source string, _source string, copy int")
    made = mixing.mixed(docs)
    assert made.columns == ["doc_id", "text", "source", "_source", "copy"] and {r._source for r in made.collect()} <= {"x", "y"}


def test_other_scripts_pass_the_stop_word_rule(spark):
    prose = "Это обычный русский текст про жизнь города и людей которые живут рядом с рекой "
    texts = [" ".join(f"{w}{i}" for i in range(6) for w in prose.split()), " ".join(f"qzxv{i}" for i in range(120))]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.kept for r in rules.quality_rules(rows).orderBy("doc_id").collect()] == [True, False]


def test_keep_one_without_ids(spark):
    text = "one two three four five six seven eight"
    rows = [(None, text), (None, text), (None, text + " "), (4, "another text of some words here"), (4, "another text of some words here"), (None, None), (None, "")]
    for kind in ("long", "string"):
        docs = spark.createDataFrame([(None if i is None else i if kind == "long" else f"d{i}", t, 1) for i, t in rows], f"doc_id {kind}, text string, _row int")
        kept = jaccard.keep_one(docs)
        assert kept.columns == docs.columns and Counter(str(r.text).strip() for r in kept.collect()) == {text: 1, rows[3][1]: 1, "None": 1, "": 1}


def archive(folder, records):
    folder.mkdir()
    blocks = [
        "WARC/1.1\r\n" + "".join(f"{name}: {value}\r\n" for name, value in headers) + f"Content-Length: {len(block.encode())}\r\n\r\n{block}\r\n\r\n" for headers, block in records
    ]
    (folder / "one.warc.gz").write_bytes(b"".join(gzip.compress(b.encode()) for b in blocks))
    return str(folder)


def record(kind, name, *others, block=""):
    headers = [("WARC-Type", kind), ("WARC-Record-ID", name), ("WARC-Target-URI", "http://x/")] + [("WARC-Concurrent-To", o) for o in others]
    if kind == "response":
        block = "HTTP/1.1 200 OK\r\n\r\n" + block
        headers.append(("WARC-Payload-Digest", "sha1:" + base64.b32encode(hashlib.sha1(block.partition("\r\n\r\n")[2].encode()).digest()).decode()))
    return headers, block


def test_captures_of_other_archives(spark, tmp_path):
    path = archive(tmp_path / "a", [
        record("response", "r1", "m1", "q1", block="swapped"), record("request", "q1", block="GET /1 HTTP/1.1\r\n\r\n"), record("metadata", "m1", block="page-id: 1\r\n"),
        record("response", "r2", "q2", "m2", block="no metadata"), record("request", "q2", block="GET /2"),
        record("response", "r3", block="named by the request"), record("request", "q3", "r3", block="GET /3"), record("metadata", "m3", "r3", block="page-id: 3"),
        record("response", "r4", block="alone"),
        record("request", "q5", "r5", block="GET /5"), record("metadata", "m6", block="other: x"),
    ])
    rows = warc.read_captures(spark, path).collect()
    got = {(r.capture and r.capture.record, r.request and r.request.record, r.metadata and r.metadata.record, r.metadata and r.metadata.page_id) for r in rows}
    assert got == {("r1", "q1", "m1", 1), ("r2", "q2", None, None), ("r3", "q3", "m3", 3), ("r4", None, None, None), (None, "q5", None, None), (None, None, "m6", None)}
    assert {r.request.fields.split()[1] for r in rows if r.request} == {"/1", "/2", "/3", "/5"} and len(rows) == 6


def test_url_model_decides_on_urls_it_has_not_seen(spark):
    model = urls.fit()
    false, missed = urls.errors(model, urls.labelled_urls(1000, 99))
    assert false < 0.02 and missed < 0.2
    cases = [("http://casino-bonus.win/free-spins?ref=1", "block"), ("http://mega-casino.bet/slots", "block"), ("https://best-pills.shop/buy", "block"),
             ("https://city.library.org/en/books", "allow"), ("https://de.wikipedia.org/wiki/Berlin", "allow"), ("https://therwh.example.org/de/6611", "allow"), (None, "allow"), ("no scheme", "allow")]
    table = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(cases)], "page_id long, url string")
    got = {r.page_id: (r.verdict, r.rule) for r in urls.judge_urls(table).collect()}
    assert got == {i: (v, None) for i, (_, v) in enumerate(cases)}
    rules = urls.Rules(urls.RULES)
    for host in ("example.com", "www.example.com", "a.www.example.com", "x.net", "com", "net.org", ""):
        for path in ("", "/", "/en/", "/en", "/es/1", "/fr/"):
            fits = [(len(r), r, v) for r, v in urls.RULES if (host == r.partition("/")[0] or host.endswith("." + r.partition("/")[0])) and path.startswith("/" + r.partition("/")[2])]
            assert rules.match(host, path) == (max(fits)[1:] if fits else (None, None))
