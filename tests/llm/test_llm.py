"""The training-data operators against brute force, and on odd input."""

import hashlib
import itertools
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import check_oracles
from conftest import SMALL
from lodestar.llm import attention, chat, classifier, decontaminate, jaccard, licenses, lm, mixing, queries, rules, urls, warc
from lodestar.llm.components import components

REGISTRY = queries.load()
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LONG = " ".join(f"w{i}" for i in range(6000))
ODD = [
    (1, "one two three four five six seven"), (2, "One  two three\nfour five six SEVEN"), (3, None), (4, ""), (5, " \t\n"),
    (6, LONG), (7, LONG + " tail"), (7, LONG + " tail"), (None, "one two three four five six seven"), (8, "a b"), (9, "A B"), (10, "été où"),
]


@pytest.fixture(scope="module")
def con():
    return check_oracles.duck(SMALL)


@pytest.fixture(scope="module")
def odd(spark):
    """Odd texts, with columns whose names the operators use themselves."""
    rows = [(i, t, "s", "en", 1, 2.0, "k") for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_words long, score double, key string")


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


@pytest.mark.parametrize("name", sorted(n for n in REGISTRY if REGISTRY[n].sql))
def test_sql(spark, con, name):
    assert check_oracles.compare(REGISTRY[name].run(spark, SMALL), con, REGISTRY[name].sql) is None


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_no_cross_join(spark, name):
    if name != "pipeline":
        plan = REGISTRY[name].run(spark, SMALL)._jdf.queryExecution().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def sets(text):
    words = SPACED.findall((text or "").translate(LOWER))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def groups(rows):
    found, parent = [(i, sets(t)) for i, t in rows if i is not None], {}

    def top(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for (i, a), (j, b) in itertools.combinations(found, 2):
        if a and b and 100 * len(a & b) >= 80 * len(a | b):
            x, y = top(i), top(j)
            parent[max(x, y)] = min(x, y)
    return {(i, len(s), top(i)) for i, s in found}


def test_jaccard_against_brute_force(spark, odd, none):
    got = jaccard.jaccard_components(odd).collect()
    assert len(got) == len(ODD) and {tuple(r) for r in got if r[0] is not None} == groups(ODD)
    assert [r[2] for r in got if r[0] is None] == [None]
    assert jaccard.jaccard_components(none).count() == 0
    kept = [r.doc_id for r in jaccard.keep_one(odd).collect()]
    assert sorted(kept) == [1, 3, 4, 5, 6, 8, 10]  # the row without an id is a copy of the first


@pytest.mark.parametrize("lot", [7, jaccard.LOT])
def test_jaccard_of_families(spark, monkeypatch, lot):
    """Long lists of near copies whose members are similar to some of the others only."""
    monkeypatch.setattr(jaccard, "LOT", lot)
    draw = np.random.default_rng(0)
    rows, n = [], 0
    for family in range(3):
        base = [f"f{family}x{i}" for i in draw.integers(0, 10_000, 150)]
        for copy in range(40):
            words = list(base)
            for at in draw.integers(0, 150, copy % 9):
                words[at] = f"new{n}at{at}"
            rows.append((n, " ".join(words)))
            n += 1
    rows += [(n + i, " ".join(f"s{j}" for j in range(i % 13 + 1)) + f" e{i // 26}") for i in range(60)]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {tuple(r) for r in jaccard.jaccard_components(table).collect()} == groups(rows)


def test_light_and_heavy_agree(spark):
    """All boundaries find the same pairs."""
    for n in range(1, 9):
        assert jaccard.subset_sizes(n, 80, 20) == sorted({jaccard.needed(n, m, 80) for m in range(-(-80 * n // 100), min(100 * n // 80, 19) + 1)})
    assert jaccard.needed(5, 5, 80) == 5 and jaccard.needed(9, 9, 80) == 8
    crowd = np.ones(jaccard.CROWD_BUCKETS, np.uint32)
    assert 1 <= jaccard.boundary({3: 10, 5: 10}, crowd, 80) <= jaccard.LARGEST_LIGHT


def test_wide_maps():
    """Maps of like sets differ in no more bits than the sets in shingles, also of different widths; those of unlike ones in more."""
    draw = np.random.default_rng(1)
    for n in (30, 1000, 1100, 5000, 20_000):
        base = draw.integers(0, 1 << 63, n, dtype=np.uint64)
        near = np.unique(np.concatenate((base[n // 20 :], draw.integers(0, 1 << 63, n // 10, dtype=np.uint64))))
        base, far = np.unique(base), np.unique(draw.integers(0, 1 << 63, n, dtype=np.uint64))
        assert jaccard._apart(jaccard._wide(base), jaccard._wide(near)) <= len(np.setxor1d(base, near))
        pair = {"a": [1, 1], "b": [2, 3], "n": [len(base)] * 2, "n2": [len(near), len(far)], "left": [jaccard._wide(base)] * 2, "right": [jaccard._wide(near), jaccard._wide(far)]}
        kept = [row for batch in jaccard._near(80)([pa.record_batch(pair)]) for row in batch.to_pylist()]
        assert kept == [{"a": 1, "b": 2}]


def test_components(spark):
    edges = [(5, 4), (4, 3), (3, 9), (10, 11), (7, 7), (11, 10)]
    found = components(spark.createDataFrame(edges, "a long, b long"))
    assert {tuple(r) for r in found.collect()} == {(3, 3), (4, 3), (5, 3), (9, 3), (10, 10), (11, 10)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_hits_in_blocks_are_the_same(spark, odd, none, monkeypatch):
    items = spark.createDataFrame([(1, "w5 w6 w7 w8 w9 w10 w11 w12 w13 w14 w15"), (2, "A b"), (3, ""), (4, None), (None, "où"), (2, "A b")], "item_id long, text string")
    key = lambda r: (str(r.doc_id), r.n_words, [h.word for h in r.hits], r["items"])
    one = sorted(map(key, decontaminate.benchmark_hits(odd, items).collect()), key=str)
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 10)
    assert sorted(map(key, decontaminate.benchmark_hits(odd, items).collect()), key=str) == one
    by = {r[0]: r for r in one}
    assert by["6"][2] == list(range(5, 16)) and by["6"][3] == ["1"] and by["8"][3] == ["2"] and by["10"][2] == [1] and by["10"][3] == []
    assert decontaminate.benchmark_hits(none, items).count() == 0
    assert {r.doc_id for r in decontaminate.without_benchmark(odd, items).collect()} == {None, 1, 2, 3, 4, 5}
    assert decontaminate.without_benchmark(odd, items.limit(0)).count() == len(ODD)


def test_hits_are_mapped_to_the_original(spark):
    text = "Où: Foo -- BAR, baz"
    docs, items = spark.createDataFrame([(1, text)], "doc_id long, text string"), spark.createDataFrame([(1, "foo bar")], "item_id long, text string")
    hits = decontaminate.benchmark_hits(docs, items).first().hits
    assert [text[h.start : h.stop] for h in hits] == ["Foo", "BAR"]


def test_licenses(spark, odd, none):
    text = "x\nReleased under an MIT license\nthe the MIT License!\nThis work is licensed under a Creative Commons Attribution 4.0 International License."
    row = licenses.license_labels(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (row.n_base, row.first_word, row.last_word, row.base_labels, row.labels) == (1, 7, 7, "mit", "cc-by,mit")
    found = licenses.license_labels(odd).collect()
    assert len(found) == len(ODD) and all((r.labels, r.score, r.first_word) == ("", 0.0, None) for r in found)
    assert licenses.license_labels(none).count() == 0


@pytest.mark.parametrize(("notice", "label"), [
    # every kind of notice that stands in the tables
    ("This work is licensed under the GNU General Public License, version 3.", "gpl"), ("All rights reserved.", "all-rights-reserved"),
    ("Released under the MIT License.", "mit"), ("Licensed under the Apache License, Version 2.0.", "apache-2"), ("Licensed under CC BY-NC 4.0.", "cc-by-nc"),
    # and notices that name only the license
    ("Released under the GPL.", "gpl"), ("Distributed under the GNU GPL v2 or later", "gpl"), ("SPDX-License-Identifier: GPL-3.0-or-later", "gpl"),
    ("Licensed under the GNU LGPL", "lgpl"), ("SPDX-License-Identifier: LGPL-2.1", "lgpl"), ("Released under the BSD License.", "bsd"),
    ("BSD 3-Clause License", "bsd"), ("Licensed under the Mozilla Public License, Version 2.0", "mpl-2"), ("Content available under CC BY-SA 4.0", "cc-by-sa"),
])
def test_licenses_of_one_line(notice, label):
    """Each gives its own label and no other."""
    templates = licenses.TEMPLATES + licenses.CLOSE
    index = licenses.Index(templates, licenses.PHRASES, vocabulary := np.unique(np.concatenate(licenses._hashes(t for t, _ in templates + licenses.PHRASES))), np.ones(len(vocabulary), int), 0.8)
    batch = pa.record_batch({"doc_id": pa.array([1]), "text": pa.array([f"some words\n{notice}\nmore"])})
    (found,) = licenses._scan(index)([batch])
    assert (found.column("labels").to_pylist(), found.column("score").to_pylist()) == ([label], [1.0])


WRAPPED = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal",
    "gpl": "# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public\n# License as published by",
    "bsd": "Redistribution and use in source and binary forms, with or without\r\nmodification, are permitted provided that the following conditions\r\nare met:",
    "mpl-2": "This Source Code Form is subject to the terms of the Mozilla\nPublic License, v. 2.0.",
    "lgpl": "the GNU Lesser\nGeneral Public License",
    "": "the lesser of two evils was shown to a general audience and then to the public",
}


def test_licenses_of_wrapped_notices(spark):
    """Notices that run over line ends are found, words strewn over a line are none."""
    docs = spark.createDataFrame([(label, f"int x;\n{text}\nint y;") for label, text in WRAPPED.items()], "doc_id string, text string")
    rows = licenses.license_labels(docs).collect()
    assert {r.doc_id: r.labels for r in rows} == {label: label for label in WRAPPED}
    header = [b for r in rows if r.doc_id == "bsd" for b in r.blocks]
    assert [(b.label, b.first, b.words, b.containment) for b in header] == [("bsd", 2, 21, 1.0)]


def test_licenses_against_all_windows():
    """The filters and the sliding window against every window of every text."""
    draw = np.random.default_rng(5)
    templates = (("a b c d e", "one"), ("c d a a f g h i j k", "two"), ("e f", "three"), ("k", "four"))
    for threshold in (0.5, 0.8, 1.0):
        vocabulary = np.unique(np.concatenate(licenses._hashes(t for t, _ in templates)))
        index = licenses.Index(templates, (), vocabulary, draw.integers(0, 9, len(vocabulary)), threshold)
        texts = [" ".join(draw.choice(list("abcdefghijkxyz\n"), draw.integers(0, 40))) for _ in range(300)]
        (found,) = licenses._scan(index)([pa.record_batch({"doc_id": pa.array(range(300)), "text": pa.array(texts)})])
        for text, labels, score in zip(texts, found.column("labels").to_pylist(), found.column("score").to_pylist()):
            words, best = text.split(), {}
            for template, label in templates:
                own, span = set(template.split()), int(len(template.split()) / threshold + 1e-9)
                share = max((len(own & set(words[i : i + span])) / len(own) for i in range(len(words))), default=0)
                if share >= np.ceil(threshold * len(own) - 1e-9) / len(own):
                    best[label] = share
            assert (labels, score) == (",".join(sorted(best)), max(best.values(), default=0.0)), text


def test_licenses_of_parts_of_a_phrase():
    """A text may end inside a phrase."""
    index = licenses.Index(licenses.TEMPLATES, licenses.PHRASES, vocabulary := np.unique(np.concatenate(licenses._hashes(t for t, _ in licenses.TEMPLATES + licenses.PHRASES))), np.ones(len(vocabulary), int), 0.8)
    for phrase, _ in licenses.PHRASES:
        words = phrase.split()
        for n in range(len(words) + 1):
            batch = pa.record_batch({"doc_id": pa.array([1]), "text": pa.array([" ".join(words[:n])])})
            assert [b.column("n_base").to_pylist() for b in licenses._scan(index)([batch])] == [[int(n == len(words))]]


def test_classifier(spark, none):
    docs = spark.read.parquet(f"{SMALL}/../sf0.01/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/../sf0.01/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    scored = REGISTRY["op5_quality_classifier"].run(spark, f"{SMALL}/../sf0.01")
    rows = scored.join(labels, "doc_id").where(held).collect()
    assert scored.count() == docs.count()
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.9
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)


def test_classifier_on_odd_input(spark, odd, none):
    blank = spark.createDataFrame([], "doc_id long, label int")
    model = classifier.train(odd, blank)
    assert {r.score for r in classifier.quality_scores(odd, model).collect()} == {0.5}
    mixed = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (6, 3), (6, None), (8, 1)], "doc_id long, label int")
    found = classifier.quality_scores(odd, classifier.train(odd, mixed)).collect()
    assert len(found) == len(ODD) and all(0 <= r.score <= 1 for r in found)
    assert classifier.quality_scores(none, model).count() == 0 and classifier.keep_good(odd, model, 0.4).columns == odd.columns


def test_rules(spark, odd, none):
    rows = rules.quality_rules(odd).collect()
    assert len(rows) == len(ODD) and not any(r.kept for r in rows if r.doc_id in (3, 4, 5, 8))
    text = "a b c d e f g h x a b c d e f g h y z"
    row = rules.quality_rules(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (row.n_repeat_words, row.n_words, row.base_failed) == (16, 19, True)
    assert rules.quality_rules(none).count() == 0 and rules.keep_by_rules(odd).columns == odd.columns


def test_mixing(spark, odd, none):
    plan = mixing.mixing_plan(odd.withColumn("_size", F.lit("x"))).collect()
    assert len(plan) == len(ODD) and all(r._target == 1.5 * r._source_size and r._copies <= 2 for r in plan)
    table = spark.createDataFrame([(i, "a " * 10, s) for i in range(3000) for s in ("a", "b", None)], "doc_id long, text string, source string")
    sums = mixing.mixing_plan(table).groupBy("source").agg(F.sum(F.col("_copies") * F.col("_size")).alias("taken"), F.max("_target").alias("target")).collect()
    assert all(abs(r.taken - r.target) < 0.05 * r.target for r in sums) and {r.target for r in sums} == {60_000.0, 50_000.0, 25_000.0}
    assert mixing.mixed(table).count() == sum(r.taken for r in sums) / 10
    assert mixing.mixed(none).count() == 0
    nothing = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert {r._copies for r in mixing.mixing_plan(nothing).collect()} == {0}


def test_chat_round_trip(spark):
    texts = [None, "", "\\### Assistant: </turn> ok", "a\\", "\\#<x:1> é😀", "</turn>\n### user: x </turn>\n", LONG]
    rows = [(1, i, "assistant" if i % 2 else "us:er", t, "x") for i, t in enumerate(texts)] + [(2, 0, None, "same", "x")] * 2 + [(None, 5, "user", "lost", "x")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    turns = chat.format_turns(table).collect()
    assert [chat.parse_turn(r.formatted) for r in turns] == [(r[2] or "", r[3] or "") for r in rows]
    found = {r.conv_id: r for r in chat.conversation_digests(chat.format_turns(table)).collect()}
    whole = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in rows[: len(texts)])
    assert found[1].turns_sha256 == hashlib.sha256(whole.encode()).hexdigest()
    learned = "".join(t or "" for t in texts[1::2])
    assert (found[1].loss_chars, found[1].loss_sha256) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
    assert found[2].n_turns == 2 and found[None].n_turns == 1
    assert chat.conversation_digests(chat.format_turns(table.limit(0))).count() == 0


def test_chat_parts():
    parts = [
        {"kind": "text", "text": "see <image:0> "}, {"kind": "image", "ref": "s3://a", "units": 3.0}, {"kind": "audio", "ref": "b", "units": None},
        {"kind": "document", "ref": None, "units": 1.5}, {"kind": "other", "text": "end"}, None,
    ]
    turn = chat.format_turn("assistant", "ignored", parts)
    assert turn["formatted"] == "### assistant: see \\<image:0> <image:0><audio:1><document:2>end </turn>\n"
    assert [(a["number"], a["kind"], a["ref"], a["tokens"]) for a in turn["attachments"]] == [(0, "image", "s3://a", 510), (1, "audio", "b", 25), (2, "document", None, 900)]
    assert turn["expanded_tokens"] == 1435 and [turn["formatted"][s["start"] : s["stop"]] for s in turn["loss"]] == ["see \\<image:0> ", "end"]
    assert chat.parse_turn(turn["formatted"]) == ("assistant", "see <image:0> end")


def test_warc_round_trip(spark, tmp_path):
    trap = "é</html>\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\n"
    rows = [(1, "http://a/\r\nX: y", trap), (2, "u", "same"), (3, None, "same"), (3, None, "same"), (4, "v", None), (5, "v", ""), (None, "w", "same"), (None, "x", "alone")]
    table = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1))
    warc.write_warc(table, str(tmp_path / "a"), records_per_file=4)
    got = [(r.metadata.page_id, r.capture.type, r.capture.payload, r.capture.payload_bytes, r.capture.refers_to) for r in warc.read_captures(spark, str(tmp_path / "a")).collect()]
    want = [
        (1, "response", trap, len(trap.encode()), None), (2, "revisit", None, 4, 3), (3, "response", "same", 4, None), (3, "response", "same", 4, None),
        (4, "revisit", None, 0, 5), (5, "response", "", 0, None), (None, "revisit", None, 4, 3), (None, "response", "alone", 5, None),
    ]
    assert sorted(got, key=str) == sorted(want, key=str)
    warc.write_warc(table, str(tmp_path / "b"), least_bytes=5)
    assert {r.capture.type for r in warc.read_captures(spark, str(tmp_path / "b")).collect()} == {"response"}
    warc.write_warc(table.limit(0), str(tmp_path / "c"))
    assert warc.read_captures(spark, str(tmp_path / "c")).count() == 0


def test_urls(spark):
    cases = [
        ("HTTP://A.Example.COM/en/x?y#z", "a.example.com", "/en/x", "example.com/en/", "block"), ("https://x.www.example.com/en/", "x.www.example.com", "/en/", "www.example.com/en/", "allow"),
        ("http://com/", "com", "/", "com/", "allow"), ("http://a.com", "a.com", "", None, None), ("http://b.net/es/1", "b.net", "/es/1", "net/es/", "block"),
        ("http://xexample.com/en/", "xexample.com", "/en/", "com/", "allow"), ("http://b.net?/fr/", "b.net", "", None, None), (None, "", "", None, "allow"), ("mailto:x", "", "", None, "allow"),
    ]
    table = spark.createDataFrame([(i, c[0], "h") for i, c in enumerate(cases)], "page_id long, url string, host string")
    for row in urls.judge_urls(table).collect():
        _, host, path, rule, verdict = cases[row.page_id]
        assert (row.host, row.path, row.rule) == (host, path, rule) and row.verdict in ((verdict,) if verdict else ("allow", "block"))
    assert urls.judge_urls(table.limit(0)).count() == 0
    model = urls.fit()
    chance = model.block([urls.parts(u) for u, _ in urls.LABELLED])
    assert all((p >= 0.5) == bool(y) for p, (_, y) in zip(chance, urls.LABELLED))
    assert model.block([urls.parts("http://mega-casino.bet/slots")])[0] > model.block([urls.parts("https://city.library.org/en/books")])[0]


def test_base_scores(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()] + [(10_000, None), (10_001, "unheard of"), (10_001, "unheard of")]
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit("x"))
    got = REGISTRY["op10_lm_scoring"]
    found = lm.lm_scores(table, ~lm.held_out(F.col("doc_id"))).collect()
    assert got.sql is None and len(found) == len(rows)
    words = {i: SPACED.findall((t or "").translate(LOWER)) + [None] for i, t in rows}
    count: dict = {}
    for i, t in rows:
        if zlib.crc32(str(i).encode()) % 7 != 2:
            for w in words[i]:
                count[w] = count.get(w, 0) + 1
    total = sum(count.values())
    for r in found:
        own = words[r.doc_id]
        base = sum(np.log10((count.get(w, 0) + 1) / (total + len(count) + 1)) for w in own)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(w in count for w in own), total)
        assert abs(r.base_score - base) < 1e-6 * max(1, abs(base)) and r.score < 0


def test_model_learns_from_all_rows(spark):
    """A rare word in the longest, last row of many has its place and class; long texts are not skipped."""
    rare = "zyzzyva quixotry"
    rows = [(i, f"the cat sat on a mat {i}") for i in range(2000)] + [(5000 + i, f"the {rare} sat " * 40) for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3, "doc_id")
    model = lm._fit(docs, lm.TOKENIZER, sum(len(t.split()) for _, t in rows))
    ids = sorted(set(lm._tokenizer(lm.TOKENIZER).encode(rare)))
    start = attention.Attention(model.size, model.classes).p["embed"]
    assert (abs(model.p["embed"][ids] - start[ids]).max(axis=1) > 0).all()
    assert (model.classes[ids] < attention.CLASSES - 2).all()
    unseen = np.flatnonzero((model.p["embed"] == start).all(axis=1))
    assert len(unseen) > model.size / 2


def test_attention_gradients_and_windows():
    draw = np.random.default_rng(0)
    model = attention.Attention(12, draw.integers(0, 4, 12).astype(np.int32))
    tokens, bounds = draw.integers(0, 10, 70).astype(np.int32), np.array([0, 0, 16, 37, 70])
    window, target, scored, text = attention.grid(tokens, bounds, 11, 10)
    assert scored.sum() == 70 + 4 and list(target[scored]) == [10, *tokens[:16], 10, *tokens[16:37], 10, *tokens[37:], 10]
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    _, slopes = model.gradients(window, target, scored)
    for name, at in (("embed", (3, 2)), ("query", (1, 1)), ("key", (0, 2)), ("value", (2, 0)), ("near", (4, 9)), ("out", (1, 3)), ("bias", (2,))):
        keep = model.p[name][at]
        around = []
        for step in (1e-4, -1e-4):
            model.p[name][at] = keep + step
            around.append(model.gradients(window, target, scored)[0])
        model.p[name][at] = keep
        assert abs((around[0] - around[1]) / 2e-4 - slopes[name][at]) < 1e-4
    # Within a class the ids' chances add up to one; a text's score doesn't depend on the texts beside it.
    scorer = model.freeze(np.ones(11))
    for group in np.unique(model.classes[:11]):
        assert abs(sum(10 ** scorer.share[:11][model.classes[:11] == group]) - 1) < 1e-9
    together = scorer.scores(tokens, bounds)
    for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])):
        assert abs(scorer.scores(tokens[a:b], np.array([0, b - a]))[0] - together[i]) < 1e-6


def test_ids_of_texts_are_kept(spark, monkeypatch):
    """Texts are looked up once: what is written has each text's ids, also when the memo is emptied."""
    monkeypatch.setattr(lm, "MEMO", 3)
    path, texts = lm.TOKENIZER, ["the cat sat on a mat", "", "The cat  zyzzyva", "mat mat cat", LONG]
    size = lm._tokenizer(path).get_piece_size() + 2
    wanted = [[i for w in SPACED.findall(t.translate(LOWER)) for i in lm._tokenizer(path).encode(w)] for t in texts]
    subwords, got = lm.Subwords(path), []
    for t in texts:
        for _, words in lm.pieces(pa.array([t]), lm.SPACES):
            ids, bounds = subwords.ids(words, words.hashes())
            got.append(ids.tolist())
    assert got == wanted
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    rows = lm._texts(lm._parts(docs), path, size).where("ids is not null").toArrow().to_batches()
    kept = [(b.column("doc_id")[row + i].as_py(), ids[x:y].tolist()) for b, row, ids, at in lm._token_runs(rows, size) for i, (x, y) in enumerate(zip(at[:-1], at[1:]))]
    assert sorted(kept) == list(enumerate(wanted))


def test_steps_of_met_ids_only():
    """A batch moves the embeddings of its own ids; large exponents and tiny sums are shifted."""
    model = attention.Attention(1000, np.zeros(1000, np.int32))
    start = model.p["embed"].copy()
    grid = attention.grid(np.array([3, 4, 3, 5], np.int32), np.array([0, 4]), 999, 998)[:3]
    _, ids, rows, _ = model._slopes(*grid)
    assert list(ids) == [3, 4, 5, 999] and rows.shape == (4, attention.WIDTH)
    model.fit([grid, grid], 0.01)
    assert set(np.flatnonzero((model.p["embed"] != start).any(axis=1))) <= {3, 4, 5, 999}
    x = np.array([[500.0, 499.0], [-500.0, -500.0]], np.float32)
    assert np.allclose(attention._softmax(x.copy()), [[0.7310586, 0.26894143], [0.5, 0.5]])


def test_pipeline(spark):
    import corpus_pipeline

    docs, columns, seen = spark.read.parquet(f"{SMALL}/documents.parquet"), ["doc_id", "text", "lang", "source", "n_chars"], {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SMALL).cache()
        assert name == "mixing" or out.columns == columns
        seen[name] = (docs, out)
        docs = out
    before, after = seen["near_duplicates"]
    texts = [(r.doc_id, r.text) for r in before.select("doc_id", "text").collect()]
    assert {r.doc_id for r in after.collect()} == {i for i, _, c in groups(texts) if i == c}
    before, after = seen["decontamination"]
    items = [PLAIN.findall(r.text.translate(LOWER)) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    windows = {tuple(w[i : i + 10]) for w in items for i in range(max(1, len(w) - 9))}
    sizes = {len(w) for w in windows}

    def dirty(text):
        words = PLAIN.findall(text.translate(LOWER))
        return any(tuple(words[i : i + n]) in windows for n in sizes for i in range(len(words) - n + 1))

    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect() if not dirty(r.text)}
    assert corpus_pipeline.run(spark, SMALL).count() == seen["mixing"][1].count() > 0
