"""License scans: an exact containment join of text blocks with license templates.

A block is a window of words, wherever lines end. Of a template with n distinct words
a block must hold ``need = ceil(threshold * n)``, and it has at most
length / threshold words (length: those of the template, repeated ones included), so
that wrapped notices are found and words strewn over a text are not. Template words
are ordered by how often they stand in the whole corpus, rarest first. A block that
meets the threshold holds one of the first n - need + 1 words of the template (prefix
filter; their positions leave n - p >= need words to share, which is the position
filter), so only the words within a window's length of such a word are looked at, and
of these only runs with need different template words (length filter).
Phrases that stand word by word in the text are found beside that.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import MARKS, Words, pieces

# Phrases that always give their label.
PHRASES = (
    ("the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)
# Customary headers and one-line notices of widely used licenses, and
# where they differ in one word from another's, only what tells them apart (short
# enough that every word is needed: "Released under the MIT License" would be met by
# "Released under the BSD License").
TEMPLATES = (
    ("MIT License", "mit"),
    ("Released under the MIT", "mit"),
    ("Licensed under the MIT", "mit"),
    ("License Identifier MIT", "mit"),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("Apache License, Version 2", "apache-2"),
    ("Apache License 2.0", "apache-2"),
    ("Apache Version 2.0", "apache-2"),
    ("License Identifier Apache", "apache-2"),
    ("BSD License", "bsd"),
    ("BSD style license", "bsd"),
    ("BSD 2 Clause", "bsd"),
    ("BSD 3 Clause", "bsd"),
    ("License Identifier BSD", "bsd"),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "bsd"),
    ("GNU General Public", "gpl"),
    ("GNU GPL", "gpl"),
    ("under the GPL", "gpl"),
    ("under the GPLv2", "gpl"),
    ("under the GPLv3", "gpl"),
    ("License Identifier GPL", "gpl"),
    ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License", "gpl"),
    ("Lesser General Public", "lgpl"),
    ("Library General Public", "lgpl"),
    ("GNU LGPL", "lgpl"),
    ("under the LGPL", "lgpl"),
    ("License Identifier LGPL", "lgpl"),
    ("Affero General Public", "agpl"),
    ("GNU AGPL", "agpl"),
    ("under the AGPL", "agpl"),
    ("License Identifier AGPL", "agpl"),
    ("This Source Code Form is subject to the terms of the Mozilla Public License", "mpl-2"),
    ("Mozilla Public License", "mpl-2"),
    ("License Identifier MPL", "mpl-2"),
    ("This work is licensed under a Creative Commons Attribution 4.0 International License", "cc-by"),
    ("Creative Commons ShareAlike", "cc-by-sa"),
    ("NonCommercial ShareAlike", "cc-by-sa"),
    ("Non Commercial Share Alike", "cc-by-sa"),
    ("CC BY NC SA", "cc-by-sa"),
    ("Commons Attribution ShareAlike", "cc-by-sa"),
    ("Commons Attribution Share Alike", "cc-by-sa"),
    ("CC BY SA", "cc-by-sa"),
    ("Creative Commons NonCommercial", "cc-by-nc"),
    ("Commons Attribution NonCommercial", "cc-by-nc"),
    ("Commons Attribution Non Commercial", "cc-by-nc"),
    ("CC BY NC", "cc-by-nc"),
    ("This is free and unencumbered software released into the public domain", "unlicense"),
    ("All rights reserved", "all-rights-reserved"),
)
# Told apart from others (CC BY 4.0 from CC BY-NC 4.0) only where the words
# stand together. The SQL, which takes whole lines, does not have them.
CLOSE = (
    ("Commons Attribution 4", "cc-by"),
    ("Commons Attribution 3", "cc-by"),
    ("Commons Attribution License", "cc-by"),
    ("Commons Attribution International", "cc-by"),
    ("CC BY 4", "cc-by"),
    ("CC BY 3", "cc-by"),
)


def _hashes(texts) -> list[np.ndarray]:
    out = []
    for _, words in pieces(pa.array(list(texts), pa.string()), MARKS):
        hashed = words.hashes()
        out += [hashed[a:b] for a, b in zip(words.first[:-1], words.first[1:])]
    return out


def _lookup(vocabulary: np.ndarray, hashed: np.ndarray) -> np.ndarray:
    """The place of each word in the sorted vocabulary, or -1."""
    at = np.searchsorted(vocabulary, hashed)
    at[at == len(vocabulary)] = 0
    return np.where(vocabulary[at] == hashed, at, -1)


def _count(vocabulary: np.ndarray):
    def run(batches):
        total = np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            for _, words in pieces(batch.column("text"), MARKS):
                at = _lookup(vocabulary, words.hashes())
                total += np.bincount(at[at >= 0], minlength=len(vocabulary))
        yield pa.record_batch({"word": pa.array(np.arange(len(vocabulary))), "times": pa.array(total)})

    return run


class Index:
    """Templates ordered by corpus frequency, and the lists of their prefixes."""

    def __init__(self, templates, phrases, vocabulary: np.ndarray, times: np.ndarray, threshold: float):
        self.vocabulary = vocabulary
        self.labels = [label for _, label in templates]
        self.phrases = [(_lookup(vocabulary, h), label) for h, (_, label) in zip(_hashes(p for p, _ in phrases), phrases)]
        rank = np.empty(len(vocabulary), np.int64)
        rank[np.lexsort((vocabulary, times))] = np.arange(len(vocabulary))
        self.member, self.need, self.longest, self.size, self.lists = [], [], [], [], {}
        for number, hashed in enumerate(_hashes(t for t, _ in templates)):
            ordered = sorted(set(_lookup(vocabulary, hashed).tolist()), key=lambda w: rank[w])
            need = max(1, int(np.ceil(threshold * len(ordered) - 1e-9)))
            self.member.append(np.zeros(len(vocabulary) + 1, bool))
            self.member[-1][ordered] = True
            self.need.append(need)
            self.longest.append(int(len(hashed) / threshold + 1e-9))
            self.size.append(len(ordered))
            for word in ordered[: len(ordered) - need + 1]:
                self.lists.setdefault(word, []).append(number)
        self.rare = np.zeros(len(vocabulary) + 1, bool)  # the last entry stands for other words
        self.rare[list(self.lists)] = True

    def spans(self, at: np.ndarray, first: np.ndarray, owner: np.ndarray):
        """(template, text, from, to): the words in which a window that meets the template can lie."""
        open_: dict[int, tuple[int, int, int]] = {}
        for place in np.flatnonzero(self.rare[at]).tolist():
            text = int(owner[place])
            for number in self.lists[int(at[place])]:
                low, high = max(int(first[text]), place - self.longest[number] + 1), min(int(first[text + 1]), place + self.longest[number])
                had = open_.get(number)
                if had and had[0] == text and low <= had[2]:
                    low = had[1]
                elif had:
                    yield number, *had
                open_[number] = text, low, high
        for number, had in open_.items():
            yield number, *had

    def matches(self, number: int, at: np.ndarray, low: int, high: int) -> list[tuple[int, int, float]]:
        """(first word, last word, containment) where windows of ``at[low:high]`` meet a template; of windows that overlap, the best."""
        places = np.flatnonzero(self.member[number][at[low:high]]) + low
        words, places = at[places].tolist(), places.tolist()
        need, longest = self.need[number], self.longest[number]
        if len(set(words)) < need:
            return []
        held: dict[int, int] = {}
        out: list[tuple[int, int, int]] = []
        left, reach = 0, -1  # the window's first template word, and the last word of the last window that met
        for place, word in zip(places, words):
            held[word] = held.get(word, 0) + 1
            while places[left] <= place - longest or held[words[left]] > 1:
                held[words[left]] -= 1
                if not held[words[left]]:
                    del held[words[left]]
                left += 1
            if len(held) >= need:
                if places[left] > reach:
                    out.append((places[left], place, len(held)))
                elif len(held) > out[-1][2]:
                    out[-1] = (places[left], place, len(held))
                reach = place
        return [(a, b, shared / self.size[number]) for a, b, shared in out]


def _scan(index: Index):
    def judge(words: Words):
        hashed, owner, texts = words.hashes(), words.owner(), len(words.first) - 1
        at = _lookup(index.vocabulary, hashed)
        n_base, low, high = np.zeros(texts, np.int64), np.full(texts, -1), np.full(texts, -1)
        base: list[set[str]] = [set() for _ in range(texts)]
        for phrase, label in index.phrases:
            last = len(phrase) - 1
            start = np.flatnonzero(at[: max(0, len(at) - last)] == phrase[0])
            for k in range(1, last + 1):
                start = start[at[start + k] == phrase[k]]
            start = start[owner[start] == owner[start + last]]
            for i in start:
                text = owner[i]
                word = i - words.first[text]
                n_base[text] += 1
                low[text] = word if low[text] < 0 else min(low[text], word)
                high[text] = max(high[text], word)
                base[text].add(label)
        found: list[set[str]] = [set(b) for b in base]
        score = [1.0 if b else 0.0 for b in base]
        blocks: list[list[dict]] = [[] for _ in range(texts)]
        for number, text, a, b in index.spans(at, words.first, owner):
            for first, last, share in index.matches(number, at, a, b):
                found[text].add(index.labels[number])
                score[text] = max(score[text], share)
                blocks[text].append({"label": index.labels[number], "first": first - int(words.first[text]), "words": last - first + 1, "containment": share})
        for text in range(texts):
            yield n_base[text], low[text] if n_base[text] else None, high[text] if n_base[text] else None, ",".join(sorted(base[text])), ",".join(sorted(found[text])), score[text], blocks[text]

    def run(batches):
        for batch in batches:
            counts, out = [], []
            for _, words in pieces(batch.column("text"), MARKS):
                counts.append(words.counts)
                out += judge(words)
            columns = list(zip(*out)) or [[]] * 7
            yield pa.record_batch({
                "doc_id": batch.column("doc_id"), "n_words": pa.array(np.concatenate(counts) if counts else [], pa.int64()),
                "n_base": pa.array(columns[0], pa.int64()), "first_word": pa.array(columns[1], pa.int64()), "last_word": pa.array(columns[2], pa.int64()),
                "base_labels": pa.array(columns[3], pa.string()), "labels": pa.array(columns[4], pa.string()), "score": pa.array(columns[5], pa.float64()),
                "blocks": pa.array(columns[6], pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("words", pa.int64()), ("containment", pa.float64())]))),
            })

    return run


def license_labels(docs: DataFrame, threshold: float = 0.8, templates=TEMPLATES + CLOSE, phrases=PHRASES) -> DataFrame:
    """License labels of ``docs`` (``doc_id``, ``text``).

    Words are runs of letters, digits and non-ASCII characters, A-Z lower-cased.
    Returns for each row ``doc_id``, ``n_words``; of the phrases ``n_base`` (places
    where one stands, of all phrases), ``first_word`` and ``last_word`` (their
    least and largest first word, NULL without any), ``base_labels``; ``labels``
    (those, and those of all templates of which a window of at most the template's
    length / ``threshold`` words holds at least ``threshold`` of the distinct words);
    ``score`` (1 with a phrase, else the largest share met, else 0); ``blocks`` (where
    windows meet a template; those that overlap are one, and the best of them is given).

    NULL and empty texts have no words and no labels ('' and score 0). Repeated
    rows are each judged; other columns are ignored. ``templates`` and ``phrases``
    are short lists of (text, label) that every task holds.
    """
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    vocabulary = np.unique(np.concatenate(_hashes([t for t, _ in (*templates, *phrases)])))
    counted = docs.select("text").mapInArrow(_count(vocabulary), "word long, times long").groupBy("word").agg(F.sum("times").alias("times"))
    times = np.zeros(len(vocabulary), np.int64)
    for row in counted.collect():  # a row for each template word
        times[row["word"]] = row["times"]
    index = Index(templates, phrases, vocabulary, times, threshold)
    kind = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, blocks array<struct<label:string,first:long,words:long,containment:double>>"
    return docs.mapInArrow(_scan(index), kind)
