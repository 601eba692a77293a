"""Benchmark decontamination: one Aho-Corasick automaton over normalised test items.

Text is normalised to its words with one space around each; so are the windows
of the items, which makes every hit start and end at a word. A document is
scanned once. Hits are mapped back to word numbers and to places in the original.
"""

from __future__ import annotations

import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import LOWER, MARKS

#: Bytes of item texts that one automaton is built from (some 450 bytes of memory for each); larger tables are met in several passes.
BLOCK_BYTES = 1 << 20

_NORMAL = bytes(32 if MARKS[b] else LOWER[b] for b in range(256))
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_BUILT: dict[str, tuple] = {}


def _words(text: str) -> list[bytes]:
    return text.encode().translate(_NORMAL).split()


def _spell(words: list[bytes]) -> str:
    """One character a byte, so that places in it are places in bytes."""
    return (b" " + b" ".join(words) + b" ").decode("latin-1")


def build(items: list[tuple[str | None, str | None]], size: int):
    """The automaton over all windows of the items; None if they have no words."""
    import ahocorasick

    owners: dict[str, set[int]] = {}
    lengths: dict[str, int] = {}
    for number, (_, text) in enumerate(items):
        words = _words(text or "")
        for i in range(max(1, len(words) - size + 1) if words else 0):
            window = words[i : i + size]
            key = _spell(window)
            owners.setdefault(key, set()).add(number)
            lengths[key] = len(window)
    machine = ahocorasick.Automaton()
    for key, numbers in owners.items():
        machine.add_word(key, (len(key), lengths[key], tuple(numbers)))
    if not owners:
        return None
    machine.make_automaton()
    return machine


def _machine(shared, size: int):
    """Built once a worker for each table of items."""
    name, items = shared.value
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = (build(items, size), [item_id for item_id, _ in items])
    return _BUILT[name]


def find(machine, text: str) -> tuple[int, np.ndarray, set[int]]:
    """(number of words, numbers of the words hit, numbers of the items found) of a text."""
    words = _words(text)
    if not words or machine is None:
        return len(words), np.zeros(0, np.int64), set()
    spelled, spaces, found, runs = _spell(words), None, set(), []
    for end, (length, count, numbers) in machine.iter(spelled):
        if spaces is None:
            spaces = np.flatnonzero(np.frombuffer(spelled.encode("latin-1"), np.uint8) == 32)
        start = int(np.searchsorted(spaces, end - length + 1))
        runs.append((start, start + count))
        found.update(numbers)
    hit = np.zeros(len(words), bool)
    for start, stop in set(runs):
        hit[start:stop] = True
    return len(words), np.flatnonzero(hit), found


def _places(text: str, hit: np.ndarray) -> list[dict]:
    """Each hit word with its first and last+1 code point in the original text."""
    raw = text.encode()
    spans = [m.span() for m in _WORD.finditer(raw.translate(bytes(LOWER)))]
    before = np.concatenate(([0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)))  # code points before each byte
    return [{"word": int(w), "start": int(before[spans[w][0]]), "stop": int(before[spans[w][1]])} for w in hit]


_HIT = pa.list_(pa.struct([("word", pa.int64()), ("start", pa.int64()), ("stop", pa.int64())]))


def _scan(shared, size: int):
    def run(batches):
        machine, names = _machine(shared, size)
        for batch in batches:
            counts, hits, items = [], [], []
            for value in batch.column("text"):
                text = value.as_py() or ""
                n, hit, found = find(machine, text)
                counts.append(n)
                hits.append(_places(text, hit) if len(hit) else [])
                items.append(sorted({names[i] for i in found if names[i] is not None}))
            yield pa.record_batch({
                "doc_id": batch.column("doc_id"), "text_key": batch.column("text_key"), "n_words": pa.array(counts, pa.int64()),
                "hits": pa.array(hits, _HIT), "items": pa.array(items, pa.list_(pa.string())),
            })

    return run


def _drop(shared, size: int):
    def run(batches):
        machine, _ = _machine(shared, size)
        for batch in batches:
            clean = [not len(find(machine, value.as_py() or "")[1]) for value in batch.column("text")]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return run


def _blocks(benchmark: DataFrame) -> list:
    """The items in blocks of about BLOCK_BYTES, each small enough to send to all tasks."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = -(-total // BLOCK_BYTES) or 1
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(count))
    context = benchmark.sparkSession.sparkContext
    return [context.broadcast((uuid.uuid4().hex, [tuple(r) for r in items.where(block == i).collect()])) for i in range(count)]


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """Words of ``docs`` (``doc_id``, ``text``) that lie in a window of an item of ``benchmark`` (``item_id``, ``text``).

    Words are runs of letters, digits and non-ASCII characters, A-Z lower-cased.
    A window is ``size`` consecutive words of an item; an item of fewer words, but
    not none, is one window. Returns for each row ``doc_id``, ``n_words``, ``hits``
    (each hit word: its number, and where it stands in the original text) and
    ``items`` (ids of the items found, as strings, sorted).

    NULL and empty texts have no words and no hits. An item without words is never
    found; one without an id gives hits but no id. Repeated rows and items are
    each judged. Without items nothing is hit. Other columns are ignored.
    """
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text_key string, n_words long, hits array<struct<word:long,start:long,stop:long>>, items array<string>"
    blocks = _blocks(benchmark)
    if len(blocks) == 1:
        return docs.withColumn("text_key", F.lit(None).cast("string")).mapInArrow(_scan(blocks[0], size), kind).drop("text_key")
    keyed = docs.withColumn("text_key", F.sha2("text", 256))
    every = None
    for block in blocks:
        part = keyed.mapInArrow(_scan(block, size), kind)
        every = part if every is None else every.unionAll(part)
    merged = every.groupBy("doc_id", "text_key").agg(
        F.first("n_words").alias("n_words"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("hits")))).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
        F.expr(f"count(*) div {len(blocks)}").alias("times"),
    )
    return merged.withColumn("times", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).drop("times", "text_key")


def without_benchmark(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """Only the rows of ``docs`` without a hit, all their columns as they are."""
    for block in _blocks(benchmark):
        docs = docs.mapInArrow(_drop(block, size), docs.schema)
    return docs
