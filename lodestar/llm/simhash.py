"""SimHash near-duplicates: a tiled exact comparison of fingerprints.

Two fingerprints that differ in at most r bits have population counts that
differ by at most r; the same holds for the counts of equal parts of them, taken
together. Distinct fingerprints are put into tiles by the population counts of
their parts. Two tiles are compared, by exclusive-or and bit counts, unless the
sum of the differences of their counts is beyond r. More parts make more and
smaller tiles; their number follows from the number of fingerprints and changes
the work only.

Of a pair of tiles no pairs of fingerprints leave the task, but stars that join
the same fingerprints, at most one edge for each of them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import durable
from .components import components, stars
from .words import LOWER

BITS = 64
#: Bytes of text whose shingles are held at a time, so that a very long text needs little more memory.
LOT_BYTES = 1 << 18
#: Fingerprints of a tile at most, and about as many as a tile of the most common counts should have.
TILE = 1024
FULL = 512
#: Rows of a tile that are compared with all of another at a time.
STRIPE = 256

_BREAK = re.compile(rb"[\x20\x09-\x0D]")
_LOWER = LOWER.tobytes()


def shingle_lots(text: bytes, size: int) -> Iterator[list[bytes]]:
    """The runs of ``size`` words with one space between them, in lots; a text with fewer words, but not none, is one run."""
    words, at, any_run = [], 0, False
    while at < len(text):
        cut = _BREAK.search(text, at + LOT_BYTES)
        end = cut.start() if cut else len(text)
        words += text[at:end].split()
        at = end
        if len(words) >= size:
            any_run = True
            yield [b" ".join(run) for run in zip(*(words[i:] for i in range(size)))]
            words = words[len(words) - size + 1 :]
    if words and not any_run:
        yield [b" ".join(words)]


def fingerprint(text: bytes, size: int = 3, seed: int = 42) -> int:
    """Bits that are set in over half of the shingles' XXH64; 0 if there are none."""
    counts, n = np.zeros(BITS, np.int64), 0
    for lot in shingle_lots(text.translate(_LOWER), size):
        hashed = np.array([xxhash.xxh64_intdigest(s, seed) for s in lot], ">u8")
        counts += np.unpackbits(hashed.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        n += len(lot)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def _fingerprints(size: int, seed: int):
    def run(batches):
        for batch in batches:
            found = [fingerprint(text.as_py() or b"", size, seed) for text in batch.column("text").cast(pa.large_binary())]
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "fp": pa.array(np.array(found, np.uint64).view(np.int64))})

    return run


def part_bounds(parts: int) -> list[int]:
    return [BITS * i // parts for i in range(parts + 1)]


def expected_tile(n: int, parts: int) -> float:
    """Fingerprints in the tile of the most common counts, were all bits drawn evenly."""
    share = 1.0
    for low, high in zip(part_bounds(parts), part_bounds(parts)[1:]):
        share *= (2 / (np.pi * (high - low))) ** 0.5
    return n * share


def parts_for(n: int) -> int:
    """The least number of parts (1 to 8) that leaves about ``FULL`` fingerprints in a common tile."""
    return next((p for p in range(1, 8) if expected_tile(n, p) <= FULL), 8)


def _counts_of(parts: int):
    """The population counts of the parts, 7 bits each, as one number."""
    bounds = part_bounds(parts)
    code = F.lit(0).cast("bigint")
    for low, high in zip(bounds, bounds[1:]):
        part = F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << (high - low)) - 1 if high - low < 64 else -1).cast("bigint"))
        code = F.shiftleft(code, 7) + F.bit_count(part)
    return code


def neighbours(parts: int, radius: int) -> list[int]:
    """What to add to a tile's number to get those of all tiles not before it within ``radius``."""
    steps = []
    for move in product(range(-radius, radius + 1), repeat=parts):
        if sum(map(abs, move)) <= radius and move >= (0,) * parts:
            code = 0
            for step in move:
                code = (code << 7) + step
            steps.append(code)
    return steps


def _stars(found_a: np.ndarray, found_b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join the fingerprints of two tiles as the pairs within ``radius`` bits do."""
    left, right = [], []
    for low in range(0, len(found_a), STRIPE):
        i, j = np.nonzero(np.bitwise_count(found_a[low : low + STRIPE, None] ^ found_b[None, :]) <= radius)
        left.append(found_a[low + i])
        right.append(found_b[j])
    a, b = np.concatenate(left), np.concatenate(right)
    differ = a != b
    a, b = a[differ], b[differ]
    return (a, b) if len(a) < 2 else stars(a, b)


def _compared(radius: int):
    def run(batches):
        for batch in batches:
            edges = [_stars(np.asarray(x.values).view(np.uint64), np.asarray(y.values).view(np.uint64), radius) for x, y in zip(batch.column("tile"), batch.column("other"))]
            a, b = (np.concatenate([e[i] for e in edges] or [np.zeros(0, np.uint64)]).view(np.int64) for i in (0, 1))
            yield pa.record_batch({"a": pa.array(a), "b": pa.array(b)})

    return run


def linked(prints: DataFrame, radius: int = 2) -> DataFrame:
    """Edges (``a``, ``b``) over distinct fingerprints (``fp``) that join what links of at most ``radius`` bits join."""
    parts = parts_for(prints.count())
    coded = durable(prints.select("fp", _counts_of(parts).alias("counts")))
    # A tile holds TILE at most: one with more is dealt into several by the counted number.
    full = coded.groupBy("counts").agg(F.ceil(F.count("*") / TILE).alias("lots")).where("lots > 1")
    dealt = coded.join(full, "counts", "left").withColumn("lot", F.when(F.col("lots") > 1, F.pmod(F.xxhash64("fp"), "lots")).otherwise(0))
    tiles = durable(dealt.groupBy("counts", "lot").agg(F.array_sort(F.collect_list("fp")).alias("tile")))
    steps = F.array(*(F.lit(s).cast("bigint") for s in neighbours(parts, radius)))
    near = tiles.select(F.explode(steps).alias("step"), "counts", "lot", "tile").select((F.col("counts") + F.col("step")).alias("to"), "step", "lot", "tile")
    other = tiles.select(F.col("counts").alias("to"), F.col("lot").alias("lot2"), F.col("tile").alias("other"))
    met = near.join(other, "to").where("step <> 0 or lot <= lot2").select("tile", "other")
    return met.mapInArrow(_compared(radius), "a long, b long")


def simhash_components(docs: DataFrame, size: int = 3, radius: int = 2, seed: int = 42) -> DataFrame:
    """Group documents (``doc_id``, ``text``) whose fingerprints differ in at most ``radius`` bits, directly or through others.

    Words are runs outside ASCII white space, A-Z lower-cased. A bit of the
    64-bit fingerprint is 1 if it is set in over half of the XXH64 (UTF-8,
    ``seed``) of the runs of ``size`` words, repeats included, joined by single
    spaces; a text with fewer words is one run. Returns ``doc_id``,
    ``fingerprint`` (16 lowercase hex digits) and ``component_id`` (the smallest
    doc_id reachable, its own included), one row per row given.

    A text that is NULL, empty or without words has fingerprint zero and is
    linked like any other. Equal fingerprints are one class, however many rows
    have them. A row without doc_id has a fingerprint, no component, and links
    nothing. doc_ids must be integers. Other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = durable(docs.mapInArrow(_fingerprints(size, seed), "doc_id long, fp long"))
    heads = durable(rows.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("head")))
    found = durable(components(linked(heads.select("fp"), radius)))
    own = heads.join(found.select(F.col("v").alias("fp"), "component"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = own.groupBy("component").agg(F.min("head").alias("component_id"))
    named = own.join(least, "component").select(F.col("fp").alias("_fp"), "component_id")
    out = rows.join(named, rows["fp"] == named["_fp"], "left")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
