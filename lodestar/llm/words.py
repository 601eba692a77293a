"""Words, shingles and their hashes over Arrow text columns, on whole byte buffers.

Words are runs of bytes outside a set of breaks. All breaks are ASCII, so a
UTF-8 character is never cut. Everything here runs inside Spark tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at a time: some 60 bytes of memory for each.
BATCH_BYTES = 1 << 18

#: Breaks between words: white space only, or all ASCII that is no letter or digit.
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
MARKS = np.zeros(256, bool)
MARKS[:128] = [not chr(b).isalnum() for b in range(128)]
#: Bytes as they are, and with A-Z in lower case.
PLAIN = np.arange(256, dtype=np.uint8)
LOWER = PLAIN.copy()
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64 bits evenly (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def salts(n: int, seed: int) -> np.ndarray:
    """``n`` odd 64-bit constants."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


_BYTE = salts(256, 11)
_BASE = int(salts(1, 12)[0])
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """The first ``n`` powers; no more of them than a batch needs are kept by the worker."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, BATCH_BYTES + 1), base, np.uint64)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        _POWERS[base] = have[: BATCH_BYTES + 1].copy()
    return have[:n]


class Words:
    """The words of a piece of a text column.

    ``data`` bytes, ``starts`` and ``ends`` of each word in it, ``first`` the
    number of the first word of each text (one more entry than texts).
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray):
        self.data, self.offsets = data, offsets
        inside = ~breaks[data]
        cuts = offsets[:-1]
        before = np.empty_like(inside)
        after = np.empty_like(inside)
        before[:1] = False
        before[1:] = inside[:-1]
        before[cuts[cuts < len(data)]] = False
        after[-1:] = False
        after[:-1] = inside[1:]
        after[cuts[cuts > 0] - 1] = False
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.starts, offsets)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owner(self) -> np.ndarray:
        """The text each word is in."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        """One 64-bit hash a word; equal words have equal hashes."""
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        n = len(self.data)
        sums = np.empty(n + 1, np.uint64)
        sums[0] = 0
        np.multiply(_BYTE[self.data], _powers(_BASE, n), out=sums[1:])
        np.cumsum(sums[1:], out=sums[1:])
        found = (sums[self.ends] - sums[self.starts]) * _powers(_INVERSE, n)[self.starts]
        return mix(found ^ (self.ends - self.starts).astype(np.uint64))

    def text(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()


def pieces(column: pa.Array, breaks: np.ndarray, fold: np.ndarray = LOWER, limit: int = BATCH_BYTES) -> Iterator[tuple[int, Words]]:
    """(number of the first row, its words) for runs of rows of about ``limit`` bytes; NULL has no words."""
    column = column.cast(pa.large_string()).fill_null("")
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, Words(fold[data[offsets[row] : offsets[stop]]], offsets[row : stop + 1] - offsets[row], breaks)
        row = stop


def shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words in reading order, and their bounds by text.

    A text with fewer words, but not none, is one run.
    """
    hashed, counts = words.hashes(), words.counts
    runs = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    bounds = np.concatenate(([0], np.cumsum(runs)))
    factor, ending = salts(size, 21), salts(size + 1, 22)
    start = np.arange(bounds[-1]) + np.repeat(words.first[:-1] - bounds[:-1], runs)
    length = np.repeat(np.minimum(counts, size), runs)
    out = ending[length]
    for j in range(size):
        have = length > j
        if have.all():
            out += hashed[start + j] * factor[j]
        else:
            out[have] += hashed[start[have] + j] * factor[j]
    return mix(out), bounds


def sorted_sets(words: Words, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of each text."""
    found, bounds = shingles(words, size)
    for i in range(len(bounds) - 1):
        yield np.unique(found[bounds[i] : bounds[i + 1]])


def grams(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, sizes: tuple[int, ...], buckets: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed byte n-grams of the pieces ``data[starts:ends]``: (bucket, number of the piece).

    Each piece is taken with a mark at either end, and once as a whole.
    """
    length = (ends - starts).astype(np.int64)
    bounds = np.concatenate(([0], np.cumsum(length + 2)))
    text = np.empty(bounds[-1], np.int64)
    inner = np.ones(bounds[-1], bool)
    inner[bounds[:-1]] = False
    inner[bounds[1:] - 1] = False
    text[bounds[:-1]], text[bounds[1:] - 1] = 256, 257
    text[inner] = data[np.repeat(starts - (np.cumsum(length) - length), length) + np.arange(length.sum())]
    owner = np.repeat(np.arange(len(starts)), length + 2)
    coded = mix(text.astype(np.uint64) + np.uint64(seed))
    whole = np.add.reduceat(coded * _powers(_BASE, len(coded)), bounds[:-1]) * _powers(_INVERSE, len(coded))[bounds[:-1]] if len(starts) else np.zeros(0, np.uint64)
    found, of = [mix(whole + np.uint64(seed))], [np.arange(len(starts))]
    for size in sizes:
        if len(text) < size:
            continue
        factor = salts(size, 41 + size)
        rolled = np.zeros(len(text) - size + 1, np.uint64)
        for j in range(size):
            rolled += coded[j : len(text) - size + 1 + j] * factor[j]
        ok = owner[: len(rolled)] == owner[size - 1 :]
        found.append(mix(rolled[ok]))
        of.append(owner[: len(rolled)][ok])
    return (np.concatenate(found) % np.uint64(buckets)).astype(np.int64), np.concatenate(of)


def spelled(words: Words, which: np.ndarray) -> pa.Array:
    """The chosen words as a string column."""
    length = (words.ends - words.starts)[which]
    ends = np.cumsum(length)
    places = np.repeat(words.starts[which] - (ends - length), length) + np.arange(length.sum())
    offsets = np.concatenate(([0], ends)).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(which), pa.py_buffer(offsets), pa.py_buffer(words.data[places]))
