"""Spelling variants: K-d trees over letter-count vectors.

An edit of one character changes the letter counts of a word by an L1 distance of
at most two: two if a letter is replaced, one if it is put in or taken out. For
each length of words a K-d tree over count vectors is searched with the words of
the same length (within two) and those one longer (within one); branches whose
box is farther away are left out, and what remains is checked letter by letter.

The upper part of each tree, whose planes come from a bounded sample of words,
deals the words into cells of bounded size; a word is sent to each cell whose box
is within reach. The lower part is built in the task that has the cell. Planes
and sample change the work only, never what is found.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import durable
from .words import LOWER

#: Counts are taken for a-z, and for all other letters by their number modulo the rest of the places. Sharing a place can only lessen a distance.
PLACES = 32
OTHERS = PLACES - 26
#: Words from which the planes between cells are chosen, about, and words of a cell.
SAMPLE = 1 << 17
CELL = 1 << 14
#: Words of a leaf, queries that go down a tree together, and candidates that are checked at a time.
LEAF = 32
QUERIES = 4096
CHECKED = 1 << 17
#: Different words that a task counts before it hands them on.
COUNTED = 1 << 18

_RUN = re.compile("[a-z\u00C0-\u00FF]+")
_LOWER = LOWER.tobytes()
STORED, SAME, LONGER = 0, 1, 2


def _letters(words: list[str]) -> np.ndarray:
    """The characters of words of one length, a row each."""
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1)


def count_vectors(words: list[str]) -> np.ndarray:
    """The letter counts of words of one length; counts above 127 are taken as 127, which can only lessen a distance."""
    letters = _letters(words)
    plain = (letters >= 97) & (letters <= 122)
    place = np.where(plain, letters - np.uint32(97), 26 + letters % OTHERS).astype(np.int64)
    out = np.empty((len(words), PLACES), np.int8)
    for low in range(0, len(words), 1 << 14):
        part = place[low : low + (1 << 14)]
        at = part + PLACES * np.arange(len(part))[:, None]
        out[low : low + len(part)] = np.minimum(np.bincount(at.ravel(), minlength=PLACES * len(part)).reshape(-1, PLACES), 127)
    return out


def _split(vectors: np.ndarray) -> tuple[int, int] | None:
    """(place, greatest count on the left) of the plane that parts the vectors most evenly; None if they are all equal."""
    best, plane = 0, None
    low, high = vectors.min(axis=0), vectors.max(axis=0)
    for place in np.flatnonzero(high > low):
        below = np.cumsum(np.bincount(vectors[:, place] - low[place]))[:-1]
        even = np.minimum(below, len(vectors) - below)
        if even.max() > best:
            best, plane = even.max(), (int(place), int(low[place] + even.argmax()))
    return plane


def upper_tree(vectors: np.ndarray, every: int, first: int) -> tuple[list, int]:
    """Planes of one length's cells, from a sample of one in ``every`` words: nested [place, count, left, right] or a cell's number."""
    plane = _split(vectors) if len(vectors) * every > CELL else None
    if plane is None:
        return first, first + 1
    left = vectors[:, plane[0]] <= plane[1]
    below, first = upper_tree(vectors[left], every, first)
    above, first = upper_tree(vectors[~left], every, first)
    return [*plane, below, above], first


def cells_in_reach(tree, vectors: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(number of the vector, cell) for each cell whose region is within ``radius`` of the vector."""
    found = []

    def down(node, at, bounds):
        if not len(at):
            return
        if not isinstance(node, list):
            found.append((at, np.full(len(at), node)))
            return
        place, count, left, right = node
        was = bounds.get(place, (-1, 128))
        for child, now in ((left, (was[0], count)), (right, (count + 1, was[1]))):
            box = bounds | {place: now}
            far = np.zeros(len(at), np.int64)
            for p, (a, b) in box.items():
                v = vectors[at, p].astype(np.int64)
                far += np.maximum(np.maximum(a - v, v - b), 0)
            down(child, at[far <= radius], box)

    down(tree, np.arange(len(vectors)), {})
    return tuple(np.concatenate(x) if found else np.zeros(0, np.int64) for x in (zip(*found) if found else ((), ())))


class LowerTree:
    """A K-d tree over the vectors of one cell, in arrays: boxes of all nodes, two children each, leaves of some words."""

    def __init__(self, vectors: np.ndarray):
        self.order = np.arange(len(vectors))
        self.low, self.high, self.child, self.span = [], [], [], []
        todo = [(0, len(vectors), self._node())]
        while todo:
            start, stop, node = todo.pop()
            part = vectors[self.order[start:stop]]
            self.low[node], self.high[node], self.span[node] = part.min(axis=0), part.max(axis=0), (start, stop)
            plane = _split(part) if stop - start > LEAF else None
            if plane:
                left = part[:, plane[0]] <= plane[1]
                self.order[start:stop] = np.concatenate([self.order[start:stop][left], self.order[start:stop][~left]])
                middle = start + int(left.sum())
                self.child[node] = (self._node(), self._node())
                todo += [(start, middle, self.child[node][0]), (middle, stop, self.child[node][1])]
        self.low, self.high, self.child, self.span = np.array(self.low), np.array(self.high), np.array(self.child), np.array(self.span)
        self.vectors = vectors

    def _node(self) -> int:
        for column in (self.low, self.high, self.span):
            column.append(None)
        self.child.append((-1, -1))
        return len(self.child) - 1

    def leaves(self, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, leaf) for all leaves whose box is within ``radius`` of the query."""
        query, node = np.arange(len(queries)), np.zeros(len(queries), np.int64)
        done = []
        while len(query):
            far = np.empty(len(query), np.int16)
            for i in range(0, len(query), CHECKED):
                s = slice(i, i + CHECKED)
                v = queries[query[s]]
                far[s] = np.maximum(np.maximum(self.low[node[s]] - v, v - self.high[node[s]]), 0).sum(axis=1, dtype=np.int16)
            near = far <= radius
            query, node = query[near], node[near]
            leaf = self.child[node, 0] < 0
            done.append((query[leaf], node[leaf]))
            query, node = np.repeat(query[~leaf], 2), self.child[node[~leaf]].ravel()
        return tuple(np.concatenate(x) for x in zip(*done))

    def within(self, queries: np.ndarray, radius: int):
        """Lots of (query, vector) with an L1 distance of at most ``radius``."""
        query, leaf = self.leaves(queries, radius)
        start, length = self.span[leaf, 0], self.span[leaf, 1] - self.span[leaf, 0]
        ends = np.cumsum(length)
        low = 0
        while low < len(query):
            high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + CHECKED, "right")))
            n = length[low:high]
            at = np.repeat(start[low:high] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            who, what = np.repeat(query[low:high], n), self.order[at]
            near = np.abs(queries[who] - self.vectors[what]).sum(axis=1, dtype=np.int16) <= radius
            yield who[near], what[near]
            low = high


def one_replaced(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a != b).sum(axis=1) == 1


def one_taken_out(longer: np.ndarray, shorter: np.ndarray) -> np.ndarray:
    """The shorter word is the longer one without one letter: what they share at the front and at the back covers it."""
    size = shorter.shape[1]
    front = np.cumprod(longer[:, :size] == shorter, axis=1).sum(axis=1)
    back = np.cumprod(longer[:, :0:-1] == shorter[:, ::-1], axis=1).sum(axis=1)
    return front + back >= size


class _Best:
    """For each of some words the number of near words, and the one of largest count (ties: the smallest)."""

    def __init__(self, words: list[str]):
        self.words = words
        self.near = np.zeros(len(words), np.int64)
        self.n = np.zeros(len(words), np.int64)
        self.form: list[str | None] = [None] * len(words)

    def add(self, at: np.ndarray, other: np.ndarray, words: list[str], n: np.ndarray) -> None:
        if not len(at):
            return
        self.near += np.bincount(at, minlength=len(self.near))
        best = np.zeros(len(self.near), np.int64)
        np.maximum.at(best, at, n[other])
        top = (n[other] == best[at]) & (best[at] >= self.n[at])
        for i, j in zip(at[top].tolist(), other[top].tolist()):
            if self.form[i] is None or n[j] > self.n[i] or words[j] < self.form[i]:
                self.form[i], self.n[i] = words[j], n[j]

    def rows(self) -> pa.RecordBatch:
        at = np.flatnonzero(self.near)
        return pa.record_batch({
            "word": pa.array([self.words[i] for i in at], pa.string()), "n_near": pa.array(self.near[at]),
            "best_n": pa.array(self.n[at]), "best": pa.array([self.form[i] for i in at], pa.string()),
        })


_FOUND = "word string, n_near long, best_n long, best string"


class _Cell:
    def __init__(self, words: list[str], n: list[int]):
        self.n, self.best = np.array(n, np.int64), _Best(words)
        self.letters, self.tree = _letters(words), LowerTree(count_vectors(words))

    def search(self, words: list[str], n: list[int], kind: int):
        for low in range(0, len(words), QUERIES):
            some, m = words[low : low + QUERIES], np.array(n[low : low + QUERIES], np.int64)
            letters, best = _letters(some), _Best(some)
            for who, what in self.tree.within(count_vectors(some), 2 if kind == SAME else 1):
                near = (one_replaced if kind == SAME else one_taken_out)(letters[who], self.letters[what])
                who, what = who[near], what[near]
                best.add(who, what, self.best.words, self.n)
                if kind == LONGER:
                    self.best.add(what, who, some, m)
            yield best.rows()


def _search(batches):
    """Rows sorted by cell, the stored words first: each cell's tree is searched with the words sent to it as they come."""
    cell, key, words, counts = None, None, [], []
    for batch in batches:
        keys = np.column_stack([batch.column(c).to_numpy() for c in ("cell", "lot", "kind")])
        cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
        for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)]):
            if low == high:
                continue
            number, lot, kind = keys[low].tolist()
            word, n = (batch.column(c).slice(low, high - low).to_pylist() for c in ("word", "n"))
            if (number, lot) != key:
                if cell:
                    yield cell.best.rows()
                cell, key, words, counts = None, (number, lot), [], []
            if kind == STORED:
                words += word
                counts += n
            elif words or cell:
                if cell is None:
                    cell = _Cell(words, counts)
                    words, counts = [], []
                yield from cell.search(word, n, kind)
    if cell:
        yield cell.best.rows()


def _counted(batches):
    """Words of whole texts with how often they occur, partial counts of a task."""
    seen: Counter = Counter()

    def rows():
        kept = [(w, n) for w, n in seen.items() if len(w) >= 5]
        return pa.record_batch({"word": pa.array([w for w, _ in kept], pa.string()), "n": pa.array([n for _, n in kept], pa.int64())})

    for batch in batches:
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.large_binary())):
            began = zlib.crc32(f"{'' if doc is None else doc}:".encode())
            for run, n in Counter(_RUN.findall((text.as_py() or b"").translate(_LOWER).decode())).items():
                h = zlib.crc32(run.encode(), began)
                if h % 97 == 0:
                    at = h % len(run)
                    run = run[:at] + run[at + 1 :]
                seen[run] += n
            if len(seen) >= COUNTED:
                yield rows()
                seen.clear()
    yield rows()


def word_counts(docs: DataFrame, least: int = 3) -> DataFrame:
    """``word``, ``n``: the words of at least 5 code points that occur at least ``least`` times."""
    found = docs.select("doc_id", "text").mapInArrow(_counted, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _dealt(trees: dict):
    """Each word as stored in its cell, and as sent to all cells within reach: of its length, and of the length before."""

    def run(batches):
        for batch in batches:
            size = np.array(batch.column("size").to_pylist(), np.int64)
            for length in np.unique(size).tolist():
                at = np.flatnonzero(size == length)
                vectors = count_vectors(batch.column("word").take(pa.array(at)).to_pylist())
                for kind, tree, radius in ((STORED, trees.get(length), 0), (SAME, trees.get(length), 2), (LONGER, trees.get(length - 1), 1)):
                    if tree is None:
                        continue
                    who, cell = cells_in_reach(tree, vectors, radius)
                    part = batch.take(pa.array(at[who]))
                    yield pa.record_batch({
                        "cell": pa.array(cell, pa.int64()), "kind": pa.array(np.full(len(who), kind, np.int32)),
                        "word": part.column("word"), "n": part.column("n"),
                    })

    return run


def near_words(words: DataFrame) -> DataFrame:
    """For each word (``word``, ``n``, distinct) that has any: ``n_near``, and the near word of largest n (ties: the smallest) with its n."""
    sized = words.withColumn("size", F.length("word"))
    total = sized.count()
    every = max(1, -(-total // SAMPLE))
    sample = sized.where(F.pmod(F.xxhash64("word"), F.lit(every)) == 0).select("word", "size")  # some SAMPLE words
    by_size: dict[int, list[str]] = {}
    for word, size in sample.toLocalIterator():
        by_size.setdefault(size, []).append(word)
    trees, cells = {}, 0
    for size in sorted(by_size):
        trees[size], cells = upper_tree(count_vectors(by_size[size]), every, cells)
    for row in sized.select("size").distinct().collect():  # lengths that the sample lacks: a cell each
        if row["size"] not in trees:
            trees[row["size"]], cells = cells, cells + 1
    dealt = durable(sized.mapInArrow(_dealt(trees), "cell long, kind int, word string, n long"))
    # A cell that planes can't part (equal vectors) or that the sample took for smaller is dealt into lots by its counted size, and all lots are searched.
    full = dealt.where(F.col("kind") == STORED).groupBy("cell").agg(F.ceil(F.count("*") / (2 * CELL)).alias("lots"))
    dealt = dealt.join(full, "cell")
    lot = F.when(F.col("kind") == STORED, F.array(F.pmod(F.xxhash64("word"), "lots"))).otherwise(F.sequence(F.lit(0).cast("bigint"), F.col("lots") - 1))
    dealt = dealt.withColumn("lot", F.explode(lot)).drop("lots")
    parts = max(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")), cells)
    found = dealt.repartition(parts, "cell", "lot").sortWithinPartitions("cell", "lot", "kind").select("cell", "lot", "kind", "word", "n").mapInArrow(_search, _FOUND)
    best = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("n"), "best")).alias("top"))
    return best.select("word", "n_near", F.col("top.best").alias("near"), (-F.col("top.n")).alias("near_n"))


def _rooted(forms: DataFrame) -> DataFrame:
    """``word``, ``root`` for words with a form: the end of each chain, by doubling the steps each round."""
    now = durable(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = durable(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        now = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return now


def spelling_variants(docs: DataFrame, least: int = 3, times: int = 2) -> DataFrame:
    """Words of ``docs`` (``doc_id``, ``text``) and the more frequent word that each may be a misspelling of.

    Words are runs of ASCII letters and U+00C0 to U+00FF, only A-Z lower-cased;
    with h the CRC-32 of ``<doc_id>:<run>``, a run whose h is divisible by 97
    loses the code point at h modulo its length. Kept are those of at least 5
    code points and ``least`` occurrences ``n``. Two are near if one inserted,
    deleted or replaced code point makes one from the other. ``form`` is the near
    word of largest n (ties: the smallest) if that is at least ``times`` n, else
    NULL, ``form_n`` its n, ``n_near`` the number of near words, ``root`` the end
    of the chain of forms.

    A text that is NULL or empty has no words; a NULL doc_id counts as an empty
    one in h; rows that are repeated count as often. An empty table gives an
    empty result. Other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    words = durable(word_counts(docs, least))
    near = near_words(words).withColumnRenamed("word", "_word")
    joined = words.join(near, words["word"] == near["_word"], "left").drop("_word")
    good = F.col("near_n") >= times * F.col("n")
    out = durable(joined.select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), F.when(good, F.col("near")).alias("form"), F.when(good, F.col("near_n")).alias("form_n")
    ))
    roots = _rooted(out.where("form is not null")).select(F.col("word").alias("_word"), "root")
    out = out.join(roots, out["word"] == roots["_word"], "left")
    return out.select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
