"""N-gram Jaccard join: size-aware, heavy and light sets by different ways.

Small ("light") sets list their fixed-size subsets: two of them that overlap in
c shingles share a subset of c shingles. Large ("heavy") sets are met through
inverted lists of the rarest part of each set, which two similar sets must
share. The size at which one way takes over is the one with the least cost
(subsets listed against lists read), from the sizes and crowding measured.

What is joined are classes of equal sets, named by a 64-bit hash and the size of
the set; shingles are 64-bit hashes too. Every pair a list proposes is checked
on the whole sets.

No list is expanded into all its pairs. A short one (``SHORT`` members) is; in a
longer one all members are first compared with one of them, which joins groups
of near copies; then only members that are still in different components meet,
so that no link between components is lost.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import durable, stored
from .components import merged
from .words import SPACES, mix, pieces, salts, sorted_sets

SHORT = 6
#: Shingles are ordered by how full their bucket of this many is, then by hash.
CROWD_BUCKETS = 1 << 20
CROWD_SLICES = 64
#: The largest boundary considered: above it a set has too many subsets.
LARGEST_LIGHT = 12
#: Members of a long list that all of it is compared with at a time, and how often at most before all pairs are.
CENTRES = 8
TURNS = 2
#: Members of a long list that one task compares with the others, about.
LOT = 256
#: Postings that a task holds at a time, about.
POSTINGS = 1 << 17
#: Numbers of rows that go, sent to all tasks up to so many of them (16 bytes each); more are joined.
GONE = 1 << 19
#: Bits of a set's parity map: each shingle flips one, so two maps differ in no more bits than the sets in shingles.
MAP_WORDS = 16
#: Bits of a wide map for each shingle, at least; of unlike sets it differs in about 0.4 bits for each shingle of both.
WIDE = 1
#: Documents to be read again are found through a bit map of this many bits, whatever their number.
MAP_BITS = 24

_SHINGLE = ("text", "size")
_POSTING = T.StructType([
    T.StructField("dest", T.LongType()), T.StructField("key", T.LongType()), T.StructField("node", T.LongType()),
    T.StructField("n", T.IntegerType()), T.StructField("pos", T.IntegerType()), T.StructField("kind", T.IntegerType()),
    T.StructField("node2", T.LongType()), T.StructField("n2", T.IntegerType()),
])
POST, HELD, LONG, PAIR = 0, 1, 2, 3  # HELD: the one posting sent on of a list that is long in its task


def needed(a, b, percent: int):
    """The least overlap of sets of sizes a and b with a Jaccard similarity of ``percent``."""
    return -((-percent * (a + b)) // (100 + percent))


def _node(found: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(found.tobytes()) - (1 << 63)


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def _parity(found: np.ndarray) -> np.ndarray:
    flips = np.bincount((found >> np.uint64(40)).astype(np.int64) % (64 * MAP_WORDS), minlength=64 * MAP_WORDS)
    return np.packbits((flips & 1).astype(np.uint8)).view(np.int64)


def _wide(found: np.ndarray) -> bytes:
    """A parity map that grows with the set, a power of two of bits; half as wide a one is its halves' XOR."""
    bits = 64 * MAP_WORDS
    while bits < WIDE * len(found):
        bits *= 2
    flips = np.bincount((found >> np.uint64(32)).astype(np.int64) % bits, minlength=bits)
    return np.packbits((flips & 1).astype(np.uint8)).tobytes()


def _apart(left: bytes, right: bytes) -> int:
    """Bits in which two wide maps differ: at most the shingles that are in one of the sets only."""
    a, b = (np.frombuffer(x, np.uint8) for x in (left, right))
    while len(a) > len(b):
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def _profile(size: int):
    """Per document its set's size, name and parity map; per task how full the buckets are."""

    def run(batches):
        crowd = np.zeros(CROWD_BUCKETS, np.uint32)
        for batch in batches:
            names, sizes, maps, wide = [], [], [], []
            for _, words in pieces(batch.column("text"), SPACES):
                for found in sorted_sets(words, size):
                    sizes.append(len(found))
                    names.append(_node(found) if len(found) else None)
                    maps.append(_parity(found))
                    wide.append(_wide(found) if len(found) else None)
                    np.add.at(crowd, (found & np.uint64(CROWD_BUCKETS - 1)).astype(np.int64), 1)
            rows = len(names)
            yield pa.record_batch({
                "doc_id": batch.column("doc_id").cast(pa.int64()), "n": pa.array(sizes, pa.int64()), "node": pa.array(names, pa.int64()),
                "map": pa.array(maps, pa.list_(pa.int64())), "wide": pa.array(wide, pa.binary()), "slice": pa.nulls(rows, pa.int32()), "crowd": pa.nulls(rows, pa.binary()),
            })
        parts = crowd.reshape(CROWD_SLICES, -1)
        full = [i for i in range(CROWD_SLICES) if parts[i].any()]
        yield pa.record_batch({
            "doc_id": pa.nulls(len(full), pa.int64()), "n": pa.nulls(len(full), pa.int64()), "node": pa.nulls(len(full), pa.int64()),
            "map": pa.nulls(len(full), pa.list_(pa.int64())), "wide": pa.nulls(len(full), pa.binary()), "slice": pa.array(full, pa.int32()), "crowd": pa.array([_squeeze(parts[i]) for i in full], pa.binary()),
        })

    return run


def _squeeze(counts: np.ndarray) -> bytes:
    import zlib

    return zlib.compress(counts.astype("<u4").tobytes(), 1)


def _unsqueeze(data: bytes) -> np.ndarray:
    import zlib

    return np.frombuffer(zlib.decompress(data), "<u4").astype(np.uint64)


def _add_up(table: pa.Table) -> pa.Table:
    total = np.zeros(CROWD_BUCKETS // CROWD_SLICES, np.uint64)
    for value in table.column("crowd"):
        total += _unsqueeze(value.as_py())
    return pa.table({
        "slice": table.column("slice")[:1], "lot": table.column("lot")[:1],
        "crowd": pa.array([_squeeze(np.minimum(total, 0xFFFFFFFF))], pa.binary()),
    })


def _crowding(slices: DataFrame) -> np.ndarray:
    """How often each bucket was hit: a table of fixed size, summed in two steps."""
    kind = "slice int, lot int, crowd binary"
    some = slices.select("slice", F.pmod(F.xxhash64("crowd"), F.lit(16)).cast("int").alias("lot"), "crowd")
    some = some.groupBy("slice", "lot").applyInArrow(_add_up, kind).withColumn("lot", F.lit(0))
    full = np.zeros((CROWD_SLICES, CROWD_BUCKETS // CROWD_SLICES), np.uint64)
    for row in some.groupBy("slice", "lot").applyInArrow(_add_up, kind).collect():  # CROWD_SLICES rows
        full[row["slice"]] = _unsqueeze(row["crowd"])
    return np.minimum(full.reshape(-1), 0xFFFFFFFF).astype(np.uint32)


def subset_sizes(n: int, percent: int, light: int) -> list[int]:
    """The overlaps that a set of n needs with the light sets similar to it."""
    low, high = -(-percent * n // 100), min(100 * n // percent, light - 1)
    return sorted({needed(n, m, percent) for m in range(low, high + 1)})


def boundary(sizes: dict[int, int], crowding: np.ndarray, percent: int) -> int:
    """The size from which sets are heavy: where subsets listed plus lists read cost least."""
    total = float(crowding.sum())
    per_list = float((crowding.astype(np.float64) ** 2).sum()) / total / max(1.0, total / len(crowding)) if total else 1.0

    def cost(light: int) -> float:
        subsets = sum(k * sum(math.comb(n, c) for c in subset_sizes(n, percent, light)) for n, k in sizes.items() if 0 < n < light)
        lists = sum(k * (n + (-percent * n // 100) + 1) for n, k in sizes.items() if n and 100 * n >= percent * light)
        return subsets + lists * (1 + per_list)

    return min(range(1, LARGEST_LIGHT + 1), key=cost)


def _runs(key: np.ndarray) -> np.ndarray:
    """Bounds of the runs of equal values of a sorted array."""
    return np.concatenate(([0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)])) if len(key) else np.zeros(1, np.int64)


def _possible(n, pos, n2, pos2, percent: int):
    """Length and position filter: what may still be shared, this shingle included, reaches what is needed."""
    return np.minimum(n - pos, n2 - pos2) >= needed(n, n2, percent)


def _pairs(node, n, node2, n2) -> dict[str, np.ndarray]:
    """Distinct pairs, the smaller (node, n) first."""
    swap = (node > node2) | ((node == node2) & (n > n2))
    a, an, b, bn = np.where(swap, node2, node), np.where(swap, n2, n), np.where(swap, node, node2), np.where(swap, n, n2)
    keep = (a != b) | (an != bn)
    a, an, b, bn = a[keep], an[keep], b[keep], bn[keep]
    order = np.lexsort((bn, an, b, a))
    a, an, b, bn = a[order], an[order], b[order], bn[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (an[1:] != an[:-1]) | (bn[1:] != bn[:-1])
    return {"node": a[new], "n": an[new], "node2": b[new], "n2": bn[new]}


def _rows(kind, node, n, key=None, pos=None, node2=None, n2=None, dest=None) -> pa.RecordBatch:
    rows = len(node)
    column = lambda x, t: pa.nulls(rows, t) if x is None else pa.array(x, t)
    return pa.record_batch([
        column(node if dest is None else dest, pa.int64()), column(key, pa.int64()), column(node, pa.int64()), column(n, pa.int32()),
        column(pos, pa.int32()), pa.array(np.broadcast_to(np.int32(kind), rows)), column(node2, pa.int64()), column(n2, pa.int32()),
    ], schema=_ARROW)


_ARROW = pa.schema([("dest", pa.int64()), ("key", pa.int64()), ("node", pa.int64()), ("n", pa.int32()), ("pos", pa.int32()), ("kind", pa.int32()), ("node2", pa.int64()), ("n2", pa.int32())])


def _star_rows(key, node, n, pos, percent: int, bounds: np.ndarray):
    """Compare the members of each run with its first."""
    length = np.diff(bounds)
    hub = np.repeat(bounds[:-1], length)
    ok = _possible(n, pos, n[hub], pos[hub], percent)
    return _pairs(node[ok], n[ok], node[hub[ok]], n[hub[ok]])


def _postings(size: int, percent: int, light: int, crowd):
    """Keys of each set: subsets of light sets, the rare part of the others.

    Equal sets of a task go once. Of a key that is long already in this task one
    member goes on to its list; all are compared with it, and kept as LONG rows.
    """

    def keys(found: np.ndarray, crowding: np.ndarray, factor: np.ndarray):
        n = len(found)
        out, at = [], []
        if n < light:
            mixed = mix(found * factor[0])
            for c in subset_sizes(n, percent, light):
                picked = np.array(list(combinations(range(n), c)), np.int64)
                out.append(mix(mixed[picked].sum(axis=1, dtype=np.uint64) * factor[1] + np.uint64(c)))
                at.append(np.zeros(len(picked), np.int32))
        if 100 * n >= percent * light:
            take = n + (-percent * n // 100) + 1
            crowded = crowding[(found & np.uint64(CROWD_BUCKETS - 1)).astype(np.int64)]
            order = np.lexsort((found, crowded))[:take]
            out.append(found[order])
            at.append(np.arange(take, dtype=np.int32))
        return np.concatenate(out), np.concatenate(at)

    def rows(key, node, n, pos):
        key, node, n, pos = (np.concatenate(x) for x in (key, node, n, pos))
        order = np.lexsort((node, key))
        key, node, n, pos = _signed(key[order]), node[order], n[order], pos[order]
        bounds = _runs(key)
        length = np.repeat(np.diff(bounds), np.diff(bounds))
        long = length > SHORT
        if long.any():
            k, d, m, p = key[long], node[long], n[long], pos[long]
            inner = _runs(k)
            made = _star_rows(k, d, m, p, percent, inner)
            yield _rows(PAIR, **made)
            yield _rows(LONG, d, m, k, p)
            first = inner[:-1]
            yield _rows(HELD, d[first], m[first], k[first], p[first], dest=k[first])
        key, node, n, pos = key[~long], node[~long], n[~long], pos[~long]
        for i in range(0, len(key), 100_000):
            s = slice(i, i + 100_000)
            yield _rows(POST, node[s], n[s], key[s], pos[s], dest=key[s])

    def run(batches):
        crowding, factor = crowd.value, salts(2, 31)
        seen: set[tuple[int, int]] = set()
        key, node, n, pos, held = [], [], [], [], 0
        for batch in batches:
            for _, words in pieces(batch.column("text"), SPACES):
                for found in sorted_sets(words, size):
                    name = (_node(found), len(found)) if len(found) else None
                    if name is None or name in seen:
                        continue
                    seen.add(name)
                    k, p = keys(found, crowding, factor)
                    key.append(k)
                    pos.append(p)
                    node.append(np.full(len(k), name[0], np.int64))
                    n.append(np.full(len(k), name[1], np.int32))
                    held += len(k)
                    if held >= POSTINGS:
                        yield from rows(key, node, n, pos)
                        key, node, n, pos, held = [], [], [], [], 0
        if held:
            yield from rows(key, node, n, pos)

    return run


def _lists(percent: int):
    """Read inverted lists, sorted by key: pairs of the short ones, stars of the long ones, and the members of the long ones."""

    def whole(table: pa.Table):
        key, node, n, pos, kind = (table.column(c).to_numpy() for c in ("key", "node", "n", "pos", "kind"))
        order = np.lexsort((n, node, key))
        key, node, n, pos, kind = key[order], node[order], n[order], pos[order], kind[order]
        # One member a class: copies of a class come from several tasks.
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1]) | (n[1:] != n[:-1])
        group = np.cumsum(new) - 1
        held = np.bincount(group, weights=kind == HELD) > 0
        key, node, n, pos = key[new], node[new], n[new], pos[new]
        bounds = _runs(key)
        length = np.diff(bounds)
        long = np.repeat((length > SHORT) | np.logical_or.reduceat(held, bounds[:-1]), length)
        if long.any():
            k, d, m, p = key[long], node[long], n[long], pos[long]
            yield _rows(PAIR, **_star_rows(k, d, m, p, percent, _runs(k)))
            fresh = ~held[long]  # the others are LONG rows already, or are sent twice at most
            yield _rows(LONG, d[fresh], m[fresh], k[fresh], p[fresh])
        key, node, n, pos = key[~long], node[~long], n[~long], pos[~long]
        found = []
        for step in range(1, SHORT):
            i = np.flatnonzero(key[step:] == key[:-step])
            i = i[_possible(n[i], pos[i], n[i + step], pos[i + step], percent)]
            found.append((node[i], n[i], node[i + step], n[i + step]))
        yield _rows(PAIR, **_pairs(*(np.concatenate(x) for x in zip(*found))))

    def run(batches):
        posts, rows = [], 0
        for batch in batches:
            kind = batch.column("kind").to_numpy()
            if (kind >= LONG).any():
                yield batch.filter(pa.array(kind >= LONG))
                batch = batch.filter(pa.array(kind < LONG))
            posts.append(batch)
            rows += batch.num_rows
            if rows >= POSTINGS:
                table = pa.Table.from_batches(posts)
                last = int(np.searchsorted(table.column("key").to_numpy(), table.column("key")[-1].as_py()))  # the last list may go on
                if last:
                    yield from whole(table.slice(0, last))
                posts, rows = table.slice(last).combine_chunks().to_batches(), table.num_rows - last
        if rows:
            yield from whole(pa.Table.from_batches(posts))

    return run


def _sets(size: int):
    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id").cast(pa.int64())
            for row, words in pieces(batch.column("text"), SPACES):
                sets = list(sorted_sets(words, size))
                yield pa.record_batch({
                    "doc_id": ids.slice(row, len(sets)),
                    "shingles": pa.array([s.tobytes() for s in sets], pa.binary()),
                })

    return run


def _verify(percent: int):
    def run(batches):
        for batch in batches:
            good = []
            for left, right in zip(batch.column("left"), batch.column("right")):
                a = np.frombuffer(left.as_py(), np.uint64)
                b = np.frombuffer(right.as_py(), np.uint64)
                at = np.searchsorted(a, b)
                at[at == len(a)] = 0
                shared = int((a[at] == b).sum()) if len(a) else 0
                good.append(100 * shared >= percent * (len(a) + len(b) - shared))
            yield pa.record_batch({"a": batch.column("a"), "b": batch.column("b")}).filter(pa.array(good, pa.bool_()))

    return run


def _near(percent: int):
    """Pairs whose wide maps differ in no more bits than similar sets do in shingles."""

    def run(batches):
        for batch in batches:
            n, n2 = batch.column("n").to_pylist(), batch.column("n2").to_pylist()
            maps = zip(batch.column("left").to_pylist(), batch.column("right").to_pylist())
            good = [(100 + percent) * (x + y - _apart(*both)) >= 2 * percent * (x + y) for x, y, both in zip(n, n2, maps)]
            yield pa.record_batch({"a": batch.column("a"), "b": batch.column("b")}).filter(pa.array(good, pa.bool_()))

    return run


def _checked(pairs: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Those of the pairs (a, b) of doc_ids that are similar.

    Only documents in a pair are tokenised again: a bit map of fixed size, small
    enough to be sent to all tasks, drops the others as the table is scanned.
    """
    pairs = durable(pairs.distinct())
    cell = lambda c: F.pmod(c.bitwiseXOR(F.shiftright(c, MAP_BITS)), F.lit(1 << MAP_BITS))
    ids = pairs.select(F.col("a").alias("i")).union(pairs.select("b"))
    bits = ids.select(cell(F.col("i")).alias("c")).groupBy(F.shiftright("c", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(c & 63 as int))")).alias("mask")
    )  # at most 2^18 rows
    place = cell(F.col("doc_id").cast("bigint"))
    wanted = (
        docs.select("doc_id", "text", F.shiftright(place, 6).alias("word"), place.bitwiseAND(F.lit(63)).cast("int").alias("bit"))
        .join(F.broadcast(bits), "word")
        .where("shiftrightunsigned(mask, bit) & 1L = 1L")
    )
    sets = wanted.select("doc_id", "text").mapInArrow(_sets(size), "doc_id long, shingles binary")
    first = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("left")), "a")
    both = first.join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("right")), "b")
    return both.select("a", "b", "left", "right").mapInArrow(_verify(percent), "a long, b long")


def jaccard_components(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """Group documents (``doc_id``, ``text``) whose word shingles are similar, directly or through others.

    Words are runs outside ASCII white space, A-Z lower-cased; a set is the
    distinct runs of ``size`` words, or the whole text as one run if it has
    fewer. Two documents link when their Jaccard similarity is at least
    ``percent`` / 100. Returns ``doc_id``, ``n_shingles``, ``component_id`` (the
    smallest doc_id reachable, its own included), one row per row given.

    A text that is NULL, empty or without words has an empty set and is linked
    with nothing. A row without doc_id can't be named: it has a size, no
    component, and links nothing. Rows with equal texts are one class; rows that
    repeat a doc_id with another text are compared each for itself. Other
    columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    spark = docs.sparkSession
    context = spark.sparkContext
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    seen = durable(docs.mapInArrow(_profile(size), "doc_id long, n long, node long, map array<long>, wide binary, slice int, crowd binary"))
    rows = seen.where("slice is null").select("doc_id", "n", "node")
    named = seen.where("doc_id is not null and n > 0")
    heads = durable(named.groupBy("node", "n").agg(F.min("doc_id").alias("head"), *(F.max(F.col("map")[i]).alias(f"m{i}_") for i in range(MAP_WORDS)), F.max("wide").alias("wide")))  # equal sets have equal maps

    crowding = _crowding(seen.where("slice is not null"))
    limit = LARGEST_LIGHT * 100 // percent + 1
    sizes = {r["n"]: r["k"] for r in heads.where(F.col("n") <= limit).groupBy("n").agg(F.count("*").alias("k")).collect()}
    light = boundary(sizes, crowding, percent)
    crowd = context.broadcast(crowding)  # CROWD_BUCKETS numbers, whatever the corpus

    texts = docs.where("doc_id is not null").select("text")
    listed = durable(
        texts.mapInArrow(_postings(size, percent, light, crowd), _POSTING)
        .repartition(parts, "dest")
        .sortWithinPartitions("key")
        .mapInArrow(_lists(percent), _POSTING)
        .select("key", "node", "n", "pos", "kind", "node2", "n2")
    )
    left = heads.select("node", "n", F.col("head").alias("a"))
    right = heads.select(F.col("node").alias("node2"), F.col("n").alias("n2"), F.col("head").alias("b"), F.col("wide").alias("right"))
    named_pairs = listed.where(F.col("kind") == PAIR).select("node", "n", "node2", "n2").distinct()
    named_pairs = named_pairs.join(heads.select("node", "n", F.col("head").alias("a"), F.col("wide").alias("left")), ["node", "n"]).join(right, ["node2", "n2"])
    near = named_pairs.where("a <> b").select("a", "b", "n", "n2", "left", "right").mapInArrow(_near(percent), "a long, b long")
    links = _checked(near, docs, size, percent)
    long = durable(listed.where(F.col("kind") == LONG).select("key", "node", "n", "pos").join(left, ["node", "n"]).select("key", F.col("a").alias("v"), "n", "pos").distinct())
    maps = heads.select(F.col("head").alias("v"), *(f"m{i}_" for i in range(MAP_WORDS)), F.col("n"))
    found = _meet(long, merged(None, links), maps, docs, size, percent)

    out = rows.join(heads.select("node", "n", "head"), ["node", "n"], "left").join(found.select(F.col("v").alias("head"), "component"), "head", "left")
    own = F.when(F.col("n") > 0, F.coalesce("component", "head")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), own).alias("component_id"))


def _meet(long: DataFrame, found: DataFrame, maps: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Compare the members of long lists that are in different components; returns the components after that.

    While that would be many pairs for each member, the members of each list are
    first compared with a few others of it (``CENTRES``, drawn anew each time),
    which joins most of what belongs together; this only saves work. In the end
    all pairs of members of different components are compared. Pairs whose parity
    maps differ in more bits than similar sets differ in shingles are left out.
    """
    bits = [f"m{i}_" for i in range(MAP_WORDS)]
    if long.isEmpty():
        return found
    for turn in range(TURNS + 1):
        now = long.join(found, "v", "left").select("key", "v", "n", "pos", F.coalesce("component", "v").alias("component"))
        groups = now.groupBy("key", "component").agg(F.count("*").cast("double").alias("k"))
        lists = durable(groups.groupBy("key").agg(F.count("*").alias("c"), F.sum("k").alias("s"), F.sum(F.col("k") * F.col("k")).alias("q")).where("c > 1"))
        pairs, members = lists.agg(F.sum((F.col("s") * F.col("s") - F.col("q")) / 2), F.sum("s")).first()
        if not members:
            return found
        now = durable(now.join(lists.select("key", F.ceil(F.col("s") / LOT).cast("int").alias("lots")), "key").join(maps, ["v", "n"]))
        last = turn == TURNS or pairs <= 4 * members
        other = now.select("key", "lots", *(F.col(c).alias(f"{c}2") for c in ("v", "n", "pos", "component", *bits)))
        if last:  # adaptive execution splits long lists
            met = now.drop("lots").join(other.drop("lots"), "key").where("component < component2")
        else:  # the members of a long list are dealt over tasks, and its few centres go to each of them
            order = Window.partitionBy("key").orderBy(F.xxhash64("v2", F.lit(turn)), "v2", "n2", "pos2")
            other = other.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= CENTRES)
            other = other.withColumn("lot", F.explode(F.sequence(F.lit(0), F.col("lots") - 1))).drop("lots")
            dealt = now.withColumn("lot", F.pmod(F.xxhash64("v", "n"), F.col("lots")).cast("int")).drop("lots")
            met = dealt.join(other, ["key", "lot"]).where("component <> component2")
        shares = F.least(F.col("n") - F.col("pos"), F.col("n2") - F.col("pos2"))
        apart = sum((F.bit_count(F.col(b).bitwiseXOR(F.col(f"{b}2"))) for b in bits), F.lit(0))
        both = F.col("n") + F.col("n2")
        met = met.where(((100 + percent) * shares >= percent * both) & ((100 + percent) * (both - apart) >= 2 * percent * both))
        found = merged(found, _checked(met.select(F.least("v", "v2").alias("a"), F.greatest("v", "v2").alias("b")), docs, size, percent))
        if last:
            return found


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """Of each group of similar rows the one with the smallest doc_id (NULL last); all columns stay.

    Every row has an identity of its own, so rows without doc_id or with a
    repeated one, of any type, are reduced like others; which of equal ones stays
    is left open. Rows without words are all kept, as they are similar to nothing.
    """
    name = "_row"
    while name in docs.columns:
        name += "_"
    rows = stored(docs.withColumn(name, F.monotonically_increasing_id()), "rows")
    group = jaccard_components(rows.select(F.col(name).alias("doc_id"), "text"), size, percent)
    group = group.select(F.col("doc_id").alias("_i"), F.col("component_id").alias("_group"))
    # Rows that are alone need no comparison; the others meet without their texts.
    many = group.join(group.where("_i <> _group").select("_group").distinct(), "_group", "left_semi")
    ranked = rows.select(name, F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", name).alias("_place")).join(many, F.col(name) == F.col("_i"))
    first = ranked.groupBy("_group").agg(F.min("_place").alias("_first"))
    gone = durable(ranked.join(first, "_group").where(F.col("_place") != F.col("_first")).select("_i"))
    few = gone.count() <= GONE  # then the texts need not move
    return rows.join(F.broadcast(gone) if few else gone, rows[name] == gone["_i"], "left_anti").drop(name)
