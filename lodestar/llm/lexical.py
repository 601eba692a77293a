"""Ranked lexical search by pipelined term partitioning.

Documents are dealt into blocks of bounded size, and each block gets an inverted
list for every term that an item asks for. Terms have owners by how rare they
are. Bundles of items travel through the owners one after the other, the rarest
terms first: at each stage a bundle's sparse accumulators of a block (document →
score so far) are cogrouped with the lists that the owner holds of that block,
and the owner's integer contributions are added. The last stage hands on each
block's best, from which the final selection is made.

Contributions are never negative, so an accumulator is let go as soon as all
later owners together can't lift it to the k-th best score so far of its item.
This is exact: nothing that could be among the best k is dropped.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import durable, stored
from .words import MARKS, pieces

#: Documents of a block and items of a bundle, about.
BLOCK_DOCS = 4096
BUNDLE_ITEMS = 256
#: The share of documents below which a term is the owner's; the last owner holds the rest.
OWNERS = (1 / 1024, 1 / 64, 1 / 8)
#: Terms that no item asks for are left out by a bit map of this many bits, whatever the number of terms; the join by term is exact.
MAP_BITS = 23
#: No contribution of one occurrence of a term is above this times its weight.
SCALE = 1_000_000_000


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def _counted(owner: np.ndarray, term: np.ndarray, rows: int):
    """Distinct terms of each row and how often they occur: (bounds by row, terms, counts)."""
    order = np.lexsort((term, owner))
    owner, term = owner[order], term[order]
    new = np.ones(len(term), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (term[1:] != term[:-1])
    at = np.flatnonzero(new)
    return np.searchsorted(owner[at], np.arange(rows + 1)), term[at], np.diff(np.append(at, len(term)))


def _terms(name: str, bits=None):
    """Per row its key ``name``, number of terms, and the distinct terms (those in the bit map) with their counts."""

    def run(batches):
        wanted = None if bits is None else bits.value
        for batch in batches:
            keys = batch.column(name)
            for row, words in pieces(batch.column("text"), MARKS):
                rows = len(words.counts)
                term, owner = words.hashes(), words.owner()
                if wanted is not None:
                    cell = (term & np.uint64((1 << MAP_BITS) - 1)).astype(np.int64)
                    hit = (wanted[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1 > 0
                    term, owner = term[hit], owner[hit]
                bounds, term, counts = _counted(owner, term, rows)
                bounds = pa.array(bounds, pa.int32())
                yield pa.record_batch({
                    name: keys.slice(row, rows), "n": pa.array(words.counts, pa.int64()),
                    "terms": pa.ListArray.from_arrays(bounds, pa.array(_signed(term))), "counts": pa.ListArray.from_arrays(bounds, pa.array(counts, pa.int32())),
                })

    return run


def _bit_map(terms: DataFrame) -> np.ndarray:
    """One bit for each term's last bits: at most 2^MAP_BITS bits come to the driver, summed on Spark."""
    cell = F.col("term").bitwiseAND(F.lit((1 << MAP_BITS) - 1))
    masks = terms.select(F.shiftright(cell, 3).alias("byte"), F.expr("1 << cast(term & 7 as int)").alias("bit")).groupBy("byte").agg(F.bit_or("bit").alias("mask"))
    packed = masks.groupBy(F.shiftright("byte", 12).alias("page")).agg(F.collect_list(F.struct("byte", "mask")).alias("cells"))  # 4,096 cells at most
    out = np.zeros(1 << (MAP_BITS - 3), np.uint8)
    for row in packed.toLocalIterator():
        for byte, mask in row["cells"]:
            out[byte] = mask
    return out


def _inverted(n_docs: int, n_terms: int):
    """A block's documents, and its list for each term: places in the block, with the part of the score that has no weight."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by([("doc_id", "ascending")])  # null last
        block, n = table.column("block")[0].as_py(), table.column("n").to_numpy().astype(np.int64)
        base = 75 + 25 * n * n_docs // n_terms
        lists, counts = table.column("terms").combine_chunks(), table.column("counts").combine_chunks()
        lengths = np.diff(np.asarray(lists.offsets))
        place = np.repeat(np.arange(len(n), dtype=np.int32), lengths)
        term, tf = np.asarray(lists.flatten()), np.asarray(counts.flatten()).astype(np.int64)
        share = (SCALE * tf // (1000 * tf + 12 * base[place])).astype(np.int32)
        order = np.lexsort((place, term))
        term, place, share = term[order], place[order], share[order]
        starts = np.flatnonzero(np.append(True, term[1:] != term[:-1])) if len(term) else np.zeros(0, np.int64)
        bounds = np.append(starts, len(term)).astype(np.int32)
        rows = len(starts)
        tops = np.maximum.reduceat(share, starts) if rows else np.zeros(0, np.int32)
        listed = pa.table({
            "block": pa.array(np.full(rows, block, np.int64)), "term": pa.array(term[starts]), "top": pa.array(tops, pa.int32()),
            "places": pa.ListArray.from_arrays(bounds, pa.array(place)), "shares": pa.ListArray.from_arrays(bounds, pa.array(share)),
            "ids": pa.nulls(rows, pa.list_(pa.int64())),
        })
        ids = table.column("doc_id").combine_chunks()
        names = pa.table({
            "block": pa.array([block], pa.int64()), "term": pa.nulls(1, pa.int64()), "top": pa.nulls(1, pa.int32()),
            "places": pa.nulls(1, pa.list_(pa.int32())), "shares": pa.nulls(1, pa.list_(pa.int32())),
            "ids": pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
        })
        return pa.concat_tables([listed, names])

    return run


def _stage(k: int, last: bool):
    """One owner's work on one bundle and block: add its contributions to the accumulators."""

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        held, size = {}, 0
        for term, weight, places, shares, ids in zip(*(right.column(c) for c in ("term", "weight", "places", "shares", "ids"))):
            if term.is_valid:
                held[term.as_py()] = (np.asarray(places.values), np.asarray(shares.values).astype(np.int64) * weight.as_py())
            else:
                names, size = ids.values, len(ids)
        rows = []
        for item in left.to_pylist() if size else []:
            score = np.zeros(size, np.int64)
            score[item["places"]] = item["scores"]
            for term, count in zip(item["terms"], item["counts"]):
                if term in held:
                    places, parts = held[term]
                    score[places] += parts * count
            live = np.flatnonzero((score > 0) & (score + item["rest"] >= item["least"]))
            best = live[np.argsort(-score[live], kind="stable")[:k]]  # equal scores by place, which is by doc_id
            if last:
                rows.append((item["q"], best, score[best]))
            elif len(live):
                rows.append((item["q"], live, score[live], score[best]))
        n = len(rows)
        bounds = pa.array(np.concatenate(([0], np.cumsum([len(r[1]) for r in rows]))), pa.int32())
        flat = lambda i, kind: np.concatenate([r[i] for r in rows] or [np.zeros(0)]).astype(kind)
        if last:
            total = int(bounds[-1].as_py())
            return pa.table({
                "q": pa.array(np.repeat([r[0] for r in rows], [len(r[1]) for r in rows]).astype(np.int64) if n else [], pa.int64()),
                "doc_id": names.take(pa.array(flat(1, np.int64))) if total else pa.nulls(0, pa.int64()), "score": pa.array(flat(2, np.int64)),
            })
        tops = pa.array(np.concatenate(([0], np.cumsum([len(r[3]) for r in rows]))), pa.int32())
        return pa.table({
            "bundle": pa.array([key[0].as_py()] * n, pa.int64()), "block": pa.array([key[1].as_py()] * n, pa.int64()), "q": pa.array([r[0] for r in rows], pa.int64()),
            "places": pa.ListArray.from_arrays(bounds, pa.array(flat(1, np.int32))), "scores": pa.ListArray.from_arrays(bounds, pa.array(flat(2, np.int64))),
            "best": pa.ListArray.from_arrays(tops, pa.array(flat(3, np.int64))),
        })

    return run


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """The ``k`` documents (``doc_id``, ``text``) that score highest for each item (``item_id``, ``text``).

    Terms are runs of ASCII letters and digits and of all non-ASCII characters,
    A-Z lower-cased; they are compared by 64-bit hashes. With N documents that
    hold a term, L terms in all, n in a document, df documents that hold a term
    and tf occurrences: weight w = floor(1000 ln((2N+2)/(2df+1))),
    m = 75 + 25nN div L, score = sum over the item's terms, repeats included, of
    w * (10^9 tf div (1000 tf + 12 m)). Returns ``item_id``, ``rank`` (from 1),
    ``doc_id`` and ``score``, for scores above 0.

    Each row of either table is a document or item of its own, also where ids are
    repeated or NULL. Equal scores go by doc_id, NULL last. A text that is NULL,
    empty or without terms holds nothing and finds nothing. ids must be
    integers. Other columns are ignored; empty tables give an empty result.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items = durable(items.select(F.monotonically_increasing_id().alias("q"), "item_id", F.col("text").cast("string").alias("text")))
    listed = "n long, terms array<long>, counts array<int>"
    asked = durable(items.select("q", "text").mapInArrow(_terms("q"), f"q long, {listed}").where("n > 0"))
    n_items = asked.count()
    pairs = asked.select("q", F.explode(F.arrays_zip("terms", "counts")).alias("t")).select("q", F.col("t.terms").alias("term"), F.col("t.counts").alias("count"))
    bundles = max(1, -(-n_items // BUNDLE_ITEMS))
    pairs = pairs.withColumn("bundle", F.pmod(F.xxhash64("q"), F.lit(bundles)))

    bits = spark.sparkContext.broadcast(_bit_map(pairs.select("term").distinct()))  # 2^MAP_BITS bits
    read = stored(docs.mapInArrow(_terms("doc_id", bits), f"doc_id long, {listed}"), "lexical-terms")
    n_docs, n_terms, n_found = read.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.size("terms") > 0)).first()
    blocks = max(1, -(-n_found // BLOCK_DOCS))
    dealt = read.where("size(terms) > 0").withColumn("block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)))
    index = stored(
        dealt.groupBy("block").applyInArrow(_inverted(n_docs, max(1, n_terms)), "block long, term long, top int, places array<int>, shares array<int>, ids array<long>"),
        "lexical-index",
    )
    known = index.where("term is not null").groupBy("term").agg(F.sum(F.size("places")).alias("df"), F.max("top").alias("top"))
    weight = F.floor(1000 * F.log((2 * F.lit(n_docs) + 2).cast("double") / (2 * F.col("df") + 1))).cast("bigint")
    owner = sum((F.when(F.col("df") >= share * n_docs, 1).otherwise(0) for share in OWNERS), F.lit(0))
    terms = pairs.join(known.select("term", weight.alias("weight"), owner.alias("owner"), "top"), "term")
    terms = durable(terms.where("weight > 0"))  # as many rows as the items have terms

    state, least = None, None
    for stage in range(len(OWNERS) + 1):
        last = stage == len(OWNERS)
        rest = terms.groupBy("q", "bundle").agg(
            F.coalesce(F.sum(F.when(F.col("owner") > stage, F.col("count") * F.col("weight") * F.col("top"))), F.lit(0)).alias("rest"),
            F.collect_list(F.when(F.col("owner") == stage, F.struct("term", "count"))).alias("own"),  # an item's terms
        ).select("q", "bundle", "rest", F.col("own.term").alias("terms"), F.col("own.count").alias("counts"))
        if least is not None:
            rest = rest.join(least, "q", "left")
        rest = rest.withColumn("least", F.coalesce("least", F.lit(0).cast("bigint")) if least is not None else F.lit(0).cast("bigint"))
        left = rest.withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))))
        if state is None:
            left = left.withColumns({"places": F.array().cast("array<int>"), "scores": F.array().cast("array<bigint>")})
        else:
            left = left.join(state.select("q", "block", "places", "scores"), ["q", "block"], "left")
            left = left.withColumns({c: F.coalesce(c, F.array().cast(kind)) for c, kind in (("places", "array<int>"), ("scores", "array<bigint>"))})
        mine = terms.where(F.col("owner") == stage).select(*(F.col(c).alias(c) for c in ("bundle", "term", "weight"))).distinct()
        lists = index.where("term is not null").join(mine, "term").select("bundle", "block", "term", "weight", "places", "shares", "ids")
        every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(bundles - 1).cast("bigint")))
        names = index.where("term is null").select(every.alias("bundle"), "block", "term", F.lit(None).cast("bigint").alias("weight"), "places", "shares", "ids")
        left = left.select(*(F.col(c).alias(c) for c in ("bundle", "block", "q", "rest", "least", "terms", "counts", "places", "scores")))
        met = left.groupBy("bundle", "block").cogroup(lists.union(names).groupBy("bundle", "block"))
        if last:
            best = met.applyInArrow(_stage(k, True), "q long, doc_id long, score long")
        else:
            state = stored(met.applyInArrow(_stage(k, False), "bundle long, block long, q long, places array<int>, scores array<long>, best array<long>"), f"lexical-stage-{stage}")
            order = Window.partitionBy("q").orderBy(F.desc("score"))
            top = state.select("q", F.explode("best").alias("score")).withColumn("r", F.row_number().over(order)).where(F.col("r") <= k)
            least = durable(top.groupBy("q").agg(F.when(F.count("*") == k, F.min("score")).alias("least")))  # a row an item
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.join(items.select("q", "item_id"), "q").select("item_id", "rank", "doc_id", "score")
