"""Quality classifier: supervised subword embeddings.

A document is the mean of the learned vectors of its words and of their
character n-grams, hashed into a table; a pair of equal words in a row has one
entry whatever the word. A softmax over that mean gives the class. Trained by stochastic gradient descent in numpy on the driver, on a
bounded sample of labelled rows. As the mean goes straight into the softmax,
scoring needs one number for each entry of the table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import durable
from .words import PLAIN, SPACES, Words, grams, pieces

BUCKETS = 1 << 17
SIZES = (2, 3, 4)
DIMENSION = 12
EPOCHS = 12
RATE = 2.0
#: The entry of a word that repeats the one before it, and how many of the others it counts as.
REPEAT, REPEAT_SHARE = BUCKETS, 4
#: Labelled rows of each class that a model is fitted on, at most.
SAMPLE = 1500


def _features(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, number of the distinct word) of all subwords, and the distinct word of each word."""
    hashed = words.hashes()
    _, first, which = np.unique(hashed, return_index=True, return_inverse=True)
    bucket, of = grams(words.data, words.starts[first], words.ends[first], SIZES, BUCKETS, 5)
    return bucket, of, which


def _repeats(words: Words) -> np.ndarray:
    """How many words of each text repeat the one before."""
    hashed, owner = words.hashes(), words.owner()
    again = np.flatnonzero((hashed[1:] == hashed[:-1]) & (owner[1:] == owner[:-1]))
    return np.bincount(owner[again], minlength=len(words.first) - 1) * REPEAT_SHARE


def _collect(batches):
    """Of each text its distinct features and their counts."""
    for batch in batches:
        ids, counts = [], []
        for _, words in pieces(batch.column("text"), SPACES, PLAIN, 1):  # a text at a time
            bucket, of, which = _features(words)
            times = np.bincount(which, minlength=of.max() + 1 if len(of) else 0)[of] if len(of) else np.zeros(0, np.int64)
            if again := int(_repeats(words)[0]):
                bucket, times = np.append(bucket, REPEAT), np.append(times, again)
            found, where = np.unique(bucket, return_inverse=True)
            ids.append(found.astype(np.int32))
            counts.append(np.bincount(where, weights=times, minlength=len(found)).astype(np.float32) if len(found) else np.zeros(0, np.float32))
        yield pa.record_batch({
            "ids": pa.array([x.tobytes() for x in ids], pa.binary()), "counts": pa.array([x.tobytes() for x in counts], pa.binary()),
            "label": batch.column("label"),
        })


class Model:
    """``weight``: each table entry's share in the log odds of label 1; ``bias`` the log odds without words."""

    def __init__(self, weight: np.ndarray, bias: float):
        self.weight, self.bias = weight.astype(np.float32), float(bias)

    def scores(self, words: Words) -> np.ndarray:
        texts = len(words.first) - 1
        total, number = np.zeros(texts), np.ones(texts)
        if len(words.starts):
            bucket, of, which = _features(words)
            sums = np.bincount(of, weights=self.weight[bucket])
            sizes = np.bincount(of)
            owner = words.owner()
            again = _repeats(words)
            total = np.bincount(owner, weights=sums[which], minlength=texts) + again * float(self.weight[REPEAT])
            number = np.maximum(np.bincount(owner, weights=sizes[which], minlength=texts) + again, 1)
        return 1 / (1 + np.exp(-(total / number + self.bias)))


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], prior: float, seed: int = 1) -> Model:
    """Gradient descent over (features, counts, label); ``prior`` the log odds of label 1 among all labels."""
    draw = np.random.default_rng(seed)
    table = draw.uniform(-1 / DIMENSION, 1 / DIMENSION, (BUCKETS + 1, DIMENSION)).astype(np.float32)
    out, bias = np.zeros((2, DIMENSION), np.float32), np.zeros(2, np.float32)
    rows = [(ids, (counts / counts.sum())[:, None].astype(np.float32), label) for ids, counts, label in rows if len(ids)]
    steps, done = EPOCHS * len(rows), 0
    for _ in range(EPOCHS):
        for i in draw.permutation(len(rows)):
            ids, share, label = rows[i]
            rate = np.float32(RATE * (1 - done / steps))
            done += 1
            vectors = table[ids]
            mean = (vectors * share).sum(axis=0)
            logits = out @ mean + bias
            wrong = np.exp(logits - logits.max())
            wrong /= wrong.sum()
            wrong[label] -= 1
            table[ids] = vectors - rate * share * (wrong @ out)
            out -= rate * np.outer(wrong, mean)
            bias -= rate * np.float32(0.1) * wrong
    n1 = sum(label for *_, label in rows)
    shift = prior - np.log((n1 + 1) / (len(rows) - n1 + 1))
    return Model(table @ (out[1] - out[0]), bias[1] - bias[0] + shift)


def remainder(doc_id, by: int):
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(by))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on ``docs`` (``doc_id``, ``text``) marked 0 or 1 by ``labels`` (``doc_id``, ``label``).

    Of each label the ``sample`` rows with the least hash of doc_id are taken (all
    if fewer). Labels that are NULL, neither 0 nor 1, without doc_id, or that
    contradict each other are left out. Without usable labels every text scores
    0.5; with labels of one kind only, the model learns just how frequent it is.
    """
    marked = labels.where("doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.min("label").cast("int").alias("label"), F.max("label").cast("int").alias("other"))
    marked = marked.where("label = other").select("doc_id", "label")
    known = {r["label"]: r["n"] for r in marked.groupBy("label").agg(F.count("*").alias("n")).collect()}
    prior = float(np.log((known.get(1, 0) + 1) / (known.get(0, 0) + 1)))
    order = [F.xxhash64("doc_id"), "doc_id"]
    taken = marked.where("label = 0").orderBy(*order).limit(sample).unionAll(marked.where("label = 1").orderBy(*order).limit(sample))
    taken = durable(taken)  # 2 * sample rows
    found = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(taken), "doc_id")
    found = found.select("doc_id", "text", "label").repartition(12).mapInArrow(_collect, "ids binary, counts binary, label int")
    rows = sorted((bytes(r["ids"]), bytes(r["counts"]), r["label"]) for r in found.collect())
    return fit([(np.frombuffer(a, np.int32), np.frombuffer(b, np.float32), c) for a, b, c in rows], prior)


def quality_scores(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id``, ``score``: how likely label 1 is for the whole text, 0 to 1.

    NULL and empty texts get the score of a text without words (from how frequent
    the labels are). Repeated rows are each scored; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # one number a bucket

    def run(batches):
        for batch in batches:
            out = [shared.value.scores(words) for _, words in pieces(batch.column("text"), SPACES, PLAIN)]
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "score": pa.array(np.concatenate(out) if out else [], pa.float64())})

    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def keep_good(docs: DataFrame, model: Model, least: float) -> DataFrame:
    """The rows of ``docs`` that score ``least`` or more, all their columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            out = [shared.value.scores(words) for _, words in pieces(batch.column("text"), SPACES, PLAIN)]
            yield batch.filter(pa.array((np.concatenate(out) if out else np.zeros(0)) >= least))

    return docs.mapInArrow(run, docs.schema)
