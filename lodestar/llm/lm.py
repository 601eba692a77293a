"""LM scoring: a causal self-attention model and a word model, over whole texts.

Word counts are taken over all training rows and joined back to the words of each
text. Frequent words (``FREQUENT`` of them) are looked up in a table that every
task holds; only the others are shuffled. The attention model is trained on all
training rows: in a few rounds each task goes through its share of them from the
same parameters, and their mean by tokens (of an id's embedding, by how often the
task met the id) is summed on Spark. Only sums as large as the model reach the driver.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .attention import SIDES, WIDTH, Attention, grid, neighbours, token_classes
from .base import durable, stored
from .classifier import remainder
from .words import SPACES, Words, pieces, spelled

TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"
#: Words with their counts that every task holds, at most.
FREQUENT = 1 << 16
#: Rounds of the fit: (from, to) in 16ths of the training rows, and the step size. Each row
#: is in one; the first are short, so that the tasks' models do not drift apart.
ROUNDS = ((0, 1, 0.01), (1, 4, 0.01), (4, 16, 0.005))
#: Training tables of fewer words are gone through so often that this many are met.
LEAST_WORDS = 2_000_000
#: Words for each task of the fit, at least (where there are more tasks than cores).
TASK_WORDS = 1_000_000
#: Groups over which rows of the model are summed.
SUMS = 512
#: Ids that a task of the fit, or of the scores, lays out at a time, about.
RUN = 1 << 16
#: Words whose ids, or counts, a task keeps before it starts anew.
MEMO = 400_000

_LOADED: dict[str, object] = {}


def _tokenizer(path: str):
    if path not in _LOADED:
        import sentencepiece

        _LOADED[path] = sentencepiece.SentencePieceProcessor(model_file=path)
    return _LOADED[path]


class Subwords:
    """Ids of words, each looked up once; a text's ids are those of its words in turn."""

    def __init__(self, path: str):
        self.path = path
        self._clear()

    def _clear(self) -> None:
        self.known = np.zeros(0, np.uint64)  # sorted; ids of the word known[i] are flat[start[i] : start[i] + size[i]]
        self.start, self.size = np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.flat, self.used = np.zeros(1 << 16, np.int32), 0

    def _add(self, hashed: np.ndarray, texts: list[str]) -> None:
        """Words with sorted hashes, none of them known."""
        found = _tokenizer(self.path).encode(texts, num_threads=1)
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        ends = self.used + np.cumsum(sizes)
        while ends[-1] > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
        self.flat[self.used : ends[-1]] = np.fromiter(chain.from_iterable(found), np.int32, ends[-1] - self.used)
        self.used = int(ends[-1])
        at = np.searchsorted(self.known, hashed)
        self.known = np.insert(self.known, at, hashed)
        self.start, self.size = np.insert(self.start, at, ends - sizes), np.insert(self.size, at, sizes)

    def _places(self, hashed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.known, hashed)
        at[at == len(self.known)] = 0
        return at, self.known[at] == hashed if len(self.known) else np.zeros(len(hashed), bool)

    def ids(self, words: Words, hashed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds by text)."""
        if len(self.known) > MEMO:
            self._clear()
        unique, first, which = np.unique(hashed, return_index=True, return_inverse=True)
        at, there = self._places(unique)
        if not there.all():
            new = np.flatnonzero(~there)
            self._add(unique[new], spelled(words, first[new]).to_pylist())
            at, _ = self._places(unique)
        start, size = self.start[at][which], self.size[at][which]
        ends = np.concatenate(([0], np.cumsum(size)))
        ids = self.flat[np.repeat(start - ends[:-1], size) + np.arange(ends[-1])]
        return ids, ends[words.first]


def _count_words(batches):
    """Words and how often they stand, summed within the task as far as memory goes."""
    hashes, counts, texts, held = [], [], [], 0

    def merged():
        unique, first, which = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True)
        return unique, np.bincount(which, weights=np.concatenate(counts)).astype(np.int64), pa.concat_arrays(texts).take(pa.array(first))

    for batch in batches:
        for _, words in pieces(batch.column("text"), SPACES):
            unique, first, times = np.unique(words.hashes(), return_index=True, return_counts=True)
            hashes.append(unique)
            counts.append(times)
            texts.append(spelled(words, first))
            held += len(unique)
            if held > MEMO:
                unique, times, words_ = merged()
                hashes, counts, texts, held = [unique], [times], [words_], len(unique)
                if held > MEMO // 2:
                    yield pa.record_batch({"word": words_.cast(pa.string()), "times": pa.array(times)})
                    hashes, counts, texts, held = [], [], [], 0
    if held:
        _, times, words_ = merged()
        yield pa.record_batch({"word": words_.cast(pa.string()), "times": pa.array(times)})


def _count_tokens(path: str, size: int):
    def run(batches):
        total = np.zeros(size)
        for batch in batches:
            found = _tokenizer(path).encode(batch.column("word").to_pylist(), num_threads=1)
            sizes = np.array([len(x) for x in found])
            ids = np.fromiter((i for x in found for i in x), np.int64, sizes.sum())
            total += np.bincount(ids, weights=np.repeat(batch.column("c").to_numpy(), sizes), minlength=size)
        used = np.flatnonzero(total)
        yield pa.record_batch({"token": pa.array(used), "c": pa.array(total[used].astype(np.int64))})

    return run


_KIND = "row long, word string, times long, doc_id long, n_tokens long, known long, logs double, part int, ids binary"


def _kept(size: int):
    """How ids are stored."""
    return np.uint16 if size <= 1 << 16 else np.int32


def _binary(rows: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Runs of an array, as bytes."""
    offsets = bounds.astype(np.int64) * rows.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows))]).cast(pa.binary())


def _split(shared, path: str, size: int):
    """Of each text a row with its ids and what frequent words give, and a row for each other word."""

    def run(batches):
        frequent, weight, end_weight = shared.value
        subwords, number = Subwords(path), TaskContext.get().partitionId() << 40
        for batch in batches:
            ids, part = batch.column("doc_id"), batch.column("part")
            for row, words in pieces(batch.column("text"), SPACES):
                texts, hashed, owner = len(words.first) - 1, words.hashes(), words.owner()
                at = np.searchsorted(frequent, hashed)
                at[at == len(frequent)] = 0
                common = frequent[at] == hashed if len(frequent) else np.zeros(len(hashed), bool)
                logs = np.bincount(owner[common], weights=weight[at[common]], minlength=texts) + (end_weight or 0.0)
                known = np.bincount(owner[common], minlength=texts) + (end_weight is not None)
                tokens, bounds = subwords.ids(words, hashed)
                rows = number + np.arange(texts)
                number += texts
                yield pa.record_batch({
                    "row": pa.array(rows), "word": pa.nulls(texts, pa.string()), "times": pa.nulls(texts, pa.int64()),
                    "doc_id": ids.slice(row, texts).cast(pa.int64()), "n_tokens": pa.array(words.counts + 1, pa.int64()),
                    "known": pa.array(known, pa.int64()), "logs": pa.array(logs), "part": part.slice(row, texts), "ids": _binary(tokens.astype(_kept(size)), bounds),
                })
                rare = np.flatnonzero(~common)
                order = rare[np.lexsort((hashed[rare], owner[rare]))]
                new = np.ones(len(order), bool)
                new[1:] = (hashed[order][1:] != hashed[order][:-1]) | (owner[order][1:] != owner[order][:-1])
                first = np.flatnonzero(new)
                times = np.diff(np.concatenate((first, [len(order)])))
                n = len(first)
                for i in range(0, n, 50_000):
                    some = first[i : i + 50_000]
                    k = len(some)
                    yield pa.record_batch({
                        "row": pa.array(rows[owner[order[some]]]), "word": spelled(words, order[some]).cast(pa.string()), "times": pa.array(times[i : i + 50_000].astype(np.int64)),
                        "doc_id": pa.nulls(k, pa.int64()), "n_tokens": pa.nulls(k, pa.int64()), "known": pa.nulls(k, pa.int64()), "logs": pa.nulls(k, pa.float64()),
                        "part": pa.nulls(k, pa.int32()), "ids": pa.nulls(k, pa.binary()),
                    })

    return run


def _token_runs(batches, size: int):
    """(batch, number of the first row, ids, bounds by text) for runs of stored texts of about ``RUN`` ids."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column("ids").cast(pa.large_binary())
        ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        data, row = column.buffers()[2], 0
        while row < len(column):
            wide = np.dtype(_kept(size)).itemsize
            stop = max(row + 1, int(np.searchsorted(ends, ends[row] + RUN * wide, "right")) - 1)
            here = np.frombuffer(data, np.uint8)[ends[row] : ends[stop]] if data is not None else np.zeros(0, np.uint8)
            yield batch, row, here.copy().view(_kept(size)).astype(np.int32), (ends[row : stop + 1] - ends[row]) // wide
            row = stop


def _score(shared, size: int):
    def run(batches):
        scorer = shared.value
        for batch, row, tokens, bounds in _token_runs(batches, size):
            yield pa.record_batch({"row": batch.column("row").slice(row, len(bounds) - 1), "score": pa.array(scorer.scores(tokens, bounds))})

    return run


_PART = "id long, weight double, data binary"


def _part(ids: np.ndarray, weight: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
    rows = np.ascontiguousarray(rows, np.float32)
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * np.int32(4 * rows.shape[1])
    data = pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(rows)])
    return pa.record_batch({"id": pa.array(ids.astype(np.int64)), "weight": pa.array(weight.astype(float)), "data": data})


def _values(column, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, width)


def _summed(parts: DataFrame, size: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(weights, rows): sums by id over all tasks."""

    def add(table: pa.Table) -> pa.Table:
        ids, which = np.unique(table.column("id").to_numpy(), return_inverse=True)
        total = np.zeros((len(ids), width))
        np.add.at(total, which, _values(table.column("data"), width))
        return pa.Table.from_batches([_part(ids, np.bincount(which, weights=table.column("weight").to_numpy()), total)])

    weight, rows = np.zeros(size), np.zeros((size, width), np.float32)
    for r in parts.groupBy(F.col("id") % SUMS).applyInArrow(add, _PART).collect():  # a row for each id of the tokenizer
        weight[r["id"]] = r["weight"]
        rows[r["id"]] = np.frombuffer(r["data"], np.float32)
    return weight, rows


def _near(size: int):
    """Of each id how often it stands, and its neighbours."""

    def run(batches):
        near, times = np.zeros((size, 2 * SIDES), np.float32), np.zeros(size, np.int64)
        for _, _, tokens, bounds in _token_runs(batches, size):
            neighbours(near, tokens, bounds)
            times += np.bincount(tokens, minlength=size)
        seen = np.flatnonzero(times)
        for i in range(0, len(seen), 4096):
            some = seen[i : i + 4096]
            yield _part(some, times[some], near[some])

    return run


def _learn(shared, rate: float):
    """One task's parameters after its rows, times their weight."""

    def run(batches):
        model: Attention = shared.value
        model.p = {k: v.copy() for k, v in model.p.items()}
        start = model.rows()
        grids = (grid(tokens, bounds, model.size - 1, model.size - 2)[:3] for _, _, tokens, bounds in _token_runs(batches, model.size))
        met, tokens = model.fit(grids, rate)
        rows = model.rows()
        shared.value.put(start)  # other tasks of this worker start from the same
        weight = np.concatenate((met, np.full(len(rows) - model.size, tokens)))
        some = np.flatnonzero(weight)
        for i in range(0, len(some), 4096):
            at = some[i : i + 4096]
            yield _part(at, weight[at], rows[at] * weight[at, None])

    return run


def _texts(docs: DataFrame, path: str, size: int, frequent=None) -> DataFrame:
    """Texts with their ids, and their rare words, as written by ``_split``."""
    nothing = (np.zeros(0, np.uint64), np.zeros(0), None)
    return docs.mapInArrow(_split(docs.sparkSession.sparkContext.broadcast(frequent or nothing), path, size), _KIND)


def _parts(docs: DataFrame, training=None) -> DataFrame:
    """Texts with a number from 0 to 15, of which a round of the fit takes some; -1 where not to be learned."""
    part = F.pmod(F.xxhash64("doc_id", "text"), F.lit(16)).cast("int")
    return docs.select("doc_id", "text", (part if training is None else F.when(training, part).otherwise(F.lit(-1))).alias("part"))


def _fit(docs: DataFrame, path: str, words: int) -> Attention:
    """Train on all rows of ``docs``, texts or what ``_split`` made of them, which have ``words`` words."""
    size = _tokenizer(path).get_piece_size() + 2
    context = docs.sparkSession.sparkContext
    if "ids" not in docs.columns:
        docs = stored(_texts(_parts(docs), path, size), "ids")
    docs = docs.where("ids is not null and part >= 0").select("ids", "part")
    times, near = _summed(docs.mapInArrow(_near(size), _PART), size, 2 * SIDES)
    model = Attention(size, token_classes(near, times, size - 2))
    dealt = docs.coalesce(max(context.defaultParallelism, words // TASK_WORDS))
    again = min(10, -(-LEAST_WORDS // max(1, words)) - 1) if words else 0
    for low, high, rate in (*ROUNDS[:-1], *[(0, 16, ROUNDS[0][2])] * again, ROUNDS[-1]):
        shared = context.broadcast(model)
        some = dealt.where((F.col("part") >= low) & (F.col("part") < high))
        rows = model.rows()
        weight, total = _summed(some.mapInArrow(_learn(shared, rate), _PART), len(rows), WIDTH)
        met = weight > 0
        rows[met] = total[met] / weight[met, None]
        model.put(rows)
        shared.unpersist()
    return model


def _frequent(counts: DataFrame) -> list:
    """The words from some count on, as many as ``FREQUENT`` allows.

    The count is found from how many words each step of counts has, so that no task
    sends more than its share of them to the driver.
    """
    step = F.floor(F.log2("c") * 16).cast("int")
    sizes = {r["step"]: r["n"] for r in counts.groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect()}  # 16 for each doubling
    least, room = None, FREQUENT
    for at in sorted(sizes, reverse=True):
        room -= sizes[at]
        if room < 0:
            break
        least = at
    return [] if least is None else counts.where(step >= least).select("word", "c").collect()


def lm_scores(docs: DataFrame, training=None, tokenizer: str = TOKENIZER) -> DataFrame:
    """Score each text of ``docs`` (``doc_id``, ``text``).

    Training rows are those for which ``training`` (a condition; without one, all)
    holds. A text's tokens are its words (runs outside ASCII white space, A-Z
    lower-cased) and one end. Returns ``doc_id``, ``n_tokens``, ``n_known`` (tokens seen in training),
    ``train_tokens``, ``base_score`` (the sum of log10((c + 1) / (N + V + 1)) over
    the tokens: c the token's training count, N all, V distinct) and ``score`` (the
    attention model's log10 probability of the text's subwords and its end).

    A text that is NULL or empty is its end alone. Rows without doc_id, and repeated
    rows, are each scored. With no training rows all counts are 0 and the
    model is untrained. The model, not the counts, depends slightly on how rows are
    dealt over tasks. Other columns are ignored.
    """
    if training is not None:
        training = F.coalesce(training, F.lit(False))
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text)
    context, size = docs.sparkSession.sparkContext, _tokenizer(tokenizer).get_piece_size() + 2
    learned = docs if training is None else docs.where(training)
    counts = durable(learned.select("text").mapInArrow(_count_words, "word string, times long").groupBy("word").agg(F.sum("times").alias("c")))
    ends = learned.count()
    found = counts.agg(F.sum("c"), F.count("*")).first()
    total, distinct = (found[0] or 0) + ends, found[1] + (ends > 0)

    token_counts = np.zeros(size - 1)
    of = counts.mapInArrow(_count_tokens(tokenizer, size - 1), "token long, c long").groupBy("token").agg(F.sum("c").alias("c"))
    for row in of.collect():  # a row for each id of the tokenizer
        token_counts[row["token"]] = row["c"]
    token_counts[size - 2] = ends

    top = _frequent(counts)
    hashed = [words.hashes() for _, words in pieces(pa.array([r["word"] for r in top], pa.string()), SPACES)]
    hashed = np.concatenate(hashed) if hashed else np.zeros(0, np.uint64)
    order = np.argsort(hashed)
    weight = np.log10(np.array([r["c"] for r in top], float) + 1)
    frequent = (hashed[order], weight[order], np.log10(ends + 1) if ends else None)

    rows = stored(_texts(_parts(docs, training), tokenizer, size, frequent), "ids")  # texts are looked up once; the fit and the scores read their ids
    model = _fit(rows, tokenizer, total - ends)
    scores = rows.where("ids is not null").select("row", "ids").mapInArrow(_score(context.broadcast(model.freeze(token_counts)), size), "row long, score double")
    none = lambda kind: F.lit(None).cast(kind)
    texts = rows.where("ids is not null").select("row", "doc_id", "n_tokens", "known", "logs", none("double").alias("score"))
    scores = scores.select("row", none("long"), none("long"), none("long"), none("double"), "score")
    seen = rows.where("ids is null").select("row", "word", "times").join(counts, "word")
    seen = seen.select("row", none("long"), none("long"), "times", F.col("times") * F.log10(F.col("c") + 1), none("double"))
    out = texts.union(scores).union(seen).groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens"), F.sum("known").alias("n_known"), F.sum("logs").alias("logs"), F.max("score").alias("score"),
    )
    each = float(np.log10(total + distinct + 1))
    return out.select(
        "doc_id", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"),
        (F.col("logs") - F.col("n_tokens") * F.lit(each)).alias("base_score"), "score",
    )


def held_out(doc_id):
    """The rows that op10 doesn't learn from."""
    return remainder(doc_id, 7) == 2
