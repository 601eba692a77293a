"""A small causal self-attention language model in numpy, over subword ids.

One layer, one head. A token's query meets the keys of its window: the 16 tokens of its
own block up to itself, and the 16 before. The output is a class of the next
token; within its class a token is as likely as its corpus count says. Tables
of queries, keys and values by token make scoring a few small products.
"""

from __future__ import annotations

import numpy as np

BLOCK = 16
WIDTH = 16
CLASSES = 32
_FUTURE = np.float32(-1e9)


def grid(tokens: np.ndarray, bounds: np.ndarray, start: int, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lay texts out in blocks: (window ids, next tokens, is scored, text of each block).

    A window is a block and the one before it, so windows overlap by a block and
    each token, and each text's end, is scored in one. ``start`` fills what lies
    before a text (and, unscored, behind it).
    """
    sizes = np.diff(bounds) + 1
    blocks = -(-sizes // BLOCK)
    first = np.concatenate(([0], np.cumsum(blocks)))
    text = np.repeat(np.arange(len(sizes)), blocks)
    cells = np.full(first[-1] * BLOCK, start, np.int32)
    target = np.full(first[-1] * BLOCK, end, np.int32)
    scored = np.zeros(first[-1] * BLOCK, bool)
    count = sizes - 1
    place = np.repeat(first[:-1] * BLOCK - bounds[:-1], count) + np.arange(len(tokens))
    cells[place + 1] = tokens
    target[place] = tokens
    run = np.repeat(first[:-1] * BLOCK - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(sizes.sum())
    scored[run] = True
    own = cells.reshape(-1, BLOCK)
    before = np.full_like(own, start)
    before[1:] = own[:-1]
    before[first[:-1]] = start
    return np.concatenate((before, own), axis=1), target.reshape(-1, BLOCK), scored.reshape(-1, BLOCK), text


#: Exponents up to which, and sums from which, exp needs no shift in single precision.
_HIGHEST, _LEAST = 60, 1e-30


def _exponents(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray | float]:
    """(exp(x - shift), its sums over the last axis, shift); the shift is 0 where that will do."""
    flat, ones = x.reshape(-1, x.shape[-1]), np.ones(x.shape[-1], x.dtype)
    if x.size and x.max() < _HIGHEST:
        found = np.exp(flat)
        sums = found @ ones
        if sums.min() > _LEAST:
            return found.reshape(x.shape), sums.reshape(x.shape[:-1]), 0.0
    shift = x.max(axis=-1)
    found = np.exp(flat - shift.reshape(-1, 1))
    return found.reshape(x.shape), (found @ ones).reshape(x.shape[:-1]), shift


def _softmax(x: np.ndarray) -> np.ndarray:
    found, sums, _ = _exponents(x)
    found /= sums[..., None]
    return found


def _sums(at: np.ndarray, rows: np.ndarray, count: int) -> np.ndarray:
    """Sums of the rows (``WIDTH`` wide) that stand at each of ``count`` places."""
    cells = at.reshape(-1, 1) * WIDTH + np.arange(WIDTH)
    return np.bincount(cells.reshape(-1), weights=rows.reshape(-1), minlength=count * WIDTH).reshape(count, WIDTH).astype(rows.dtype)


#: What each token of a block may not see of its window.
_MASK = np.where(np.arange(2 * BLOCK)[None, :] > BLOCK + np.arange(BLOCK)[:, None], _FUTURE, np.float32(0))


#: Neighbours of an id are counted in so many buckets on either side.
SIDES = 96


def neighbours(near: np.ndarray, tokens: np.ndarray, bounds: np.ndarray, seed: int = 3) -> None:
    """Add the neighbours of each id within its text to ``near`` (size, 2 * SIDES)."""
    size = len(near)
    fold = np.random.default_rng(seed).integers(0, SIDES, size)
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    inner = np.flatnonzero(owner[1:] == owner[:-1])
    left, right = tokens[inner].astype(np.int64), tokens[inner + 1].astype(np.int64)
    flat = near.reshape(-1)  # a view
    np.add.at(flat, right * (2 * SIDES) + fold[left], np.float32(1))
    np.add.at(flat, left * (2 * SIDES) + (SIDES + fold[right]), np.float32(1))


def token_classes(near: np.ndarray, times: np.ndarray, end: int) -> np.ndarray:
    """Group ids by their neighbours (k-means); ids that never stand share a class, and so does ``end``."""
    size = len(near)
    seen = np.flatnonzero(times > 0)
    seen = seen[seen != end]
    out = np.full(size, CLASSES - 2)
    out[end] = CLASSES - 1
    groups = min(CLASSES - 2, len(seen))
    if groups:
        points = np.sqrt(near[seen])
        points /= np.linalg.norm(points, axis=1, keepdims=True) + 1e-6
        weight = np.sqrt(times[seen])
        centres = points[np.argsort(-times[seen], kind="stable")[:groups]].copy()
        for _ in range(12):
            nearest = (points @ centres.T).argmax(axis=1)
            for g in range(groups):
                if (own := nearest == g).any():
                    centres[g] = (points[own] * weight[own, None]).sum(axis=0)
                    centres[g] /= np.linalg.norm(centres[g]) + 1e-6
        out[seen] = nearest
    return out.astype(np.int32)


class Attention:
    """Parameters, and the tables made of them for scoring. ``size`` ids; the last is the start, the one before the end."""

    def __init__(self, size: int, classes: np.ndarray, seed: int = 7):
        draw = np.random.default_rng(seed)
        small = lambda *shape: draw.normal(0, 0.1, shape).astype(np.float32)
        self.size, self.classes = size, classes
        self.p = {
            "embed": small(size, WIDTH), "query": small(WIDTH, WIDTH), "key": small(WIDTH, WIDTH), "value": small(WIDTH, WIDTH),
            "near": np.zeros((BLOCK, 2 * BLOCK), np.float32), "out": small(WIDTH, CLASSES), "bias": np.zeros(CLASSES, np.float32),
        }

    def _slopes(self, window: np.ndarray, target: np.ndarray, scored: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, dict[str, np.ndarray]]:
        """(mean loss of the scored tokens' classes, ids met, slopes of their embeddings, slopes of the rest).

        Queries, keys and values are made once for each distinct id.
        """
        p, scale, count = self.p, np.float32(WIDTH**-0.5), len(window)
        met = np.zeros(self.size, bool)
        met[window] = True
        ids = np.flatnonzero(met)
        place = np.empty(self.size, np.int64)
        place[ids] = np.arange(len(ids))
        at = place[window]
        embed, both = p["embed"][ids], np.concatenate((p["key"], p["value"]), axis=1)
        tokens = np.take(embed, at, axis=0)
        own = np.ascontiguousarray(tokens[:, BLOCK:])
        keyed = np.take(embed @ both, at, axis=0)
        k, v = keyed[..., :WIDTH], keyed[..., WIDTH:]
        q = np.take(embed @ p["query"] * scale, at[:, BLOCK:], axis=0)
        weights = q @ k.transpose(0, 2, 1)
        weights += p["near"] + _MASK
        weights = _softmax(weights)
        taken = weights @ v
        mixed = (own + taken).reshape(-1, WIDTH)
        logit = mixed @ p["out"]
        logit += p["bias"]
        chance = _softmax(logit)
        cell = np.arange(0, chance.size, CLASSES) + self.classes[target].reshape(-1)
        part = scored.reshape(-1) / np.float32(max(1, scored.sum()))
        loss = float(-(np.log(chance.reshape(-1)[cell] + 1e-30) * part).sum())
        d_logit = chance
        d_logit.reshape(-1)[cell] -= 1
        d_logit *= part[:, None]
        d_mixed = (d_logit @ p["out"].T).reshape(count, BLOCK, WIDTH)
        d_score = d_mixed @ v.transpose(0, 2, 1)
        d_score -= np.einsum("bij,bij->bi", d_mixed, taken)[..., None]
        d_score *= weights
        d_q = (d_score @ k).reshape(-1, WIDTH)
        d_q *= scale
        d_keyed = np.empty_like(keyed)
        np.matmul(d_score.transpose(0, 2, 1), q, out=d_keyed[..., :WIDTH])
        np.matmul(weights.transpose(0, 2, 1), d_mixed, out=d_keyed[..., WIDTH:])
        d_keyed = d_keyed.reshape(-1, 2 * WIDTH)
        d_tokens = (d_keyed @ both.T).reshape(tokens.shape)
        d_tokens[:, BLOCK:] += d_mixed
        d_tokens[:, BLOCK:] += (d_q @ p["query"].T).reshape(own.shape)
        d_both = tokens.reshape(-1, WIDTH).T @ d_keyed
        return loss, ids, _sums(at, d_tokens, len(ids)), {
            "query": own.reshape(-1, WIDTH).T @ d_q, "key": d_both[:, :WIDTH], "value": d_both[:, WIDTH:],
            "near": d_score.sum(axis=0), "out": mixed.T @ d_logit, "bias": d_logit.sum(axis=0),
        }

    def gradients(self, window: np.ndarray, target: np.ndarray, scored: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss of the scored tokens' classes, and its slopes."""
        loss, ids, rows, slopes = self._slopes(window, target, scored)
        embed = np.zeros_like(self.p["embed"])
        embed[ids] = rows
        return loss, {"embed": embed, **slopes}

    def fit(self, windows, rate: float, batch: int = 256, seed: int = 9) -> tuple[np.ndarray, int]:
        """Adam over batches of the windows that ``windows`` hands out; returns how often each id was met, and the scored tokens.

        An embedding, and what Adam keeps of it, changes in the batches that meet its id.
        """
        draw, step = np.random.default_rng(seed), 0
        met, tokens = np.zeros(self.size, np.int64), 0
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}

        def moved(one, two, slope, speed):
            one += np.float32(0.1) * (slope - one)
            two += np.float32(0.01) * (slope * slope - two)
            return np.float32(speed) * one / (np.sqrt(two) + np.float32(1e-6))

        for window, target, scored in windows:
            met += np.bincount(window.reshape(-1), minlength=self.size)
            tokens += int(scored.sum())
            for pick in np.array_split(draw.permutation(len(window)), max(1, -(-len(window) // batch))):
                _, ids, rows, slopes = self._slopes(window[pick], target[pick], scored[pick])
                step += 1
                speed = rate * np.sqrt(1 - 0.99**step) / (1 - 0.9**step)
                one, two = first["embed"][ids], second["embed"][ids]
                self.p["embed"][ids] -= moved(one, two, rows, speed)
                first["embed"][ids], second["embed"][ids] = one, two
                for name, slope in slopes.items():
                    self.p[name] -= moved(first[name], second[name], slope, speed)
        return met, tokens

    def rows(self) -> np.ndarray:
        """All parameters as rows of ``WIDTH``: the embeddings by id, then the others."""
        return np.concatenate([self.p["embed"], np.concatenate([v.reshape(-1) for k, v in self.p.items() if k != "embed"]).reshape(-1, WIDTH)])

    def put(self, rows: np.ndarray) -> None:
        self.p["embed"] = rows[: self.size].astype(np.float32)
        rest, at = rows[self.size :].reshape(-1).astype(np.float32), 0
        for name, value in self.p.items():
            if name != "embed":
                self.p[name] = rest[at : at + value.size].reshape(value.shape).copy()
                at += value.size

    def freeze(self, counts: np.ndarray) -> "Scorer":
        """Tables for scoring; ``counts`` of all ids in the corpus."""
        p, scale = self.p, np.float32(WIDTH**-0.5)
        within = np.bincount(self.classes[: self.size - 1], weights=counts + 1, minlength=CLASSES)
        share = np.zeros(self.size)
        share[:-1] = np.log10((counts + 1) / within[self.classes[: self.size - 1]])
        return Scorer(p["embed"] @ p["query"] * scale, p["embed"] @ np.concatenate((p["key"], p["value"]), axis=1), p["embed"], p["near"] + _MASK, p["out"], p["bias"], self.classes, share)


class Scorer:
    def __init__(self, query, keyed, embed, near, out, bias, classes, share):
        self.query, self.keyed, self.embed = query, keyed, embed
        self.near, self.out, self.bias, self.classes, self.share = near, out, bias, classes, share

    def scores(self, tokens: np.ndarray, bounds: np.ndarray, step: int = 256) -> np.ndarray:
        """log10 probability of each text, its end included."""
        size = len(self.classes)
        window, target, scored, text = grid(tokens, bounds, size - 1, size - 2)
        found = np.empty(len(window))
        for i in range(0, len(window), step):
            ids, wanted = window[i : i + step], target[i : i + step].reshape(-1)
            own = ids[:, BLOCK:]
            keyed = np.take(self.keyed, ids, axis=0)
            weights = np.matmul(np.take(self.query, own, axis=0), keyed[..., :WIDTH].transpose(0, 2, 1))
            weights += self.near
            weights, sums, _ = _exponents(weights)
            mixed = np.matmul(weights, keyed[..., WIDTH:])
            mixed /= sums[..., None]
            mixed += np.take(self.embed, own, axis=0)
            logit = mixed.reshape(-1, WIDTH) @ self.out
            logit += self.bias
            picked = logit.reshape(-1)[np.arange(0, logit.size, CLASSES) + self.classes[wanted]]
            _, sums, shift = _exponents(logit)
            log = (picked - shift - np.log(sums)) / np.float32(np.log(10)) + self.share[wanted]
            found[i : i + step] = np.where(scored[i : i + step], log.reshape(-1, BLOCK), 0).sum(axis=1)
        return np.bincount(text, weights=found, minlength=len(bounds) - 1)
