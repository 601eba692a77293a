"""URL filters: rules by host and path, and logistic regression on hashed character n-grams for the rest."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import grams

BUCKETS = 1 << 16
SIZES = (3, 4, 5)
ROUNDS = 800

#: (host and path, verdict) of the rules that always hold.
RULES = (
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
)
# Words in hosts and paths of unwanted sites, and of others; endings that both have, and those of the unwanted alone.
UNWANTED = (
    "casino", "jackpot", "slots", "poker", "betting", "roulette", "bonus", "viagra", "pills", "pharmacy-online", "no-prescription", "xxx", "adult", "porn",
    "escort", "cams", "sexy", "spam", "spam-farm", "ads", "ads-track", "adserver", "tracker", "click-here", "popunder", "win-prize", "free-iphone", "winner",
    "payday-loan", "fast-cash", "crypto-double", "get-rich", "replica", "cheap-rolex", "warez", "crack", "keygen", "torrent", "miracle", "lose-weight", "phishing", "verify-account",
)
WANTED = (
    "docs", "library", "guide", "cityhall", "news", "budget", "blog", "garden", "recipes", "kitchen", "university", "research", "papers", "museum", "collection",
    "wiki", "science", "physics", "travel", "mountains", "weather", "forecast", "forum", "bicycle", "history", "archive", "school", "courses", "algebra", "open-data",
    "rivers", "www", "m", "static", "about", "article", "city", "books", "health", "music", "theatre", "sports", "train", "address", "tracks", "adults", "example",
)
ENDINGS, SHADY = ("com", "org", "net", "edu", "gov", "info"), ("win", "bet", "click", "top", "cash", "biz", "xxx")
LANGUAGES = ("en", "de", "fr", "es")


def labelled_urls(rows: int = 1600, seed: int = 5) -> list[tuple[str, int]]:
    """A small labelled table (1 is to be blocked): every other row has an unwanted word in its host or path.

    The words stand beside wanted ones, numbers and languages, under all endings,
    so that neither an ending nor a lack of wanted words decides.
    """
    draw = np.random.default_rng(seed)
    pick = lambda words: words[int(draw.integers(len(words)))]
    made = []
    for row in range(rows):
        bad = row % 2
        syllables = "".join(pick(("th", "an", "re", "ti", "on", "he", "er", "in", "st", "la", "de", "que")) for _ in range(3))
        host = [pick((syllables, pick(WANTED))), pick((syllables, pick(WANTED)))]
        path = [pick(LANGUAGES), pick((pick(WANTED), str(int(draw.integers(1, 10_000)))))]
        if bad:
            word = UNWANTED[(row // 2) % len(UNWANTED)]
            where = int(draw.integers(3))
            if where < 2:
                host[where] = word if where else f"{word}{pick(('', '-online', '-' + pick(UNWANTED)))}"
            else:
                path[1] = word
        ending = pick(SHADY) if bad and draw.random() < 0.5 else pick(ENDINGS)
        made.append((f"{pick(('http', 'https'))}://{'.'.join(host)}.{ending}/{'/'.join(path)}", bad))
    return made


LABELLED = tuple(labelled_urls())

_A_TO_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parts(url: str | None) -> tuple[str, str]:
    """(host, path) of a URL; both empty if it is NULL or has no ``://``."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    rest = rest.partition("#")[0].partition("?")[0]
    host, slash, path = rest.partition("/")
    return host.translate(_A_TO_Z), slash + path


class Rules:
    """The longest rule that fits a host (or one of its parent domains) and the start of its path."""

    def __init__(self, rules):
        self.by_host: dict[str, list[tuple[str, str]]] = {}
        for rule, verdict in rules:
            host, _, path = rule.partition("/")
            self.by_host.setdefault(host, []).append(("/" + path, verdict))

    def match(self, host: str, path: str) -> tuple[str | None, str | None]:
        """Of two fitting rules as long as each other the one of the longer host wins, then the first given."""
        best, size = (None, None), (-1, -1)
        while host:
            for start, verdict in self.by_host.get(host, ()):
                if path.startswith(start) and (len(host) + len(start), len(host)) > size:
                    best, size = (host + start, verdict), (len(host) + len(start), len(host))
            host = host.partition(".")[2]
        return best


def _features(found: list[tuple[str, str]]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, number of the URL) of the n-grams of all hosts, then of all paths."""
    out = []
    for side, seed in ((0, 101), (1, 202)):
        texts = [pair[side].encode() for pair in found]
        ends = np.cumsum([len(x) for x in texts]).astype(np.int64)
        starts = np.concatenate(([0], ends[:-1])).astype(np.int64)
        out.append(grams(np.frombuffer(b"".join(texts), np.uint8), starts, ends, SIZES, BUCKETS, seed))
    return np.concatenate([b for b, _ in out]), np.concatenate([o for _, o in out])


class Model:
    """Logistic regression: the weights of a URL's n-grams over the root of their number, and a bias."""

    def __init__(self, weight: np.ndarray, bias: float):
        self.weight, self.bias = weight, bias

    def block(self, found: list[tuple[str, str]]) -> np.ndarray:
        """How likely each (host, path) is to be blocked."""
        if not found:
            return np.zeros(0)
        bucket, of = _features(found)
        total = np.bincount(of, weights=self.weight[bucket], minlength=len(found)) / np.sqrt(np.bincount(of, minlength=len(found)))
        return 1 / (1 + np.exp(-(total + self.bias)))


def fit(labelled=LABELLED, rate: float = 40.0, decay: float = 1e-4) -> Model:
    """Full-batch gradient descent; the table is a few hundred rows."""
    found, label = [parts(u) for u, _ in labelled], np.array([y for _, y in labelled], float)
    bucket, of = _features(found)
    share = 1 / np.sqrt(np.bincount(of, minlength=len(found)))[of]
    weight, bias = np.zeros(BUCKETS), 0.0
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-(np.bincount(of, weights=weight[bucket] * share, minlength=len(found)) + bias)))
        wrong = (p - label) / len(label)
        weight -= rate * (np.bincount(bucket, weights=wrong[of] * share, minlength=BUCKETS) + decay * weight)
        bias -= 0.1 * wrong.sum()
    return Model(weight, bias)


def errors(model: Model, labelled, threshold: float = 0.5) -> tuple[float, float]:
    """(share of wanted URLs that are blocked, share of unwanted ones that pass)."""
    label = np.array([y for _, y in labelled])
    blocked = model.block([parts(u) for u, _ in labelled]) >= threshold
    return float(blocked[label == 0].mean()), float((~blocked[label == 1]).mean())


def judge_urls(pages: DataFrame, rules=RULES, labelled=LABELLED, threshold: float = 0.5) -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule``, ``verdict``, ``score`` for each row of ``pages`` (``page_id``, ``url``).

    The verdict is that of the longest fitting rule, else ``block`` where the
    model's score (the chance of a block) is ``threshold`` or more, else ``allow``.
    A NULL URL, or one without ``://``, has an empty host and path, fits no rule, and
    is allowed with score 0. Repeated rows are each judged; other columns are
    ignored. ``rules`` and ``labelled`` are short lists that every task holds.
    """
    model, table = fit(labelled), Rules(rules)
    shared = pages.sparkSession.sparkContext.broadcast((model, table))

    def run(batches):
        for batch in batches:
            model, table = shared.value
            found = [parts(u) for u in batch.column("url").to_pylist()]
            ruled = [table.match(*pair) for pair in found]
            score = np.where([bool(h or p) for h, p in found], model.block(found), 0.0)
            verdict = [v or ("block" if s >= threshold else "allow") for (_, v), s in zip(ruled, score)]
            yield pa.record_batch({
                "page_id": batch.column("page_id"), "host": pa.array([h for h, _ in found], pa.string()), "path": pa.array([p for _, p in found], pa.string()),
                "rule": pa.array([r for r, _ in ruled], pa.string()), "verdict": pa.array(verdict, pa.string()), "score": pa.array(score, pa.float64()),
            })

    pages = pages.select("page_id", F.col("url").cast("string").alias("url"))
    return pages.mapInArrow(run, f"page_id {pages.schema['page_id'].dataType.simpleString()}, host string, path string, rule string, verdict string, score double")
