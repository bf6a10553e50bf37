"""Quality by supervised subword embeddings: hashed word and character n-gram vectors, averaged and classified."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import DoubleType, StructType

from tallyshop.llm.common import fit_in_task, map_rows, training_sample

HOLDOUT, LEFT_OUT = 3, 1
PER_LABEL = 2000  # labelled documents of each label that a model is fitted on, at most
BUCKET_BITS, DIMENSIONS = 18, 16
NGRAMS = (3, 4, 5)
CHUNK = 1 << 18  # code points hashed at a time
BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2^64
SPREAD = np.uint64(0xD6E8FEB86659FD93)
SAME_WORD = np.uint64(0x243F6A8885A308D3)  # the bigram of a word and itself, whatever the word


def _powers(base: int, count: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        steps = np.full(count, base, dtype=np.uint64)
        steps[0] = 1
        return np.multiply.accumulate(steps)


class Features:
    """Bucket numbers of the features of texts: words, word pairs and character n-grams inside words."""

    def __init__(self):
        self.up = _powers(int(BASE), CHUNK + 1)
        self.down = _powers(pow(int(BASE), -1, 1 << 64), CHUNK + 1)

    @staticmethod
    def _bucket(hashes: np.ndarray, salt: int) -> np.ndarray:
        mixed = (hashes ^ (hashes >> np.uint64(31)) ^ np.uint64(salt * 0x51ED27)) * SPREAD
        return (mixed >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)

    def of(self, points: np.ndarray, previous: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Buckets of one run of code points that ends between words, and the hash of its last word.

        ``previous`` is the hash of the word before, so that pairs across runs count.
        """
        points = points.astype(np.uint64)
        space = (points == 32) | ((points >= 9) & (points <= 13))
        found = []
        codes = (np.where(space, np.uint64(32), points) + np.uint64(1)) * SPREAD
        grams = codes.copy()
        for n in range(2, max(NGRAMS) + 1):
            if len(points) < n:
                break
            grams = grams[:-1] * BASE + codes[n - 1 :]
            if n in NGRAMS:
                inside = np.ones(len(grams), dtype=bool)
                for k in range(1, n - 1):
                    inside &= ~space[k : k + len(grams)]
                found.append(self._bucket(grams[inside], n))
        edges = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]]).astype(np.int8)))
        starts, ends = edges[::2], edges[1::2]
        sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(codes * self.up[: len(codes)], dtype=np.uint64)])
        words = (sums[ends] - sums[starts]) * self.down[starts]
        if not len(words):
            return np.concatenate(found) if found else np.zeros(0, dtype=np.int64), previous
        found.append(self._bucket(words, 1))
        before = words if previous is None else np.concatenate([previous, words])
        first, second = before[:-1], before[1:]
        found.append(self._bucket(np.where(first == second, SAME_WORD, first * BASE + second), 2))
        return np.concatenate(found), words[-1:]

    def runs(self, text: str) -> Iterator[np.ndarray]:
        """The features of a whole text, a bounded number at a time."""
        with np.errstate(over="ignore"):
            points = np.frombuffer(f" {text} ".encode("utf-32-le", "surrogatepass"), dtype="<u4")
            start, previous = 0, None
            while start < len(points):
                end = min(start + CHUNK, len(points))
                if end < len(points):
                    tail = points[start:end]
                    breaks = np.flatnonzero((tail == 32) | ((tail >= 9) & (tail <= 13)))
                    if len(breaks) and breaks[-1]:
                        end = start + int(breaks[-1]) + 1  # the next run begins with this space again
                buckets, previous = self.of(points[start:end], previous)
                yield buckets
                if end == len(points):
                    break
                start = end - 1 if points[end - 1] == 32 or 9 <= points[end - 1] <= 13 else end


def _bag(features: Features, text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and their shares."""
    runs = list(features.runs(text))
    ids, counts = np.unique(np.concatenate(runs), return_counts=True)
    return ids, (counts / max(1, counts.sum())).astype(np.float32)


def fit(texts: list[str], labels: list[int], sizes: dict[int, int], epochs: int = 5, rate: float = 5.0, seed: int = 7) -> dict | None:
    """Embeddings and softmax weights by stochastic gradient descent, one document a step; None without both labels.

    The rate falls linearly to zero; documents come in a seeded random order, labels equally often.
    """
    marks = np.asarray(labels)
    places = [np.flatnonzero(marks == label) for label in (0, 1)]
    if not all(map(len, places)):
        return None
    features, random = Features(), np.random.default_rng(seed)
    bags = [_bag(features, t) for t in texts]
    vectors = random.uniform(-1, 1, (1 << BUCKET_BITS, DIMENSIONS)).astype(np.float32) / DIMENSIONS
    output = np.zeros((2, DIMENSIONS + 1), dtype=np.float32)
    steps = epochs * 2 * max(map(len, places))
    for step in range(steps):
        label = step % 2
        ids, shares = bags[random.choice(places[label])]
        if not len(ids):
            continue
        hidden = shares @ vectors[ids]
        scores = output[:, :-1] @ hidden + output[:, -1]
        shown = np.exp(scores - scores.max())
        error = shown / shown.sum()
        error[label] -= 1
        pace = np.float32(rate * (1 - step / steps))
        back = output[:, :-1].T @ error
        output[:, :-1] -= pace * np.outer(error, hidden)
        output[:, -1] -= 0.1 * pace * error
        vectors[ids] -= pace * shares[:, None] * back
    away = output[1] - output[0]
    return {"buckets": (vectors @ away[:-1]).astype(np.float32), "bias": float(away[-1])}


def _scorer(model: dict | None):
    """The score of a text: the softmax of an average is that of a sum of numbers, one per bucket."""
    if model is None:
        return lambda text: 0.5
    features, table = Features(), model["buckets"]

    def score(text: str) -> float:
        total = count = 0.0
        for buckets in features.runs(text):
            total += float(table[buckets].sum(dtype=np.float64))
            count += len(buckets)
        return float(1 / (1 + np.exp(-np.clip(model["bias"] + total / max(1.0, count), -30, 30))))

    return score


def learn(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> dict | None:
    """A model from at most ``per_label`` labelled documents of each label, outside the held-out third of the ids."""
    return fit_in_task(training_sample(docs, labels, "quality", HOLDOUT, LEFT_OUT, per_label), fit)


def score(docs: DataFrame, model: dict | None) -> DataFrame:
    """All rows and columns of ``docs`` with ``quality_score``, a double from 0 to 1, from the whole text alone.

    A null or empty text has no feature and gets the score of the intercept; without a model (no labelled rows of
    both kinds) every score is 0.5. Nulls in other columns and repeated rows pass through; a column already named
    ``quality_score`` is replaced.
    """
    docs = docs.drop("quality_score")
    at = docs.columns.index("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(model)
        for batch in batches:
            scores = [scorer(t or "") for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, "quality_score"])

    return map_rows(docs, work, StructType([*docs.schema.fields]).add("quality_score", DoubleType()))
