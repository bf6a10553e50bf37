"""Toxicity by compression distance: two zstandard dictionaries compress every window of a text."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import DoubleType, StructType

from tallyshop.llm.common import fit_in_task, map_rows, training_sample, unrepeated

HOLDOUT, LEFT_OUT = 5, 0
PER_LABEL = 3000  # labelled documents of each label that a model is fitted on, at most
DICTIONARY_BYTES = 1 << 17
WINDOW_CHARS = 24
MOST_COST = 31
FOLDS = 4
LIFT, DEVIATIONS = 5, 3
MEMO_ENTRIES = 150_000
# Both dictionaries begin with this text, and so does each window: then a block is never stored raw.
LEAD_IN = "0123456789abcdefghijklmnopqrstuvwxyz"


def windows(text: str) -> set[str]:
    """The distinct lower-cased words of a text, each one window; longer words count in slices of 24 characters."""
    found = set(text.lower().split())
    for word in [w for w in found if len(w) > WINDOW_CHARS]:
        found.discard(word)
        found.update(word[i : i + WINDOW_CHARS] for i in range(0, len(word), WINDOW_CHARS))
    return found


def _bytes(window: str) -> bytes:
    # Two bytes a character: a match saves more than its own few bytes even for short words.
    return f" {window} ".encode("utf-16-le", "surrogatepass")


def _dictionary(documents: Counter) -> bytes:
    """Raw dictionary content: windows of at least two documents, the most frequent last, where zstandard looks first.

    The library's own trainer samples segments and loses rare windows, so the content is chosen here.
    """
    ranked = sorted((w for w, n in documents.items() if n > 1), key=lambda w: (documents[w], w))
    return LEAD_IN.encode("utf-16-le") + b"".join(map(_bytes, ranked))[-DICTIONARY_BYTES:]


class Costs(dict):
    """Window -> cell: its compressed length under the ordinary and the toxic dictionary, beyond that of the lead-in."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        import zstandard

        super().__init__()
        self.lead = LEAD_IN.encode("utf-16-le")
        parameters = zstandard.ZstdCompressionParameters(
            window_log=18, chain_log=17, hash_log=17, search_log=7, min_match=5, target_length=64,
            strategy=zstandard.STRATEGY_BTLAZY2, write_content_size=False, write_checksum=False, write_dict_id=False,
            format=zstandard.FORMAT_ZSTD1_MAGICLESS,
        )
        raw = zstandard.DICT_TYPE_RAWCONTENT
        self.compress = [
            zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d, dict_type=raw), compression_params=parameters).compress
            for d in (ordinary, toxic)
        ]
        self.base = [len(c(self.lead)) for c in self.compress]

    def __missing__(self, window: str) -> int:
        if len(self) >= MEMO_ENTRIES:
            self.clear()
        data = self.lead + _bytes(window)
        a, b = (min(MOST_COST, max(0, len(c(data)) - base)) for c, base in zip(self.compress, self.base, strict=True))
        cell = self[window] = a * (MOST_COST + 1) + b
        return cell


CELLS = (MOST_COST + 1) ** 2


def _design(sums: np.ndarray) -> np.ndarray:
    """Columns of the document model from (strong windows, windows, evidence of the strong, distinct windows)."""
    strong, likely, evidence, total = sums.T
    return np.stack([
        np.log1p(strong), np.log1p(likely), np.log1p(evidence), np.log1p(total), (strong + 0.1) / (total + 20), np.minimum(strong, 3),
        np.ones(len(sums)),
    ], axis=1)


def _sums(each: np.ndarray) -> tuple:
    """What the document model sees of the evidence of each distinct window."""
    likely = each[each >= 2]
    return (each >= 3).sum(), len(likely), likely.sum(), len(each)


def _logistic(rows: np.ndarray, labels: np.ndarray, counts: np.ndarray, ridge: float = 0.01, rounds: int = 60) -> np.ndarray:
    """Ridge logistic regression by Newton steps; a row counts ``counts`` times."""
    weights = np.zeros(rows.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(rows @ weights, -30, 30)))
        curve = (rows * (counts * p * (1 - p))[:, None]).T @ rows + ridge * np.eye(len(weights))
        step = np.linalg.solve(curve, rows.T @ (counts * (p - labels)) + ridge * weights)
        weights -= step
        if np.abs(step).max() < 1e-8:
            break
    return weights


def _dictionaries(texts: list[str], labels: list[int]) -> tuple[bytes, bytes]:
    """Ordinary and toxic dictionary.

    A window belongs to the toxic one if toxic documents have it ``LIFT`` times as often as the ordinary ones let
    expect, and by at least ``DEVIATIONS`` standard deviations more.
    """
    seen = [Counter(), Counter()]
    for text, label in zip(texts, labels, strict=True):
        seen[label].update(windows(text))
    ratio = sum(labels) / (len(labels) - sum(labels))
    expected = {w: (seen[0][w] + 1) * ratio for w in seen[1]}
    toxic = Counter({w: n for w, n in seen[1].items() if n >= LIFT * expected[w] and n - expected[w] >= DEVIATIONS * (expected[w] + 1) ** 0.5})
    return _dictionary(Counter({w: n for w, n in seen[0].items() if w not in toxic})), _dictionary(toxic)


def fit(texts: list[str], labels: list[int], sizes: dict[int, int]) -> dict | None:
    """Dictionaries from the sample and thresholds calibrated on it; None if it has fewer than ``FOLDS`` of a label.

    Near copies of an earlier text are left out.

    Costs are calibrated across folds: those of a fold come from dictionaries of the other folds. The log ratio of a
    cell's share in toxic and in ordinary documents is the evidence of a window; a logistic model of a document's
    evidence sets its threshold, each label weighing as much as ``sizes`` says it does in all rows. The final dictionaries come from the whole sample.
    """
    own = unrepeated(texts)
    texts, marks = [texts[i] for i in own], np.asarray(labels, dtype=int)[own]
    places = [np.flatnonzero(marks == label) for label in (0, 1)]
    if min(map(len, places)) < FOLDS:
        return None
    fold = np.zeros(len(marks), dtype=int)
    for own in places:
        fold[own] = np.arange(len(own)) % FOLDS
    counts, cells = np.zeros((2, CELLS)), {}
    for k in range(FOLDS):
        rest = np.flatnonzero(fold != k)
        costs = Costs(*_dictionaries([texts[i] for i in rest], marks[rest].tolist()))
        for i in np.flatnonzero(fold == k):
            cells[i] = np.array([costs[w] for w in windows(texts[i])], dtype=np.int16)
            counts[marks[i]] += np.bincount(cells[i], minlength=CELLS)
    share = (counts + 0.5) / np.maximum(counts.sum(1, keepdims=True), 1)
    evidence = np.where(counts.sum(0) > 0, np.log(share[1] / share[0]), 0.0)
    sums = np.array([_sums(evidence[cells[i]]) for i in range(len(marks))], dtype=float)
    counts_as = np.array([sizes[label] / len(places[label]) for label in (0, 1)])
    ordinary, toxic = _dictionaries(texts, marks.tolist())
    return {"ordinary": ordinary, "toxic": toxic, "evidence": evidence, "weights": _logistic(_design(sums), marks, counts_as[marks])}


def _scorer(model: dict | None):
    if model is None:
        return lambda texts: np.zeros(len(texts))
    costs = Costs(model["ordinary"], model["toxic"])

    def score(texts: list[str]) -> np.ndarray:
        cells = [np.array([costs[w] for w in windows(t)], dtype=int) for t in texts]
        sums = np.array([_sums(model["evidence"][c]) for c in cells], dtype=float).reshape(-1, 4)
        return 1 / (1 + np.exp(-np.clip(_design(sums) @ model["weights"], -30, 30)))

    return score


def learn(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> dict | None:
    """A model from at most ``per_label`` labelled documents of each label, outside the held-out fifth of the ids."""
    return fit_in_task(training_sample(docs, labels, "toxic", HOLDOUT, LEFT_OUT, per_label), fit)


def score(docs: DataFrame, model: dict | None) -> DataFrame:
    """All rows and columns of ``docs`` with ``toxicity``, a double from 0 to 1, from the whole text alone.

    Every window is compressed with both dictionaries; windows that the toxic one holds and the ordinary one lacks
    are the evidence. A null or empty text has no window and gets the score of the intercept; without a model (no
    labelled rows of both kinds) every score is 0. Nulls in other columns and repeated rows pass through; a
    column already named ``toxicity`` is replaced.
    """
    docs = docs.drop("toxicity")
    at = docs.columns.index("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(model)
        for batch in batches:
            scores = scorer([t or "" for t in batch.column(at).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, "toxicity"])

    return map_rows(docs, work, StructType([*docs.schema.fields]).add("toxicity", DoubleType()))
