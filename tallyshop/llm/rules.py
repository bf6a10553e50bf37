"""Quality rules: counts per document and language-specific bands of n-gram perplexity."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructType

from tallyshop.llm.common import map_rows, staged

ORDER = 4  # the most that ``_packed`` allows for: a code point has 21 bits, and all but the last one go into 64
POINT_BITS = 21
START = "\x02"
RUN = 1 << 18  # code points scored or counted at a time
FLUSH = 1 << 19  # distinct n-grams that a counting task holds before it passes them on
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\v\f\r"
WINDOW = 8
BASE = np.uint64(0x9E3779B97F4A7C15)
SPREAD = np.uint64(0xD6E8FEB86659FD93)
UNKNOWN = "und"
_SPACE = re.compile(r"\s+")


def language(lang: Column) -> Column:
    """The language that bands and models are kept for; null and empty count as one."""
    return F.coalesce(F.when(lang == "", None).otherwise(lang), F.lit(UNKNOWN))


# --- counts per document ---------------------------------------------------------------------------------------------


def _repeated(words: list[bytes]) -> int:
    """How many words lie in windows of 8 words that occur at least twice."""
    if len(words) <= WINDOW:
        return 0
    with np.errstate(over="ignore"):
        codes = np.fromiter(map(hash, words), dtype=np.int64, count=len(words)).view(np.uint64) * SPREAD
        count = len(words) - WINDOW + 1
        windows = np.zeros(count, dtype=np.uint64)
        for j in range(WINDOW):
            windows = windows * BASE + codes[j : j + count]
    order = np.argsort(windows, kind="stable")
    same = windows[order[1:]] == windows[order[:-1]]
    starts = np.unique(np.concatenate([order[1:][same], order[:-1][same]]))
    if not len(starts):
        return 0
    cover = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + WINDOW, -1)
    return int((np.cumsum(cover)[:-1] > 0).sum())


def text_counts(text: str) -> tuple[int, int, int, int, int]:
    """(words, characters in words, symbols, repeated lines, words in repeated windows) of a text."""
    words = text.encode("utf-8", "surrogatepass").split()
    lines = [line for line in text.split("\n") if line.strip(SPACES)]
    return (
        len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), _repeated(words),
    )


# --- the language model ----------------------------------------------------------------------------------------------


def _points(text: str) -> np.ndarray:
    return np.frombuffer((START * (ORDER - 1) + _SPACE.sub(" ", text).strip()).encode("utf-32-le", "surrogatepass"), dtype="<u4")


def _hashes(points: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` code points that begin at each position."""
    codes = (points.astype(np.uint64) + np.uint64(1)) * SPREAD
    count = max(0, len(points) - n + 1)
    out = np.zeros(count, dtype=np.uint64)
    for j in range(n):
        out = out * BASE + codes[j : j + count]
    return out


def _packed(points: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` code points that begin at each position (less than ``ORDER``) as one number."""
    codes = points.astype(np.int64)
    count = max(0, len(points) - n + 1)
    out = np.zeros(count, dtype=np.int64)
    for j in range(n):
        out = out << POINT_BITS | codes[j : j + count]
    return out


def _runs(points: np.ndarray) -> Iterator[np.ndarray]:
    """Parts of at most ``RUN`` points; each begins with the last ``ORDER - 1`` points of the one before."""
    for start in range(0, max(1, len(points) - ORDER + 1), RUN - ORDER + 1):
        yield points[start : start + RUN]


class _Tally:
    """Distinct n-grams of one language with their counts, as arrays."""

    def __init__(self):
        self.parts, self.size = [], 0

    def add(self, points: np.ndarray, ends: list[int]) -> None:
        """Count the n-grams of joined runs; ``ends`` are the positions where runs end, which no n-gram crosses."""
        hashes = _hashes(points, ORDER)
        inside = np.ones(len(hashes), dtype=bool)
        for end in ends:
            inside[max(0, end - ORDER + 1) : end] = False
        at = np.flatnonzero(inside)
        keys, first, counts = np.unique(hashes[at], return_index=True, return_counts=True)
        where = at[first]
        self.parts.append((keys, np.stack([points[where + j] for j in range(ORDER)], axis=1), counts))
        self.size += len(keys)
        if len(self.parts) >= 16:
            self.merge()

    def merge(self) -> None:
        if len(self.parts) > 1:
            keys, rows, counts = (np.concatenate(x) for x in zip(*self.parts, strict=True))
            keys, first, back = np.unique(keys, return_index=True, return_inverse=True)
            self.parts = [(keys, rows[first], np.bincount(back, weights=counts).astype(np.int64))]
            self.size = len(keys)

    def batches(self, lang: str) -> Iterator[pa.RecordBatch]:
        self.merge()
        for _, rows, counts in self.parts:
            for low in range(0, len(rows), 65536):
                text = rows[low : low + 65536].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
                grams = [text[i : i + ORDER] for i in range(0, len(text), ORDER)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(grams)), pa.array(grams), pa.array(counts[low : low + 65536], pa.int64())], names=["lang", "gram", "n"]
                )
        self.parts, self.size = [], 0


def _joined(items: Iterator[tuple[str, int, str]]) -> Iterator[tuple[str, np.ndarray, list[int], list[int]]]:
    """(language, joined runs, where each ends, the row each belongs to) from (language, row, text), up to ``RUN`` points."""
    waiting: dict[str, tuple[list, list]] = {}
    for lang, row, text in items:
        for run in _runs(_points(text)):
            parts, rows = waiting.setdefault(lang, ([], []))
            if parts and sum(map(len, parts)) + len(run) > RUN:
                yield lang, np.concatenate(parts), np.cumsum([len(p) for p in parts]).tolist(), rows
                parts, rows = waiting[lang] = ([], [])
            parts.append(run)
            rows.append(row)
    for lang, (parts, rows) in waiting.items():
        yield lang, np.concatenate(parts), np.cumsum([len(p) for p in parts]).tolist(), rows


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tallies: dict[str, _Tally] = {}
    with np.errstate(over="ignore"):
        for batch in batches:
            rows = zip(batch.column(0).to_pylist(), range(len(batch)), batch.column(1).to_pylist(), strict=True)
            for lang, points, ends, _ in _joined((lang, i, text) for lang, i, text in rows if text):
                tally = tallies.setdefault(lang, _Tally())
                tally.add(points, ends)
                if sum(t.size for t in tallies.values()) > FLUSH:
                    for name, full in tallies.items():
                        yield from full.batches(name)
        for name, full in tallies.items():
            yield from full.batches(name)


def gram_counts(docs: DataFrame) -> DataFrame:
    """(lang, gram, n): how often each sequence of ``ORDER`` characters occurs, over the whole texts of all rows."""
    rows = docs.select(language(F.col("lang")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    return map_rows(rows, _count, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _discounts(levels: DataFrame) -> DataFrame:
    """Modified Kneser-Ney discounts per language and order, from how many n-grams have counts 1 to 4."""
    counts = [F.sum((F.col("n") == i).cast("double")).alias(f"c{i}") for i in range(1, 5)]
    y = F.col("c1") / (F.col("c1") + 2 * F.col("c2"))

    def discount(i: int) -> Column:
        value = i - (i + 1) * y * F.col(f"c{i + 1}") / F.col(f"c{i}")
        enough = (F.col(f"c{i}") > 0) & (F.col("c1") > 0)
        return F.when(enough, F.greatest(F.lit(0.0), F.least(F.lit(float(i)), value))).otherwise(F.lit(i / 2)).alias(f"d{i}")

    return levels.groupBy("lang", "k").agg(*counts).select("lang", "k", discount(1), discount(2), discount(3))


def _discount_of(n: Column) -> Column:
    return F.when(n == 1, F.col("d1")).when(n == 2, F.col("d2")).otherwise(F.col("d3"))


def kneser_ney(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Interpolated modified Kneser-Ney of (lang, gram, n).

    Returns (k, lang, gram, p) for every n-gram of each order k and (k, lang, gram, p) for every context of k
    characters, p being the weight that it leaves to shorter contexts. Orders below the highest count distinct left
    neighbours in place of occurrences.
    """
    level = counts.select(F.lit(ORDER).alias("k"), "lang", "gram", "n")
    levels = level = staged(level, "grams")
    for k in range(ORDER - 1, 0, -1):
        level = level.groupBy("lang", F.substring("gram", 2, k).alias("gram")).agg(F.count("*").alias("n")).select(F.lit(k).alias("k"), "lang", "gram", "n")
        level = staged(level, "grams")
        levels = levels.union(level)
    discounts = staged(_discounts(levels), "discounts")
    n, context = F.col("n"), F.expr("substring(gram, 1, k - 1)")
    left = levels.join(F.broadcast(discounts), ["lang", "k"]) if _few(discounts) else levels.join(discounts, ["lang", "k"])
    contexts = staged(
        left.groupBy("k", "lang", context.alias("context")).agg(F.sum("n").alias("total"), F.sum(_discount_of(n)).alias("taken"))
        .select("k", "lang", "context", "total", (F.col("taken") / F.col("total")).alias("left")),
        "contexts",
    )
    alone = left.withColumn("own", F.greatest(n - _discount_of(n), F.lit(0.0))).withColumn("context", context)
    shares = staged(
        alone.join(contexts, ["k", "lang", "context"])
        .select("k", "lang", "gram", (F.col("own") / F.col("total")).alias("share"), "left"),
        "shares",
    )
    sizes = levels.where("k = 1").groupBy("lang").agg((1.0 / (F.count("*") + 1)).alias("p"))
    lower = shares.where("k = 1").join(sizes, "lang").select("lang", "gram", (F.col("share") + F.col("left") * F.col("p")).alias("p"))
    found = lower.select(F.lit(1).alias("k"), "lang", "gram", "p")
    for k in range(2, ORDER + 1):
        shorter = lower.select("lang", F.col("gram").alias("suffix"), F.col("p").alias("below"))
        lower = (
            shares.where(F.col("k") == k).withColumn("suffix", F.substring("gram", 2, k - 1)).join(shorter, ["lang", "suffix"])
            .select("lang", "gram", (F.col("share") + F.col("left") * F.col("below")).alias("p"))
        )
        lower = staged(lower, "probabilities")
        found = found.union(lower.select(F.lit(k).alias("k"), "lang", "gram", "p"))
    weights = contexts.select((F.col("k") - 1).alias("k"), "lang", F.col("context").alias("gram"), F.col("left").alias("p"))
    return found, weights.where("k > 0")


def _few(discounts: DataFrame) -> bool:
    """Whether the discounts (one row per language and order) are few enough to be sent to every task."""
    return discounts.limit(10_001).count() <= 10_000


def _in_numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        grams, ks = batch.column(3).to_pylist(), batch.column(1).to_pylist()
        heads = [int(_packed(np.array([ord(c) for c in gram[: ORDER - 1]], dtype=np.uint32), min(k, ORDER - 1))[0]) for k, gram in zip(ks, grams, strict=True)]
        lasts = pa.array([ord(gram[-1]) for gram in grams], pa.int32())
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(heads, pa.int64()), lasts, batch.column(4)], names=["kind", "k", "lang", "head", "last", "p"])


def learn(docs: DataFrame) -> dict[str, dict]:
    """The model of all rows: for each language and order, sorted n-grams and contexts with their log weights.

    Every n-gram of the corpus is in it with its own weight. Up to three characters are known by their packed code points, a
    longer one by the place of its context among the sorted contexts and its last character. What is kept follows the corpus.
    """
    grams, weights = kneser_ney(gram_counts(docs))
    rows = grams.select(F.lit(0).alias("kind"), "k", "lang", "gram", "p").union(weights.select(F.lit(1), "k", "lang", "gram", "p"))
    rows = rows.withColumn("p", F.log("p").cast("float"))
    table = map_rows(rows, _in_numbers, "kind int, k int, lang string, head long, last int, p float").toArrow()
    kind, k = table.column(0).to_numpy(), table.column(1).to_numpy()
    langs = table.column(2).combine_chunks().dictionary_encode()
    lang, (head, last, p) = langs.indices.to_numpy(), (table.column(i).to_numpy() for i in (3, 4, 5))
    model: dict[str, dict] = {}
    for at, name in enumerate(langs.dictionary.to_pylist()):
        own = model.setdefault(name, {})
        for a in (1, 0):  # contexts first, as the longest n-grams are known by them
            for b in range(1, ORDER + 1):
                rows_at = np.flatnonzero((lang == at) & (kind == a) & (k == b))
                keys = head[rows_at]
                if b == ORDER:
                    keys = np.searchsorted(own[1, ORDER - 1][0], keys) << POINT_BITS | last[rows_at]
                order = np.argsort(keys)
                own[a, b] = (keys[order], p[rows_at][order])
    return model


NOTHING = (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.float32))


def _find(entry: tuple[np.ndarray, np.ndarray], wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(found, log weight, place) by binary search in the sorted keys."""
    keys, values = entry
    if not len(keys):
        return np.zeros(len(wanted), dtype=bool), np.zeros(len(wanted), dtype=np.float32), np.zeros(len(wanted), dtype=np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    found = keys[at] == wanted
    return found, np.where(found, values[at], np.float32(0)), at


def _log_probabilities(model: dict[str, dict], points: np.ndarray, lang: str) -> np.ndarray:
    """Log probability of each point from the ``ORDER``-th on, given the ``ORDER - 1`` before it."""
    own = model.get(lang, {})
    count = max(0, len(points) - ORDER + 1)
    out = np.zeros(count, dtype=np.float32)
    left = np.arange(count)
    for k in range(ORDER, 0, -1):
        if k > 1:
            known, weight, place = _find(own.get((1, k - 1), NOTHING), _packed(points, k - 1)[left + ORDER - k])
        if k == ORDER:
            found, value, _ = _find(own.get((0, k), NOTHING), place << POINT_BITS | points[left + ORDER - 1].astype(np.int64))
            found &= known
        else:
            found, value, _ = _find(own.get((0, k), NOTHING), _packed(points, k)[left + ORDER - k])
        out[left] += np.where(found, value, weight) if k > 1 else value
        left = left[~found]
    out[left] += np.float32(np.log(1e-6))
    return out


def _surprise(model: dict[str, dict], langs: list[str], texts: list[str]) -> np.ndarray:
    """Minus the log probability of each text."""
    total = np.zeros(len(texts))
    with np.errstate(over="ignore"):
        for lang, points, ends, rows in _joined((lang, i, t) for i, (lang, t) in enumerate(zip(langs, texts, strict=True)) if t):
            each = _log_probabilities(model, points, lang)
            start = 0
            for end, row in zip(ends, rows, strict=True):
                own = each[start : end - ORDER + 1]
                total[row] -= own.sum(dtype=np.float64)
                start = end
    return total


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measure(docs: DataFrame, model: dict[str, dict]) -> DataFrame:
    """All rows and columns of ``docs`` with the counts and ``log_perplexity``, per word (0 for a text without words)."""
    docs = docs.drop(*COUNTS, "log_perplexity")
    text_at, schema = docs.columns.index("text"), StructType([*docs.schema.fields])
    for name in COUNTS:
        schema = schema.add(name, LongType())
    schema = schema.add("log_perplexity", DoubleType())
    lang_at = docs.columns.index("lang")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(text_at).to_pylist()]
            langs = [x or UNKNOWN for x in batch.column(lang_at).to_pylist()]
            counts = np.array([text_counts(t) for t in texts], dtype=np.int64).reshape(-1, len(COUNTS))
            scores = _surprise(shared.value, langs, texts) / np.maximum(counts[:, 0], 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, counts.T), pa.array(scores)], names=[*batch.schema.names, *COUNTS, "log_perplexity"])

    return map_rows(docs, work, schema)


BASE_FAILED = "n_words < 20 OR 100 * n_repeat_words > 30 * n_words"


def bands(measured: DataFrame) -> DataFrame:
    """(band_lang, q1, q3): quartiles of the log perplexity per language, over documents that pass the base rules."""
    quartiles = F.percentile_approx("log_perplexity", [0.25, 0.75], 10_000)
    return measured.where(f"NOT ({BASE_FAILED})").groupBy(language(F.col("lang")).alias("band_lang")).agg(quartiles.alias("q")).select(
        "band_lang", F.col("q")[0].alias("q1"), F.col("q")[1].alias("q3")
    )


def judge(docs: DataFrame, width: float = 5.0, slack: float = 15.0) -> DataFrame:
    """All rows and columns of ``docs`` with their counts, ``log_perplexity``, ``base_failed`` and ``kept``.

    A row fails the base rules with fewer than 20 words, or if over 30 % of its words lie in repeated windows of 8
    words. Of the others those are kept whose perplexity per word lies in the band of their language: ``width``
    quartile ranges beyond the quartiles, and ``slack`` over the root of the number of words more, since the
    perplexity of short texts varies more.

    The model is counted on all rows, the rejected ones too. A null text counts as empty and fails; a null or empty
    lang is a language of its own. Repeated rows each get the same verdict. Columns of the same names are
    replaced; an empty table gives no rows.
    """
    docs = docs.drop("base_failed", "kept")
    measured = staged(measure(docs, learn(docs)), "measured")
    reach = (F.col("q3") - F.col("q1")) * (width + slack / F.sqrt(F.greatest(F.col("n_words"), F.lit(1))))
    inside = F.col("log_perplexity").between(F.col("q1") - reach, F.col("q3") + reach)
    joined = measured.join(bands(measured), language(F.col("lang")) == F.col("band_lang"), "left")
    failed = F.expr(BASE_FAILED)
    return joined.withColumns({"base_failed": failed, "kept": ~failed & F.coalesce(inside, F.lit(False))}).drop("band_lang", "q1", "q3")
