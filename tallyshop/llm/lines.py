"""Fuzzy line deduplication: candidates that share a rare n-gram of words, edit similarity; SimHash blocks as a lighter way."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallyshop.llm.common import map_rows, released_shuffles, staged
from tallyshop.llm.components import connected_components

MIN_WORDS = 3  # shorter lines are left alone
FUZZY_WORDS = 8  # shorter lines only match exactly: a few words are too few bits of evidence
DISTANCE, BLOCKS = 3, 5  # five blocks, three differing bits: two blocks always agree
SIMILARITY = 0.8
LONG_WORDS = 8192
WHOLE_WORDS = 4  # shorter lines cannot lie within SIMILARITY of another without being equal
HOT_SHARE = 32  # one text in so many is sampled to find common words
HOT_WORDS = 50_000
PARTS = 1 << 10  # grams travel in so many lots, packed; a power of two
PACKED = 1 << 20  # grams that a task holds before it packs them
CHUNK = 1 << 18  # characters split at a time
PLAIN_COMPONENT = 256  # up to so many lines are compared with one another without an index
SKETCH_BITS = 1024  # a power of two, and a multiple of 4 * 64
SLIM_WORDS = 160  # lines up to here have sketches folded to a quarter, in which unlike lines still differ by far more than edits allow
MEMO_ENTRIES = 150_000
_WORD = re.compile(r"\w+")
_DIGIT = re.compile(r"\d")


def normal_words(line: str) -> list[str]:
    """Lower-cased words of a line without punctuation, digits shown as 0."""
    return _WORD.findall(_DIGIT.sub("0", line.lower()))


class _WordHash(dict):
    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) >= MEMO_ENTRIES:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value


# Each byte value with its bits spread over the bytes of a 64-bit number, so that adding numbers counts bits.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view("<u8").ravel()


def _simhashes(lines: list[list[str]], hashes: _WordHash) -> np.ndarray:
    """SimHash of each list of words (none may be empty), as signed 64-bit integers."""
    sizes = np.array([len(x) for x in lines])
    words = np.fromiter((hashes[w] for x in lines for w in x), dtype="<u8", count=int(sizes.sum()))
    spread = _SPREAD[words.view(np.uint8).reshape(-1, 8)]
    offsets = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    pieces = -(-sizes // 255)  # a byte counts to 255, so longer lines are added in pieces
    first = np.concatenate([[0], np.cumsum(pieces)[:-1]])
    within = np.arange(int(pieces.sum())) - np.repeat(first, pieces)
    counted = np.add.reduceat(spread, np.repeat(offsets, pieces) + 255 * within, axis=0).view(np.uint8).reshape(-1, 64)
    sums = np.add.reduceat(counted, first, axis=0, dtype=np.int32)
    return np.packbits(2 * sums > sizes[:, None], axis=1, bitorder="little").view("<i8").ravel()


def _sketched(sizes: np.ndarray, words: np.ndarray) -> list[bytes]:
    """``SKETCH_BITS`` bits for each line, of which each of its word hashes flips one; a quarter of that, folded, up to ``SLIM_WORDS``."""
    out, ends = [], np.cumsum(sizes)
    for low in range(0, len(sizes), 1024):
        own = sizes[low : low + 1024]
        bits = (words[ends[low] - own[0] : ends[low + len(own) - 1]] & np.uint64(SKETCH_BITS - 1)).astype(np.int64)
        odd = np.bincount(np.repeat(np.arange(len(own)) * SKETCH_BITS, own) + bits, minlength=SKETCH_BITS * len(own)) & 1
        odd = odd.astype(np.uint8).reshape(-1, 4, SKETCH_BITS // 4)
        slim, wide = np.packbits(np.bitwise_xor.reduce(odd, axis=1), axis=1), np.packbits(odd.reshape(-1, SKETCH_BITS), axis=1)
        out += [(s if n <= SLIM_WORDS else w).tobytes() for n, s, w in zip(own.tolist(), slim, wide, strict=True)]
    return out


def _sketches(lines: list[list[str]], hashes: _WordHash) -> list[bytes]:
    """The sketches of lists of words."""
    sizes = np.array([len(x) for x in lines])
    return _sketched(sizes, np.fromiter((hashes[w] for x in lines for w in x), dtype="<u8", count=int(sizes.sum())))


_MIX = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX[0]
    return x ^ (x >> np.uint64(29))


_LETTERS: dict[int, np.ndarray] = {}


def _letters(top: int) -> np.ndarray:
    """A number for each code point up to ``top`` or beyond: 0 outside words (``_WORD``), the same for all digits (``_DIGIT``)."""
    bits = max(8, top.bit_length())
    if bits not in _LETTERS:
        found = [chr(c) for c in range(min(1 << bits, 0x110000))]
        codes = np.array([48 if c.isdecimal() else ord(c) if c.isalnum() or c == "_" else 0 for c in found], dtype=np.uint64)
        _LETTERS[bits] = np.where(codes > 0, _mixed(_mixed(codes * _MIX[1])) | np.uint64(1), np.uint64(0))
    return _LETTERS[bits]


def _weights(count: int) -> np.ndarray:
    """Odd numbers that stand for the first places of a word or line."""
    return _mixed(_mixed((np.arange(count, dtype=np.uint64) + np.uint64(1)) * _MIX[2])) | np.uint64(1)


def _places(starts: np.ndarray, count: int) -> np.ndarray:
    """How far each of ``count`` items lies behind the start before it."""
    return np.arange(count) - np.repeat(starts, np.diff(np.r_[starts, count]))


class _Split:
    """The lines of some texts, their words (those of ``normal_words``) as 64-bit hashes, all texts at once.

    ``rows`` and ``numbers`` say for each line its text and its place there, ``sizes`` its words, ``ends`` where they end in ``words``.
    """

    def __init__(self, texts: list[str]):
        counts = np.array([t.count("\n") + 1 for t in texts], dtype=np.int64)
        self.first = np.cumsum(counts) - counts
        self.rows = np.repeat(np.arange(len(texts)), counts)
        self.numbers = np.arange(len(self.rows)) - self.first[self.rows]
        points = np.frombuffer("\n".join([t.lower() for t in texts]).encode("utf-32-le", "surrogatepass"), dtype="<u4")
        value = _letters(int(points.max(initial=0)))[points]
        at = np.flatnonzero(value)
        starts = np.flatnonzero(np.r_[len(at) > 0, at[1:] != at[:-1] + 1][: len(at)])
        if len(starts):
            place = _places(starts, len(at))
            self.words = _mixed(np.add.reduceat(value[at] * _weights(int(place.max()) + 1)[place], starts))
        else:
            self.words = np.zeros(0, dtype=np.uint64)
        line = np.searchsorted(np.flatnonzero(points == 10), at[starts])
        self.sizes = np.bincount(line, minlength=len(self.rows))
        self.ends = np.cumsum(self.sizes)

    def chosen(self, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(lines of at least ``least`` words, their sizes, keys, words one after the other)."""
        lines = np.flatnonzero(self.sizes >= least)
        sizes, words = self.sizes[lines], self.words[np.repeat(self.sizes >= least, self.sizes)]
        if not len(lines):
            return lines, sizes, np.zeros(0, dtype=np.uint64), words
        starts = np.cumsum(sizes) - sizes
        place = _places(starts, len(words))
        keys = np.add.reduceat(_mixed(words) * _weights(int(sizes.max()))[place], starts)
        return lines, sizes, _mixed(keys + sizes.astype(np.uint64) * _MIX[3]), words


def _chunks(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    """(place of the first, some texts) with about ``CHUNK`` characters each."""
    low, part, held = 0, [], 0
    for i, text in enumerate(texts):
        part.append(text or "")
        held += len(part[-1])
        if held >= CHUNK or len(part) == 4096:
            yield low, part
            low, part, held = i + 1, [], 0
    if part:
        yield low, part


def signatures(docs: DataFrame, sketches: bool = False) -> DataFrame:
    """(doc_id, text_hash, line, key, print, words) of every line with at least ``MIN_WORDS`` words.

    ``key`` is a hash of the normalised line, ``print`` its SimHash over words. With ``sketches``, its word sketch (``sketch``) comes in
    place of ``print``. Rows with the same id and text count as one document.
    """
    kind = "sketch" if sketches else "print"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        hashes = _WordHash()
        for batch in batches:
            for low in range(0, len(batch), 512):
                part = batch.slice(low, 512)
                rows, numbers, keys, found = [], [], [], []
                for row, text in enumerate(part.column(2).to_pylist()):
                    for number, line in enumerate(_DIGIT.sub("0", (text or "").lower()).split("\n")):
                        words = _WORD.findall(line)
                        if len(words) >= MIN_WORDS:
                            rows.append(row)
                            numbers.append(number)
                            keys.append(xxhash.xxh64_intdigest(" ".join(words).encode("utf-8", "surrogatepass")))
                            found.append(words)
                if rows:
                    at = pa.array(rows)
                    yield pa.RecordBatch.from_arrays([
                        part.column(0).take(at), part.column(1).take(at), pa.array(numbers, pa.int32()),
                        pa.array(np.array(keys, dtype=np.uint64).view(np.int64)), pa.array(_simhashes(found, hashes)), pa.array([len(x) for x in found], pa.int32()),
                    ], names=["doc_id", "text_hash", "line", "key", kind, "words"])

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, texts in _chunks(batch.column(2).to_pylist()):
                split = _Split(texts)
                lines, sizes, keys, words = split.chosen(MIN_WORDS)
                if len(lines):
                    at = pa.array(low + split.rows[lines])
                    yield pa.RecordBatch.from_arrays([
                        batch.column(0).take(at), batch.column(1).take(at), pa.array(split.numbers[lines], pa.int32()),
                        pa.array(keys.view(np.int64)), pa.array(_sketched(sizes, words), pa.binary()), pa.array(sizes, pa.int32()),
                    ], names=["doc_id", "text_hash", "line", "key", kind, "words"])

    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text")
    return map_rows(rows, sketched if sketches else work, f"doc_id long, text_hash long, line int, key long, {kind} {'binary' if sketches else 'long'}, words int")


def _block_keys(fingerprint: Column) -> Column:
    """The hash keys of a fingerprint: each choice of ``BLOCKS - DISTANCE`` blocks with its bits."""
    edges = [64 * i // BLOCKS for i in range(BLOCKS + 1)]
    masks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    signed = [m - (1 << 64) if m >> 63 else m for m in (sum(c) for c in combinations(masks, BLOCKS - DISTANCE))]
    return F.array(*[F.xxhash64(F.lit(i), fingerprint.bitwiseAND(F.lit(m))) for i, m in enumerate(signed)])


def _forest(left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the given links."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent.setdefault(up, up)
        return x

    kept = []
    for a, b in zip(left.tolist(), right.tolist(), strict=True):
        ra, rb = root(a), root(b)
        if ra != rb:
            parent[rb] = ra
            kept.append((a, b))
    return kept


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of fingerprints with equal block keys that differ in few bits; rows come sorted by key.

    All fingerprints of a key are compared, and a spanning forest of the links found is passed on, so output grows with the
    fingerprints and not with their pairs. Batches keep the run of their last key for the next.
    """
    keys, prints = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def flush(keys: np.ndarray, prints: np.ndarray) -> pa.RecordBatch:
        left, right = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        at, step = np.arange(len(keys)), 1
        while len(at := at[at < len(keys) - step]):
            at = at[keys[at] == keys[at + step]]
            near = at[np.bitwise_count((prints[at] ^ prints[at + step]).view(np.uint64)) <= DISTANCE]
            left.append(prints[near])
            right.append(prints[near + step])
            step += 1
            if sum(map(len, left)) > 1 << 20:
                kept = _forest(np.concatenate(left), np.concatenate(right))
                left, right = [np.array([a for a, _ in kept])], [np.array([b for _, b in kept])]
        kept = _forest(np.concatenate(left), np.concatenate(right))
        return pa.RecordBatch.from_arrays([pa.array([a for a, _ in kept], pa.int64()), pa.array([b for _, b in kept], pa.int64())], names=["u", "v"])

    for batch in batches:
        keys = np.concatenate([keys, batch.column(0).to_numpy()])
        prints = np.concatenate([prints, batch.column(1).to_numpy()])
        cut = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
        if cut:
            yield flush(keys[:cut], prints[:cut])
            keys, prints = keys[cut:], prints[cut:]
    if len(keys):
        yield flush(keys, prints)


def near_prints(prints: DataFrame) -> DataFrame:
    """(u, v): links between distinct fingerprints (column ``print``) of at most ``DISTANCE`` bits; a spanning forest for
    each block key."""
    keyed = prints.select(F.explode(_block_keys(F.col("print"))).alias("k"), "print")
    dealt = keyed.repartition(F.col("k")).sortWithinPartitions("k")
    return dealt.mapInArrow(_near, "u long, v long")


def _spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each line as a string of one character per word (a hash of it), so that edits count words.

    In a component whose widest line has over ``LONG_WORDS`` words, a character stands for a run of words instead; runs
    end at words chosen by their hash, alike in all its lines, and a string stays about as long as ``LONG_WORDS``.
    """
    import xxhash

    def spell(words: list[str], step: int) -> str:
        codes = [xxhash.xxh32_intdigest(w.encode("utf-8", "surrogatepass")) for w in words]
        if step > 1:
            runs, current = [], 0
            for code in codes:
                current = (current * 31 + code) & 0xFFFFFFFF
                if code % step == 0:
                    runs.append(current)
                    current = 0
            codes = [*runs, current]
        return "".join([chr(0x100 + c % 0xD000) for c in codes])

    def flush(out: list[tuple]) -> pa.RecordBatch:
        columns = zip(*out, strict=True)
        types = [pa.int64()] * 4 + [pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["key", "print", "component", "n", "text"])

    out: list[tuple] = []
    for batch in batches:
        for text, wanted in zip(batch.column(0), batch.column(1), strict=True):
            parts = (text.as_py() or "").split("\n")
            for line in wanted.as_py():
                spelled = spell(normal_words(parts[line["line"]]), -(-line["widest"] // LONG_WORDS))
                out.append((line["key"], line["print"], line["component"], line["n"], spelled))
            if len(out) > 4096:
                yield flush(out)
                out = []
    if out:
        yield flush(out)


ALIKE = f"levenshtein(a, b, cast(floor({1 - SIMILARITY:.4f} * greatest(length(a), length(b))) AS int)) >= 0"


def line_groups(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """(key, group) of lines that equal no other but link to some, a group being named by its smallest key.

    ``lines`` comes from ``signatures``. Lines whose fingerprints link form candidate components. Each line is
    compared with its component's leader (the most frequent line) and with its neighbours in the spanning forest;
    comparisons thus grow with the lines. Those with an edit similarity of at least ``SIMILARITY`` link.
    """
    nodes = staged(
        lines.where(F.col("words") >= FUZZY_WORDS).groupBy("key", "print")
        .agg(F.count("*").alias("n"), F.max("words").alias("words"), F.min(F.struct("doc_id", "text_hash", "line")).alias("first")),
        "lines",
    )
    links = staged(near_prints(nodes.select("print").distinct()), "line-links")
    alike = connected_components(links).select(F.col("node").alias("print"), "component")
    twins = nodes.groupBy("print").agg(F.count("*").alias("lines")).where("lines > 1").select("print")
    member = nodes.join(alike, "print", "left").join(twins.withColumn("twin", F.lit(True)), "print", "left")
    member = member.where("component IS NOT NULL OR twin").withColumn("component", F.coalesce("component", "print"))
    widest = member.groupBy("component").agg(F.max("words").alias("widest"))
    member = staged(member.join(widest, "component").select("key", "print", "n", "first", "component", "widest"), "line-candidates")
    wanted = (  # the lines of a document that are to be compared travel as one list, so its text is split once
        member.groupBy("first.doc_id", "first.text_hash")
        .agg(F.collect_list(F.struct("first.line", "key", "print", "component", "n", "widest")).alias("lines")).alias("m")
    )
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text").alias("d")
    own = F.col("m.doc_id").eqNullSafe(F.col("d.doc_id")) & (F.col("m.text_hash") == F.col("d.text_hash"))
    found = rows.join(wanted, own).select("text", "lines")
    texts = map_rows(found, _spelled, "key long, print long, component long, n long, text string")
    texts = staged(texts.dropDuplicates(["key", "print"]), "line-texts")
    leaders = texts.groupBy("component").agg(F.max_by(F.struct("key", "text"), F.struct("n", "key")).alias("lead"))
    to_leader = texts.join(leaders, "component").select(F.col("key").alias("u"), F.col("text").alias("a"), F.col("lead.key").alias("v"), F.col("lead.text").alias("b"))
    of_print = texts.groupBy("print").agg(F.max_by(F.struct("key", "text"), F.struct("n", "key")).alias("lead"))
    within = texts.join(of_print, "print").select(F.col("key").alias("u"), F.col("text").alias("a"), F.col("lead.key").alias("v"), F.col("lead.text").alias("b"))
    across = (
        links.join(of_print.select(F.col("print").alias("u"), F.col("lead").alias("p")), "u").join(of_print.select(F.col("print").alias("v"), F.col("lead").alias("q")), "v")
        .select(F.col("p.key").alias("u"), F.col("p.text").alias("a"), F.col("q.key").alias("v"), F.col("q.text").alias("b"))
    )
    pairs = to_leader.union(within).union(across).where("u <> v")
    verified = pairs.where(ALIKE).select("u", "v")
    return connected_components(verified).select(F.col("node").alias("key"), F.col("component").alias("group"))


# --- every pair within SIMILARITY ------------------------------------------------------------------------------------
#
# A line of L words and one of at most L words within L // 5 word edits of it share all but q * (L // 5) of the L - q + 1
# word q-grams of the longer. If grams are taken in any fixed order, a short prefix of each line's grams thus meets the
# other's. Lines meet in bigrams, those of rare words first, as few lines share them by chance. Nothing similar is lost.


def _edits(words):
    """Word edits that ``SIMILARITY`` allows when the longer line has ``words`` words."""
    return words // 5


def _prefix(words: np.ndarray, q: int) -> np.ndarray:
    """How many of a line's first q-grams must be looked at so that no line within ``SIMILARITY`` is missed."""
    after = 5 * (words // 5 + 1)  # partners with more words need most at the next length that allows one more edit
    most = np.maximum(q * _edits(words) - words, q * _edits(after) - after)
    return np.minimum(words + 1 + most, words - q + 1)


def _prefix_grams(sizes: np.ndarray, words: np.ndarray, hot: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the line, 46-bit hash of the gram) of the first bigrams of at most 4,096 lines; a repeated gram is numbered.

    Bigrams of the words in ``hot`` (sorted) come last in the order, the more so the higher their ``level`` (below 32); others by their hash.
    """
    mask = np.uint64((1 << 46) - 1)
    line = np.repeat(np.arange(len(sizes)), sizes)
    place = np.minimum(np.searchsorted(hot, words), len(hot) - 1)
    rank = np.where(hot[place] == words, level[place], 0).astype(np.uint64) if len(hot) else np.zeros(len(words), dtype=np.uint64)
    inside = line[:-1] == line[1:]
    grams = _mixed(_mixed(words[:-1] * _MIX[1]) + words[1:] * _MIX[2])[inside] & mask
    rank = (rank[:-1] + rank[1:])[inside]
    # line, rank and hash make one number, so one sort of numbers puts the grams of all lines in order
    ordered = np.sort(line[1:][inside].astype(np.uint64) << np.uint64(52) | rank << np.uint64(46) | grams)
    line, grams = (ordered >> np.uint64(52)).astype(np.int64), ordered & mask
    again = _places(np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]), len(ordered)).astype(np.uint64)
    grams = np.where(again > 0, _mixed(grams + again * _MIX[3]) & mask, grams)
    first = _places(np.flatnonzero(np.r_[True, line[1:] != line[:-1]]), len(line)) < _prefix(sizes, 2)[line]
    return line[first], grams[first]


def _pack(grams: list[np.ndarray], keys: list[np.ndarray]) -> pa.RecordBatch:
    """One row for each lot of grams (their last bits): 32 more bits of the grams, and the keys of their lines."""
    gram, key = np.concatenate(grams), np.concatenate(keys)
    lot = (gram & np.uint64(PARTS - 1)).astype(np.int16)
    order = np.argsort(lot, kind="stable")
    gram, key = (gram[order] >> np.uint64(PARTS.bit_length() - 1)).astype("<u4"), key[order].astype("<i8")
    starts, sizes = _runs(lot[order])

    def binary(values: np.ndarray) -> pa.Array:
        offsets = np.r_[starts, len(values)].astype(np.int32) * values.dtype.itemsize
        return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(values.tobytes())])

    return pa.RecordBatch.from_arrays([pa.array(lot[order][starts].astype(np.int32)), binary(gram), binary(key)], names=["lot", "grams", "keys"])


def _gram_lots(docs: DataFrame, hot: np.ndarray, level: np.ndarray) -> DataFrame:
    """(lot, grams, keys) of the lines of ``docs``, packed; copies of a line come once for each task, or a few times."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, grams, named, held = set(), [], [], 0
        for batch in batches:
            for _, texts in _chunks(batch.column(0).to_pylist()):
                _, sizes, keys, words = _Split(texts).chosen(WHOLE_WORDS)
                new = np.zeros(len(keys), dtype=bool)
                for i, key in enumerate(keys.tolist()):
                    if key not in seen:
                        seen.add(key)
                        new[i] = True
                sizes, keys, words = sizes[new], keys[new].view(np.int64), words[np.repeat(new, sizes)]
                if len(seen) >= MEMO_ENTRIES:
                    seen.clear()
                ends = np.cumsum(sizes)
                for low in range(0, len(sizes), 4096):
                    own = sizes[low : low + 4096]
                    line, found = _prefix_grams(own, words[ends[low] - own[0] : ends[low + len(own) - 1]], hot, level)
                    grams.append(found)
                    named.append(keys[low + line])
                    held += len(found)
                if held >= PACKED:
                    yield _pack(grams, named)
                    grams, named, held = [], [], 0
        if held:
            yield _pack(grams, named)

    return map_rows(docs.select("text"), work, "lot int, grams binary, keys binary")


def _common_words(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of words that sampled texts have often, and levels that rise with their logarithms. They only steer the
    order of grams, not what is found."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in _chunks(batch.column(0).to_pylist()):
                words, counts = np.unique(_Split(texts).words, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(counts, pa.int64())], names=["word", "n"])

    sampled = docs.where(F.pmod(F.xxhash64("text"), F.lit(HOT_SHARE)) == 0).select("text").distinct()
    counts = map_rows(sampled, work, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).where("n >= 2")
    found = counts.orderBy(F.desc("n"), "word").limit(HOT_WORDS).toArrow()
    words, n = found.column("word").to_numpy().view(np.uint64), found.column("n").to_numpy()
    order = np.argsort(words)
    return words[order], np.minimum(31, np.round(2 * np.log2(n[order])))


def _by_run(work: Callable[[list[np.ndarray]], pa.RecordBatch]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``work`` over the columns of rows sorted by the first one, so that rows with equal values stay together."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if not len(batch):
                continue
            cut = int(np.searchsorted(columns[0], columns[0][-1]))
            if cut or (held and held[-1][0][-1] != columns[0][0]):
                held.append([c[:cut] for c in columns])
                yield work([np.concatenate(c) for c in zip(*held, strict=True)])
                held = []
            held.append([c[cut:] for c in columns])
        if held:
            yield work([np.concatenate(c) for c in zip(*held, strict=True)])

    return over


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return starts, np.diff(np.r_[starts, len(keys)])


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The (gram, key) rows, each once, of grams with several keys; packed rows come sorted by their lot."""

    def flush(lot: int, grams: list[bytes], keys: list[bytes]) -> pa.RecordBatch:
        gram, key = np.frombuffer(b"".join(grams), dtype="<u4"), np.frombuffer(b"".join(keys), dtype="<i8")
        order = np.lexsort((key, gram))
        gram, key = gram[order], key[order]
        once = np.r_[True, (gram[1:] != gram[:-1]) | (key[1:] != key[:-1])]
        gram, key = gram[once], key[once]
        _, sizes = _runs(gram)
        several = np.repeat(sizes > 1, sizes)
        return pa.RecordBatch.from_arrays([pa.array(gram[several].astype(np.int64) << 16 | lot), pa.array(key[several])], names=["gram", "key"])

    lot, grams, keys = None, [], []
    for batch in batches:
        for at, gram, key in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if at != lot and grams:
                yield flush(lot, grams, keys)
                grams, keys = [], []
            lot = at
            grams.append(gram)
            keys.append(key)
    if grams:
        yield flush(lot, grams, keys)


class _Bits:
    """Word sketches of rows: all of them folded, and those of long lines in full as well."""

    def __init__(self, sketches: np.ndarray):
        whole = SKETCH_BITS // 8
        self.long = np.fromiter((len(x) == whole for x in sketches), dtype=bool, count=len(sketches))
        self.place = np.cumsum(self.long) - 1
        self.wide = np.frombuffer(b"".join(sketches[self.long]), dtype=np.uint64).reshape(-1, SKETCH_BITS // 64)
        self.slim = np.empty((len(sketches), SKETCH_BITS // 256), dtype=np.uint64)
        self.slim[~self.long] = np.frombuffer(b"".join(sketches[~self.long]), dtype=np.uint64).reshape(-1, SKETCH_BITS // 256)
        self.slim[self.long] = np.bitwise_xor.reduce(self.wide.reshape(-1, 4, SKETCH_BITS // 256), axis=1)

    def differ(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """How many bits the sketches of rows ``x`` and ``y`` differ in, folded where one of the two lines is short."""
        found = np.bitwise_count(self.slim[x] ^ self.slim[y]).sum(axis=1, dtype=np.int64)
        both = np.flatnonzero(self.long[x] & self.long[y])
        if len(both):
            found[both] = np.bitwise_count(self.wide[self.place[x[both]]] ^ self.wide[self.place[y[both]]]).sum(axis=1, dtype=np.int64)
        return found


def _may_match(x, y, words: np.ndarray, bits: _Bits) -> np.ndarray:
    """Whether sizes and word sketches allow a similarity of ``SIMILARITY``: an edit changes the length by at most one
    word and the sketch, folded or not, by at most two bits. ``y`` is an array of rows."""
    allowed = _edits(np.maximum(words[x], words[y]))
    found = np.abs(words[x] - words[y]) <= allowed
    at = np.flatnonzero(found)
    found[at] = False
    for part in np.array_split(at, len(at) // 65_536 + 1) if len(at) > 65_536 else [at]:
        other = x[part] if isinstance(x, np.ndarray) else np.full(len(part), x)
        few = np.bitwise_count(bits.slim[other, 0] ^ bits.slim[y[part], 0]) <= 2 * allowed[part]  # a part differs in no more bits than the whole
        part, other = part[few], other[few]
        found[part] = bits.differ(other, y[part]) <= 2 * allowed[part]
    return found


def _reach(left: np.ndarray, near: Callable[[int, np.ndarray], np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    """(x, rows first reached from x): ``near`` asks which of the rows not yet reached link to x, so that linked rows are
    asked once and each component is whole."""
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            x = queue.pop()
            hit = near(x, left)
            if hit.any():
                yield x, left[hit]
                queue += left[hit].tolist()
                left = left[~hit]


def _pairs(x: np.ndarray, y: np.ndarray, words: np.ndarray, bits: _Bits) -> tuple[np.ndarray, np.ndarray]:
    """(places in ``x``, places in ``y``) of rows that may match; ``y`` is sorted by words, so sizes that fit are a range."""
    low = np.searchsorted(words[y], words[x] - _edits(words[x]))
    sizes = np.maximum(np.searchsorted(words[y] - _edits(words[y]), words[x], side="right") - low, 0)
    a = np.repeat(np.arange(len(x)), sizes)
    b = _places(np.cumsum(sizes) - sizes, len(a)) + low[a]
    found = _may_match(x[a], y[b], words, bits)
    return a[found], b[found]


def _candidates(columns: list[np.ndarray]) -> pa.RecordBatch:
    """A spanning forest of the pairs of keys that share a gram and may match; rows come sorted by gram and words.

    Of a large group, components that hold much of it are taken out first, asking for each line once; what is left, and small
    groups, are compared pair by pair as far as sizes fit.
    """
    gram, key, words, bits = columns
    words, bits = words.astype(np.int64), _Bits(bits)
    left, right = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    held = 0

    def forest() -> None:
        nonlocal left, right, held
        kept = _forest(np.concatenate(left), np.concatenate(right))
        left, right, held = [np.array([a for a, _ in kept], dtype=np.int64)], [np.array([b for _, b in kept], dtype=np.int64)], 0

    def link(x: np.ndarray, y: np.ndarray) -> None:
        nonlocal held
        left.append(key[x])
        right.append(key[y])
        held += len(x)
        if held > 1 << 20:
            forest()

    loose = np.ones(len(gram), dtype=bool)
    starts, sizes = _runs(gram)
    for start, size in zip(starts[sizes > 32].tolist(), sizes[sizes > 32].tolist(), strict=True):
        rest, taken = np.arange(start, start + size), size
        while len(rest) > 1 and 8 * taken >= len(rest):
            before, queue, rest = len(rest), rest[:1], rest[1:]
            while len(queue) and len(rest):
                x, queue = queue[:16], queue[16:]
                a, b = _pairs(x, rest, words, bits)
                b, at = np.unique(b, return_index=True)
                link(x[a[at]], rest[b])
                queue, rest = np.r_[queue, rest[b]], np.delete(rest, b)
            taken = before - len(rest)
        loose[start : start + size] = False
        loose[rest] = True
    row = np.flatnonzero(loose)
    at, step = np.arange(len(row)), 1
    while len(at := at[at < len(row) - step]):
        x, y = row[at], row[at + step]
        fits = (gram[x] == gram[y]) & (words[y] - _edits(words[y]) <= words[x])  # once a line is too long, so are those after it
        at, x, y = at[fits], x[fits], y[fits]
        near = _may_match(x, y, words, bits)
        link(x[near], y[near])
        step += 1
    forest()
    return pa.RecordBatch.from_arrays([pa.array(left[0], pa.int64()), pa.array(right[0], pa.int64())], names=["u", "v"])


def edit_distance(a: list, b: list) -> int:
    """Edits (one item in, out or changed) between two lists, bit-parallel after Myers and Hyyro."""
    low, high_a, high_b = 0, len(a), len(b)
    while low < high_a and low < high_b and a[low] == b[low]:
        low += 1
    while high_a > low and high_b > low and a[high_a - 1] == b[high_b - 1]:
        high_a, high_b = high_a - 1, high_b - 1
    a, b = a[low:high_a], b[low:high_b]
    if not a or not b:
        return len(a) + len(b)
    places: dict = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    every, last = (1 << len(a)) - 1, 1 << (len(a) - 1)
    plus, minus, distance = every, 0, len(a)
    for x in b:
        match = places.get(x, 0)
        zero = (((match & plus) + plus) ^ plus) | match | minus
        up, down = minus | (every & ~(zero | plus)), plus & zero
        distance += bool(up & last) - bool(down & last)
        up, down = (up << 1 | 1) & every, (down << 1) & every
        plus, minus = down | (every & ~(zero | up)), up & zero
    return distance


class _Lines:
    """The lines of one component: their words as 32-bit codes, and which of them are within ``SIMILARITY``."""

    def __init__(self, codes: list[np.ndarray]):
        self.codes, self.bags = codes, {}

    def bag(self, x: int) -> np.ndarray:
        """The codes in order, a repeated one numbered."""
        if x not in self.bags:
            found = np.sort(self.codes[x]).astype(np.int64)
            self.bags[x] = found << 24 | _places(np.flatnonzero(np.r_[True, found[1:] != found[:-1]]), len(found))
        return self.bags[x]

    def match(self, x: int, y: int) -> bool:
        a, b = self.codes[x], self.codes[y]
        longest = max(len(a), len(b))
        allowed = _edits(longest)
        if len(a) == len(b) and np.count_nonzero(a != b) <= allowed:
            return True
        both = np.sort(np.concatenate([self.bag(x), self.bag(y)]))
        if np.count_nonzero(both[1:] == both[:-1]) < longest - allowed:  # every word that is not shared costs an edit
            return False
        return edit_distance(a.tolist(), b.tolist()) <= allowed


def _labels(lines: _Lines, words: np.ndarray, may: Callable[[int, np.ndarray], np.ndarray]) -> np.ndarray:
    """A label for each line of a large component, alike for lines of one group.

    Lines within ``SIMILARITY`` share all but a fifth of their words, so they meet in one of the rarest words of both, as
    lines of the whole table do in bigrams; only such pairs that are not linked already are compared, each once.
    """
    sizes = words
    items, line = np.concatenate([lines.bag(x) for x in range(len(sizes))]), np.repeat(np.arange(len(sizes)), sizes)
    _, item, counts = np.unique(items, return_inverse=True, return_counts=True)
    order = np.lexsort((item, counts[item], line))
    item, line = item[order], line[order]
    first = (_places(np.flatnonzero(np.r_[True, line[1:] != line[:-1]]), len(line)) < _prefix(sizes, 1)[line]) & (counts[item] > 1)
    item, line = item[first], line[first]
    order = np.lexsort((line, item))
    item, line = item[order], line[order]
    label, members, failed = np.arange(len(sizes)), {x: [x] for x in range(len(sizes))}, set()
    for start, size in zip(*map(np.ndarray.tolist, _runs(item)), strict=True):
        group = line[start : start + size]
        for i in range(size - 1):
            x, rest = int(group[i]), group[i + 1 :]
            rest = rest[label[rest] != label[x]]
            for y in rest[may(x, rest)].tolist() if len(rest) else ():
                if label[x] == label[y] or (x, y) in failed:
                    continue
                if not lines.match(x, y):
                    failed.add((x, y))
                    continue
                small, large = sorted((int(label[x]), int(label[y])), key=lambda at: len(members[at]))
                moved = members.pop(small)
                label[moved] = large
                members[large] += moved
    return label


def _verified(columns: list[np.ndarray]) -> pa.RecordBatch:
    """(key, group) of lines that really match another, each group named by its smallest key.

    Every line of a candidate component is compared with all that may match it and are not linked to it already; in large
    components only with those that share a rare word, without which they cannot match.
    """
    component, key, words, bits, codes = columns
    words, bits = words.astype(np.int64), _Bits(bits)
    keys, groups = [], []
    for start, size in zip(*map(np.ndarray.tolist, _runs(component)), strict=True):
        lines = _Lines([np.frombuffer(codes[i], dtype=np.uint32) for i in range(start, start + size)])

        def may(x: int, rest: np.ndarray, start: int = start) -> np.ndarray:
            return _may_match(start + x, start + rest, words, bits)

        def near(x: int, rest: np.ndarray, lines: _Lines = lines, may: Callable = may) -> np.ndarray:
            hit = may(x, rest)
            for i in np.flatnonzero(hit).tolist():
                hit[i] = lines.match(x, int(rest[i]))
            return hit

        if size > PLAIN_COMPONENT:
            label = _labels(lines, words[start : start + size], may)
        else:
            label = np.arange(size)
            for x, hit in _reach(np.arange(size), near):
                label[hit] = label[x]
        own = key[start : start + size]
        _, at, counts = np.unique(label, return_inverse=True, return_counts=True)
        least = np.full(len(counts), np.iinfo(np.int64).max)
        np.minimum.at(least, at, own)
        several = counts[at] > 1
        keys.append(own[several])
        groups.append(least[at[several]])
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(groups))], names=["key", "group"])


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(component, key, words, sketch, codes) of the wanted lines of each text, codes being a 32-bit hash of each word."""
    names = ["component", "key", "words", "sketch"]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.binary()]
    for batch in batches:
        every = batch.column(1).to_pylist()
        for low, texts in _chunks(batch.column(0).to_pylist()):
            split = _Split(texts)
            out, codes = [], []
            for first, wanted in zip(split.first.tolist(), every[low : low + len(texts)], strict=True):
                for line in wanted:
                    at = first + line["line"]
                    out.append(line)
                    codes.append(split.words[split.ends[at] - split.sizes[at] : split.ends[at]].astype(np.uint32).tobytes())
            columns = [pa.array([x[n] for x in out], t) for n, t in zip(names, types, strict=True)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(codes, pa.binary())], names=[*names, "codes"])


def whole_groups(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """(key, group) of lines that equal no other but link to some, a group being named by its smallest key.

    ``lines`` comes from ``signatures(docs, sketches=True)``. All pairs of lines with an edit similarity of at least
    ``SIMILARITY`` over words link. Pairs that share a gram and whose sizes and sketches allow it form candidate
    components (a superset of the groups); each is compared in full inside, texts travelling once.
    """
    nodes = staged(
        lines.where(F.col("words") >= WHOLE_WORDS).groupBy("key")
        .agg(F.max("words").alias("words"), F.max("sketch").alias("sketch"), F.min(F.struct("doc_id", "text_hash", "line")).alias("first")),
        "lines",
    )
    lots = _gram_lots(docs, *_common_words(docs)).repartition(F.col("lot")).sortWithinPartitions("lot")
    shared = staged(map_rows(lots, _shared, "gram long, key long"), "line-grams")
    known = shared.join(nodes.select("key", "words", "sketch"), "key").select("gram", "key", "words", "sketch")
    dealt = known.repartition(F.col("gram")).sortWithinPartitions("gram", "words", "key")
    links = staged(dealt.mapInArrow(_by_run(_candidates), "u long, v long"), "line-links")
    alike = connected_components(links).select(F.col("node").alias("key"), "component")
    member = nodes.join(alike, "key")
    own = ["named", "doc_id", "text_hash"]  # without nulls, so that one shuffle of the texts serves both steps below

    def placed(doc_id: Column) -> list[Column]:
        return [doc_id.isNotNull().alias("named"), F.coalesce(doc_id, F.lit(0).cast("long")).alias("doc_id")]

    wanted = (  # the lines of a document that are to be compared travel as one list, so its text is split once
        member.select(*placed(F.col("first.doc_id")), "first.text_hash", F.struct("first.line", "component", "key", "words", "sketch").alias("line"))
        .groupBy(*own).agg(F.collect_list("line").alias("lines"))
    )
    texts = docs.select(*placed(F.col("doc_id").cast("long")), F.xxhash64("text").alias("text_hash"), "text").dropDuplicates(own)
    coded = map_rows(texts.join(wanted, own).select("text", "lines"), _coded, "component long, key long, words int, sketch binary, codes binary")
    # An explicit number, as comparing takes long for its bytes and tasks of few bytes would be put together.
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = coded.repartition(tasks, "component").sortWithinPartitions("component", "key")
    return staged(map_rows(dealt, _by_run(_verified), "key long, group long"), "line-groups")


def dedup(docs: DataFrame, whole: bool = False) -> DataFrame:
    """``docs`` with repeated lines taken out of ``text``; all rows and columns stay, ``n_dropped`` counts lines removed.

    Lines are the parts of a text between newlines. They match if their normal forms (lower case, no punctuation, digits as
    0) are equal, or, from 8 words on, if their SimHashes differ in at most 3 bits and their edit similarity over words is
    at least 0.8. With ``whole``, as the queries have it, all pairs of lines with that edit similarity match, however many
    bits differ; a line of 4 words can match one of 5. Matching lines form connected groups. Of each group the occurrence with the smallest doc_id, then
    text hash, then line number stays. Lines of fewer than 3 words always stay.

    A null text stays null; empty texts stay empty. A null doc_id comes first, so its lines win. Rows with the same
    id and text are one document and keep the same lines. A text of which all lines go becomes empty. An empty
    table gives no rows; a column already named ``n_dropped`` is replaced.
    """
    docs = docs.drop("n_dropped")
    with released_shuffles(docs.sparkSession):
        lines = staged(signatures(docs, sketches=whole), "signatures")
        groups = whole_groups(docs, lines) if whole else line_groups(docs, lines)
    named = lines.join(groups, "key", "left").withColumn("group", F.coalesce("group", "key"))
    place = F.struct("doc_id", "text_hash", "line")
    winners = named.groupBy("group").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").select("group", "first")
    dropped = named.join(winners, "group").where(~place.eqNullSafe(F.col("first")))
    gone = dropped.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set("line")).alias("_gone"))
    gone = gone.select(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash"), "_gone")
    own = docs["doc_id"].cast("long").eqNullSafe(F.col("_doc")) & (F.xxhash64(docs["text"]) == F.col("_hash"))
    joined = docs.join(gone, own, "left").drop("_doc", "_hash")
    at, names = docs.columns.index("text"), [*docs.columns, "n_dropped"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone = batch.column(len(batch.schema.names) - 1).to_pylist()
            texts = batch.column(at).to_pylist()
            for i, numbers in enumerate(gone):
                if numbers:
                    out = set(numbers)
                    texts[i] = "\n".join(line for n, line in enumerate(texts[i].split("\n")) if n not in out)
            columns = list(batch.columns[:-1])
            columns[at] = pa.array(texts, columns[at].type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array([len(x or ()) for x in gone], pa.int64())], names=names)

    schema = StructType([*docs.schema.fields]).add("n_dropped", "long")
    return map_rows(joined, work, schema)
