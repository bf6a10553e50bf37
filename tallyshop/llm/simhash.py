"""SimHash near duplicates through deletion-variant signatures."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyshop.llm.common import map_rows, staged
from tallyshop.llm.components import connected_components

BITS = 64
CHUNK = 1 << 16  # shingles hashed before their bits are counted


def _count_bits(hashes: list[int]) -> np.ndarray:
    """How many of the 64-bit hashes have each bit, least significant first: by counts of byte values."""
    columns = np.asarray(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
    of_byte = np.stack([np.bincount(columns[:, b], minlength=256) for b in range(8)])
    bits = (np.arange(256)[:, None] >> np.arange(8)) & 1
    return (of_byte @ bits).reshape(BITS)


def fingerprint(text: str | None, words: int, seed: int) -> int:
    """SimHash of the word shingles of a text, as a signed 64-bit integer; zero if it has no word."""
    import xxhash

    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    digest, joined = xxhash.xxh64_intdigest, b" ".join(found)
    starts = np.cumsum([0] + [len(w) + 1 for w in found]).tolist()
    shingles = max(1, len(found) - words + 1)
    ends = starts[min(words, len(found)) :]
    counts = np.zeros(BITS, dtype=np.int64)
    for low in range(0, shingles, CHUNK):
        high = min(low + CHUNK, shingles)
        counts += _count_bits([digest(joined[a : b - 1], seed) for a, b in zip(starts[low:high], ends[low:high], strict=True)])
    set_bits = (2 * counts > shingles).astype(np.uint8)
    return int(np.packbits(set_bits, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, words: int = 4, seed: int = 42, carry: dict[str, Column] | None = None) -> DataFrame:
    """(doc_id, fingerprint) of every row of ``docs`` (doc_id, text), fingerprint as a signed long; ``carry`` names longs to go along."""
    carry = carry or {}
    names = ["doc_id", "fingerprint", *carry]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(text.as_py(), words, seed) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.int64()), *batch.columns[2:]], names=names)

    rows = docs.select(F.col("doc_id").cast("long"), "text", *[c.alias(n) for n, c in carry.items()])
    return map_rows(rows, work, "".join(["doc_id long, fingerprint long", *[f", {n} long" for n in carry]]))


def _segments(distance: int) -> list[tuple[int, int]]:
    """(first bit, width) of the fewest equal segments of which one always differs by at most one bit."""
    count = distance // 2 + 1
    edges = [BITS * i // count for i in range(count + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _variants(prints: DataFrame, segments: list[tuple[int, int]]) -> DataFrame:
    """One row per fingerprint and bit: the bit's segment with that bit taken out."""
    masks = [_signed((((1 << width) - 1) << first) & ~(1 << bit)) for first, width in segments for bit in range(first, first + width)]
    variants = F.array(*[F.struct(F.lit(i).cast("byte").alias("bit"), F.col("fingerprint").bitwiseAND(F.lit(m)).alias("rest")) for i, m in enumerate(masks)])
    return prints.select("fingerprint", F.explode(variants).alias("v")).select("fingerprint", "v.bit", "v.rest")


def _first_meeting(a: Column, b: Column, bit: Column, segments: list[tuple[int, int]]) -> Column:
    """True at one of the variants that two fingerprints share: in their first segment with at most one differing
    bit, at that bit, or at the segment's first bit if none differs."""
    found = F.lit(-1)
    for first, width in reversed(segments):
        differing = a.bitwiseXOR(b).bitwiseAND(F.lit(_signed(((1 << width) - 1) << first)))
        position = F.bit_count(F.bitwise_not(differing).bitwiseAND(differing - 1))  # zeros below the lowest set bit
        few = F.bit_count(differing)
        found = F.when(few == 0, F.lit(first)).when(few == 1, position).otherwise(found)
    return found == bit.cast("int")


def links(prints: DataFrame, distance: int = 4) -> DataFrame:
    """Pairs (u, v), u < v, of different fingerprints of ``prints`` that differ in at most ``distance`` bits.

    Each pair comes once. Fingerprints must be distinct and not null.
    """
    segments = _segments(distance)
    variants = _variants(prints, segments)
    a, b = variants.alias("a"), variants.alias("b")
    u, v = F.col("a.fingerprint"), F.col("b.fingerprint")
    meet = (
        (F.col("a.bit") == F.col("b.bit")) & (F.col("a.rest") == F.col("b.rest")) & (u < v)
        & (F.bit_count(u.bitwiseXOR(v)) <= distance) & _first_meeting(u, v, F.col("a.bit"), segments)
    )
    return a.join(b.hint("merge"), meet).select(u.alias("u"), v.alias("v"))


def near_duplicates(docs: DataFrame, distance: int = 4, words: int = 4, seed: int = 42) -> DataFrame:
    """Near-duplicate groups of ``docs`` (doc_id, text): doc_id, fingerprint (16 hex digits), component_id.

    Texts are lower-cased (A-Z only) and split at white space; a fingerprint bit is set if more than half of the
    shingle hashes have it. Equal fingerprints collapse before any pair is formed, so thousands of copies are one
    node. With distance 4 the fingerprint is cut into three segments; of two linked fingerprints one segment differs
    by at most one bit, so they share a variant of it with that bit taken out. Variants meet in an equality join that
    keeps verified pairs only. ``component_id`` is the smallest doc_id that links reach.

    One row per input row. A null or empty text has fingerprint zero, and links like any other. Null ids stay null
    and never name a component unless all its ids are null; repeated rows and ids come back as often as they came.
    An empty table gives no rows; other columns are ignored.
    """
    prints = staged(fingerprints(docs, words, seed), "fingerprints")
    return prints.join(_groups(prints, distance), "fingerprint").select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id"
    )


def _groups(prints: DataFrame, distance: int) -> DataFrame:
    """(fingerprint, component, component_id) of each distinct fingerprint: its group's smallest fingerprint and doc_id."""
    nodes = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least"))
    members = connected_components(links(nodes.select("fingerprint"), distance))
    named = (
        nodes.join(members, F.col("fingerprint") == F.col("node"), "left")
        .withColumn("component", F.coalesce("component", "fingerprint"))
    )
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    return named.join(least, "component").select("fingerprint", "component", "component_id")


def keep_one(docs: DataFrame, distance: int = 4, words: int = 4, seed: int = 42) -> DataFrame:
    """``docs`` with one row of each near-duplicate group: that of the smallest doc_id.

    All columns stay. Rows without an id stay: nothing can name them. Of several rows with the smallest id of their group, that
    with the smallest hash of its text stays, and of rows equal in both any one, so the choice of ids and texts does not depend on how rows are
    dealt out. Rows of one id with texts of different groups are judged each in its own. Same cases as ``near_duplicates`` otherwise.
    """
    text = {"t0": F.xxhash64("text"), "t1": F.xxhash64(F.lit("second"), F.col("text"))}
    prints = staged(fingerprints(docs, words, seed, text), "fingerprints")
    groups = _groups(prints, distance).select("fingerprint", "component")
    first = F.min(F.struct("doc_id", *text)).alias("first")
    heads = prints.where("doc_id IS NOT NULL").join(groups, "fingerprint").groupBy("component").agg(first).select(
        F.col("first.doc_id").alias("_doc"), F.col("first.t0").alias("_t0"), F.col("first.t1").alias("_t1")
    )
    keyed = docs.where("doc_id IS NOT NULL").withColumns({"_k0": text["t0"], "_k1": text["t1"]})
    same = (F.col("doc_id").cast("long") == F.col("_doc")) & (F.col("_k0") == F.col("_t0")) & (F.col("_k1") == F.col("_t1"))
    kept = keyed.join(heads, same).dropDuplicates(["_doc", "_k0", "_k1"])
    return kept.select(*docs.columns).unionByName(docs.where("doc_id IS NULL"))
