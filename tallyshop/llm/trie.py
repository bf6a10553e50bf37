"""Conversation prefix trie: which conversations share their first turns, and what sharing them would save."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyshop.llm.common import map_rows, staged

# Turns of a conversation that one window task takes in; longer ones go on in the next block.
BLOCK = 1024
# Characters of a text that order turns of one conversation, turn number and role; beyond them its hash does.
HEAD = 64
# The count-min sketch: rows, cells per row and prefix, and the most cells of a row (as a power of two; two bits each, so 48 MB in all).
ROWS, SPARE, MOST_BITS = 3, 4, 26
# Cells of a slice, the unit in which tasks send counts and partial sketches are added up (as a power of two).
SLICE_BITS = 18
# Digests that a task counts at a time, and ids that one string of members holds.
COUNT_AT_ONCE, IDS_AT_ONCE = 1 << 20, 1 << 14


def numbered(conversations: DataFrame) -> DataFrame:
    """(conv_id, n, r0, r1, bytes): turns numbered from 1 in each conversation, a 128-bit hash of role and text, the text's UTF-8 bytes.

    The order is that of ``turn`` (null first), then of role, the text's first 64 characters and its hash. Repeated rows are turns
    of their own. A null role or text counts as empty. Rows without conv_id belong to no conversation and are left out.

    Rows are ranged on that whole order, so that neither a long conversation nor one turn number with many rows meets in a task;
    texts stay behind.
    """
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), F.substring(text, 1, HEAD).alias("head"),
        F.xxhash64(role, text).alias("r0"), F.xxhash64(text, F.lit("second"), role).alias("r1"),
        F.octet_length(text).cast("long").alias("bytes"), F.monotonically_increasing_id().alias("row"),
    )
    order = [F.col("turn").asc_nulls_first(), "role", "head", "r0", "r1", "row"]
    ranged = staged(rows.repartitionByRange(F.col("conv_id"), *order).withColumn("part", F.spark_partition_id()), "turns")
    sizes = ranged.groupBy("conv_id", "part").agg(F.count("*").alias("size"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("conv_id", "part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start"))
    at = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy(*order))
    return ranged.withColumn("at", at).join(starts, ["conv_id", "part"]).select("conv_id", (F.col("at") + F.col("start")).alias("n"), "r0", "r1", "bytes")


def respliced(turns: DataFrame, cycle: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """(turns, roster) of conversations whose first turns are replaced by those of a neighbour.

    Conversation c takes the first h turns of conversation c - c % ``cycle`` (all if it has fewer, none if it is absent), then its
    own after its first h; h is the unsigned crc32 of c in decimals modulo ``most``, and c % ``cycle`` has the sign of c. The roster also has conversations left without turns.
    """
    lengths = turns.groupBy("conv_id").agg(F.max("n").alias("size"))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    own = lengths.select("conv_id", "size", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % cycle).alias("source"))
    source = lengths.select(F.col("conv_id").alias("source"), F.col("size").alias("there"))
    taken = F.least("h", F.coalesce("there", F.lit(0)))
    plan = own.join(source, "source", "left").select("conv_id", "source", "h", taken.alias("taken"), (taken + F.greatest(F.col("size") - F.col("h"), F.lit(0))).alias("size"))
    rest = turns.join(plan.select("conv_id", "h", "taken"), "conv_id").where("n > h").select("conv_id", (F.col("n") - F.col("h") + F.col("taken")).alias("n"), "r0", "r1", "bytes")
    first = turns.where(F.col("n") < most).withColumnRenamed("conv_id", "source").join(plan.select("source", "conv_id", "h"), "source").where("n <= h")
    return rest.unionByName(first.select("conv_id", "n", "r0", "r1", "bytes")), plan.select("conv_id", "size")


def roster_of(turns: DataFrame) -> DataFrame:
    """(conv_id, size) of the conversations in numbered turns."""
    return turns.groupBy("conv_id").agg(F.max("n").alias("size"))


def _block() -> Column:
    return F.floor((F.col("n") - 1) / BLOCK).cast("long")


def prefixes(turns: DataFrame, roster: DataFrame) -> DataFrame:
    """(conv_id, n, size, d0, d1, e0, e1, bytes): a 128-bit rolling digest (d) of the first n turns of each conversation, and that of one fewer (e).

    A digest is the exclusive or of hashes of (n, turn), so blocks of a long conversation are digested apart and one digest per block
    carries them on. That of no turns is zero.
    """
    x = turns.select("*", _block().alias("block"), F.xxhash64("n", "r0", "r1").alias("x0"), F.xxhash64("r1", F.lit("second"), "n", "r0").alias("x1"))
    blocks = x.groupBy("conv_id", "block").agg(F.bit_xor("x0").alias("b0"), F.bit_xor("x1").alias("b1"))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.select("conv_id", "block", *[F.coalesce(F.bit_xor(f"b{i}").over(before), F.lit(0)).alias(f"c{i}") for i in (0, 1)])
    running = Window.partitionBy("conv_id", "block").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    within = x.select("*", *[F.bit_xor(f"x{i}").over(running).alias(f"w{i}") for i in (0, 1)]).join(carried, ["conv_id", "block"])
    digests = within.select("*", *[F.col(f"w{i}").bitwiseXOR(F.col(f"c{i}")).alias(f"d{i}") for i in (0, 1)])
    return digests.join(roster, "conv_id").select("conv_id", "n", "size", "d0", "d1", *[F.col(f"d{i}").bitwiseXOR(F.col(f"x{i}")).alias(f"e{i}") for i in (0, 1)], "bytes")


def _cells(d0: np.ndarray, d1: np.ndarray, row: int, bits: int) -> np.ndarray:
    """The cell of each digest in a row of the sketch."""
    mixed = (d0.astype(np.int64).view(np.uint64) + np.uint64(row) * d1.astype(np.int64).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(64 - bits)).astype(np.int64)


def _digests(batch: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in names]


def _sketch(digests: DataFrame, bits: int) -> np.ndarray:
    """A count-min sketch of (d0, d1) rows whose counters stop at two: ROWS rows of 2^bits counters of two bits.

    A task sends the cells it has hit, once or more often, as compressed gaps by slice; slices are added up in as many tasks and
    come to the driver packed: at most 48 MB, whatever the rows.
    """
    cut = min(bits, SLICE_BITS)
    slices = 1 << (bits - cut)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(held: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
            d0, d1 = (np.concatenate(parts) for parts in zip(*held, strict=True))
            keys, found = [], []
            for row in range(ROWS):
                cells, counts = np.unique(_cells(d0, d1, row, bits), return_counts=True)
                marks = ((cells & ((1 << cut) - 1)) << 1) | (counts > 1)
                ends = np.searchsorted(cells >> cut, np.arange(slices + 1))
                for s in np.flatnonzero(np.diff(ends)):
                    keys.append(row * slices + int(s))
                    found.append(zlib.compress(np.diff(marks[ends[s] : ends[s + 1]], prepend=0).astype(np.uint32).tobytes(), 1))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(found, pa.binary())], names=["slice", "hits"])

        held: list[list[np.ndarray]] = []
        for batch in batches:
            held.append(_digests(batch, "d0", "d1"))
            if sum(len(h[0]) for h in held) >= COUNT_AT_ONCE:
                yield from told(held)
                held = []
        if held:
            yield from told(held)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(key: int, counts: np.ndarray) -> pa.RecordBatch:
            four = counts.reshape(-1, 4)
            data = (four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6).astype(np.uint8).tobytes()
            return pa.RecordBatch.from_arrays([pa.array([key], pa.int32()), pa.array([data], pa.binary())], names=["slice", "counts"])

        at, counts = None, np.zeros(1 << cut, np.uint8)
        for batch in batches:
            for key, hits in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if key != at:
                    if at is not None:
                        yield packed(at, counts)
                    at, counts = key, np.zeros(1 << cut, np.uint8)
                marks = np.cumsum(np.frombuffer(zlib.decompress(hits), np.uint32).astype(np.int64))
                cells = marks >> 1
                counts[cells] = np.minimum(counts[cells] + 1 + (marks & 1), 2)
        if at is not None:
            yield packed(at, counts)

    parts = map_rows(digests.select("d0", "d1"), count, "slice int, hits binary")
    merged = map_rows(parts.repartition("slice").sortWithinPartitions("slice"), add, "slice int, counts binary").toArrow()
    sketch = np.zeros((ROWS * slices, (1 << cut) // 4), np.uint8)
    for key, data in zip(merged.column(0).to_pylist(), merged.column(1).to_pylist(), strict=True):
        sketch[key] = np.frombuffer(data, np.uint8)
    return sketch.reshape(ROWS, -1)


def screened(chains: DataFrame) -> DataFrame:
    """``chains`` (from ``prefixes``) with two marks: ``alone`` if no other conversation can have the prefix, ``above`` if none can have the one a turn shorter.

    Counts in a count-min sketch are never too small, so an estimate of one is a proof. The sketch has four cells a row for each prefix,
    up to 2^26; a larger corpus fills it, which proves less and leaves more to exact grouping, with the same result.
    """
    bits = min(MOST_BITS, max(2, int(chains.count() * SPARE - 1).bit_length()))
    sketch = chains.sparkSession.sparkContext.broadcast(_sketch(chains, bits))

    def once(d0: np.ndarray, d1: np.ndarray) -> np.ndarray:
        least = np.full(len(d0), 3, np.uint8)
        for row in range(ROWS):
            cells = _cells(d0, d1, row, bits)
            least = np.minimum(least, (sketch.value[row][cells >> 2] >> (2 * (cells & 3)).astype(np.uint8)) & 3)
        return least == 1

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d0, d1, e0, e1, n = _digests(batch, "d0", "d1", "e0", "e1", "n")
            columns = [*batch.columns, pa.array(once(d0, d1)), pa.array((n > 1) & once(e0, e1))]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "alone", "above"])

    return map_rows(chains, mark, f"{', '.join(f'{c} {t}' for c, t in chains.dtypes)}, alone boolean, above boolean")


def _member_hashes(ends: DataFrame) -> DataFrame:
    """(n, d0, d1, ends_sha256) of rows (n, d0, d1, conv_id): SHA-256 of each node's ids in ascending order, joined by commas.

    Ids are ranged by node and id, so those of a node with very many members are joined to strings in many tasks; the
    hash of a node then runs over its strings, one at a time.
    """
    key = ["n", "d0", "d1"]

    def runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[int, int, int], int, int]]:
        columns = np.stack(_digests(batch, *key))
        edges = [0, *(np.flatnonzero((np.diff(columns, axis=1) != 0).any(axis=0)) + 1).tolist(), batch.num_rows]
        for start, end in zip(edges, edges[1:], strict=False):
            if end > start:
                yield tuple(int(v) for v in columns[:, start]), start, end

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found = batch.column(3).to_pylist(), []
            for node, start, end in runs(batch):
                for at in range(start, end, IDS_AT_ONCE):
                    found.append((*node, ids[at], ",".join(map(str, ids[at : min(end, at + IDS_AT_ONCE)]))))
            if found:
                yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in list(zip(*found, strict=True))[:4]], pa.array([f[4] for f in found])], names=[*key, "first", "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(done: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*[pa.array([d[0][i] for d in done], pa.int64()) for i in range(3)], pa.array([d[1] for d in done])], names=[*key, "ends_sha256"])

        node, state = None, None
        for batch in batches:
            done, texts = [], batch.column(4)
            for found, start, end in runs(batch):
                for at in range(start, end):
                    data = texts[at].as_py().encode()
                    if found == node:
                        state.update(b"," + data)
                    else:
                        if node is not None:
                            done.append((node, state.hexdigest()))
                        node, state = found, hashlib.sha256(data)
            if done:
                yield told(done)
        if node is not None:
            yield told([(node, state.hexdigest())])

    ranged = ends.select(*key, "conv_id").repartitionByRange(*key, "conv_id").sortWithinPartitions(*key, "conv_id")
    strings = map_rows(ranged, join, "n long, d0 long, d1 long, first long, ids string")
    return map_rows(strings.repartition(*key).sortWithinPartitions(*key, "first"), digest, "n long, d0 long, d1 long, ends_sha256 string")


def _from_below(rows: DataFrame, values: list[str]) -> DataFrame:
    """Rows with the sums of ``values`` over the same conversation from their turn on, block by block. Null values count as zero."""
    rows = rows.withColumn("block", _block())
    blocks = rows.groupBy("conv_id", "block").agg(*[F.sum(v).alias(f"b_{v}") for v in values])
    after = Window.partitionBy("conv_id").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.select("conv_id", "block", *[F.coalesce(F.sum(f"b_{v}").over(after), F.lit(0)).alias(f"c_{v}") for v in values])
    within = Window.partitionBy("conv_id", "block").orderBy(F.desc("n")).rangeBetween(Window.unboundedPreceding, 0)
    summed = rows.withColumns({f"w_{v}": F.coalesce(F.sum(v).over(within), F.lit(0)) for v in values}).join(carried, ["conv_id", "block"])
    return summed.withColumns({v: F.col(f"w_{v}") + F.col(f"c_{v}") for v in values})


NO_IDS = hashlib.sha256(b"").hexdigest()


def trie(turns: DataFrame, roster: DataFrame) -> DataFrame:
    """The nodes of the prefix trie of numbered turns: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    A node is a distinct sequence of first turns (role, text); the root (depth 0) is the empty one, of which all conversations of
    ``roster`` (conv_id, size) are members. conv_id is a node's smallest member, parent_conv_id its parent's (null at the root);
    n_leaves counts childless nodes in its subtree, itself included; saved_tokens sums (members - 1) times the bytes of the last text
    over its subtree; ends_sha256 hashes the ids of members that end there. No conversation, no node.

    A prefix that the sketch proves to be of one conversation only is finished where it is, as are all below it: one member, one
    leaf, nothing saved. The first of such a tail looks up its parent; all other prefixes are grouped exactly by their digests.
    Sums over a subtree are sums over its members: what a node adds is booked once, on its smallest member, summed from the
    end of that conversation upwards, and added up by node with partial sums before the shuffle.
    """
    chains = staged(screened(staged(prefixes(turns, roster), "prefixes")), "screened")
    head = roster.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).first()
    schema = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
    if not head.n_convs:
        return roster.sparkSession.createDataFrame([], schema)
    key = ["n", "d0", "d1"]
    zero = F.lit(0).cast("long")
    last = F.col("n") == F.col("size")
    shared, tops = chains.where("NOT alone"), chains.where("alone AND NOT above")
    nodes = staged(
        shared.groupBy(*key).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("e0").alias("e0"), F.min("e1").alias("e1"), F.max("bytes").alias("bytes")),
        "nodes",
    )
    edges = nodes.select("n", "e0", "e1").unionByName(tops.select("n", "e0", "e1"))
    children = edges.where("n > 1").groupBy((F.col("n") - 1).alias("n"), F.col("e0").alias("d0"), F.col("e1").alias("d1")).agg(F.count("*").alias("n_children"))
    known = staged(nodes.join(children, key, "left").withColumn("n_children", F.coalesce("n_children", zero)), "known-nodes")

    booked = known.where("n_convs > 1 OR n_children = 0").select(
        "conv_id", "n", ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"), (F.col("n_children") == 0).cast("long").alias("leaves")
    ).unionByName(chains.where(F.col("alone") & last).select("conv_id", "n", zero.alias("saved"), F.lit(1).cast("long").alias("leaves")))
    below = _from_below(shared.select("conv_id", *key).unionByName(booked, allowMissingColumns=True), ["saved", "leaves"])
    sums = below.where("d0 IS NOT NULL AND (saved > 0 OR leaves > 0)").groupBy(*key).agg(F.sum("saved").alias("saved_tokens"), F.sum("leaves").alias("n_leaves"))

    turnless = roster.where("size = 0").select(zero.alias("n"), zero.alias("d0"), zero.alias("d1"), "conv_id")
    hashes = staged(_member_hashes(shared.where(last).select(*key, "conv_id").unionByName(turnless)), "member-hashes")

    grouped = known.join(sums, key, "left").join(hashes, key, "left").select(
        "conv_id", *key, "e0", "e1", "n_convs", "n_children", F.coalesce("n_leaves", zero).alias("n_leaves"),
        F.coalesce("saved_tokens", zero).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(NO_IDS)).alias("ends_sha256"),
    )
    own_hash = F.when(last, F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)).otherwise(NO_IDS).alias("ends_sha256")
    single = [F.lit(1).cast("long").alias("n_convs"), (~last).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), zero.alias("saved_tokens"), own_hash]
    upper = grouped.unionByName(tops.select("conv_id", *key, "e0", "e1", *single))
    parents = nodes.select((F.col("n") + 1).alias("n"), F.col("d0").alias("e0"), F.col("d1").alias("e1"), F.col("conv_id").alias("above"))
    # A parent that is no exact node was proven to be of one conversation: that of the row.
    parent = F.when(F.col("n") == 1, F.lit(head.conv_id)).otherwise(F.coalesce("above", "conv_id"))
    tail = chains.where("alone AND above").select("conv_id", F.col("n").alias("depth"), F.col("conv_id").alias("parent_conv_id"), *single)
    linked = upper.join(parents, ["n", "e0", "e1"], "left").select("conv_id", F.col("n").alias("depth"), parent.alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")

    totals = booked.agg(F.coalesce(F.sum("saved"), zero).alias("saved"), F.coalesce(F.sum("leaves"), zero).alias("leaves")).first()
    first_turns = edges.where("n = 1").count()
    ended = hashes.where("n = 0").first()
    root = [(head.conv_id, 0, None, head.n_convs, first_turns, totals.leaves or 1, totals.saved, ended.ends_sha256 if ended else NO_IDS)]
    return roster.sparkSession.createDataFrame(root, schema).unionByName(linked).unionByName(tail)


def build(conversations: DataFrame) -> DataFrame:
    """The prefix trie (see ``trie``) of a table (conv_id, turn, role, text) as it stands; other columns are ignored."""
    turns = staged(numbered(conversations), "numbered")
    return trie(turns, staged(roster_of(turns), "roster"))


def build_respliced(conversations: DataFrame, cycle: int = 5, most: int = 9) -> DataFrame:
    """The prefix trie of conversations whose first turns come from a neighbour (see ``respliced``)."""
    turns, roster = respliced(staged(numbered(conversations), "numbered"), cycle, most)
    return trie(turns, staged(roster, "roster"))


ORACLE = """
WITH steps AS (
  SELECT list(v ORDER BY k) AS tb FROM (
    SELECT k, list_reduce(list_prepend(k, range(8)::UBIGINT[]), lambda c, i: xor(c >> 1, (3988292384 * (c & 1))::UBIGINT)) AS v
    FROM (SELECT range::UBIGINT AS k FROM range(256)))),
own AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n, role, text
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
plan AS (
  SELECT conv_id, conv_id - conv_id % 5 AS source,
         CAST(xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(regexp_extract_all(hex(encode(CAST(conv_id AS VARCHAR))), '..'), lambda h: ('0x' || h)::UBIGINT)),
                              lambda c, b: xor(c >> 8, tb[CAST(xor(c, b) & 255 AS INTEGER) + 1])), 4294967295::UBIGINT) % 9 AS BIGINT) AS h
  FROM (SELECT DISTINCT conv_id FROM own), steps),
taken AS (
  SELECT plan.conv_id, n, role, text FROM plan JOIN own ON own.conv_id = plan.source AND n <= h),
moved AS (
  SELECT plan.conv_id, n - h + (SELECT count(*) FROM taken WHERE taken.conv_id = plan.conv_id) AS n, role, text
  FROM plan JOIN own ON own.conv_id = plan.conv_id AND n > h),
rebuilt AS (SELECT * FROM taken UNION ALL SELECT * FROM moved),
prefix AS (
  SELECT conv_id, n, text, CAST(list({'r': role, 't': text}) OVER (PARTITION BY conv_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS VARCHAR) AS p,
         n = max(n) OVER (PARTITION BY conv_id) AS ends
  FROM rebuilt
  UNION ALL
  SELECT conv_id, 0, '', '', NOT EXISTS (SELECT 1 FROM rebuilt WHERE rebuilt.conv_id = plan.conv_id) FROM plan),
node AS (
  SELECT n, p, min(conv_id) AS conv_id, count(*) AS n_convs, max(strlen(text)) AS bytes,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
  FROM prefix GROUP BY n, p),
edge AS (
  SELECT DISTINCT c.n, c.p, u.n AS un, u.p AS up FROM prefix c JOIN prefix u ON u.conv_id = c.conv_id AND u.n = c.n - 1),
kids AS (SELECT un AS n, up AS p, count(*) AS n_children FROM edge GROUP BY un, up),
full_node AS (
  SELECT node.*, coalesce(n_children, 0) AS n_children FROM node LEFT JOIN kids USING (n, p)),
below AS (
  SELECT a.n, a.p, sum((f.n_convs - 1) * f.bytes) AS saved, count(*) FILTER (WHERE f.n_children = 0) AS leaves
  FROM full_node f JOIN prefix m ON m.n = f.n AND m.p = f.p AND m.conv_id = f.conv_id
  JOIN prefix a ON a.conv_id = m.conv_id AND a.n <= m.n GROUP BY a.n, a.p)
SELECT f.conv_id, f.n AS depth, u.conv_id AS parent_conv_id, f.n_convs, f.n_children, b.leaves AS n_leaves, CAST(b.saved AS BIGINT) AS saved_tokens, f.ends_sha256
FROM full_node f JOIN below b USING (n, p) LEFT JOIN edge e ON e.n = f.n AND e.p = f.p LEFT JOIN node u ON u.n = e.un AND u.p = e.up
"""
