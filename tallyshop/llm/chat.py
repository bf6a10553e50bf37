"""Chat formatting: logged snapshots of a growing conversation collapse before rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyshop.llm.common import staged

TURNS_PER_PART = 256


def _hash_parts(*columns: Column) -> list[Column]:
    """Two 64-bit hashes in 32-bit halves: halves can be summed over 2^31 turns without overflow."""
    low, high = F.xxhash64(F.lit("a"), *columns), F.xxhash64(*columns, F.lit("b"))
    return [part for h in (low, high) for part in (h.bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned(h, 32))]


def _block(turn: Column) -> Column:
    return F.floor(F.coalesce(turn, F.lit(-1)) / TURNS_PER_PART).cast("long")


def rolling_hashes(conversations: DataFrame) -> DataFrame:
    """(conv_id, n, h0..h3): turns numbered from 1, with the rolling hash of all turns up to each.

    Texts stay behind: a turn is a few hashes of its role and text. Turns are numbered and summed inside ranges of
    ``TURNS_PER_PART`` turn numbers, so one conversation spreads over many tasks, and a window over one row per range
    carries both on. The hash of a turn covers its number, so the sum depends on the order.
    """
    role, text = (F.struct(F.col(c).isNull(), F.col(c)) for c in ("role", "text"))
    turns = conversations.select(
        "conv_id", "turn", _block(F.col("turn")).alias("block"), F.xxhash64(role).alias("r"),
        F.xxhash64(text).alias("t"), F.xxhash64(text, F.lit("second")).alias("t2"),
    ).distinct()
    inside = Window.partitionBy("conv_id", "block").orderBy(F.col("turn").asc_nulls_first(), "r", "t", "t2")
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    same = F.col("l.conv_id").eqNullSafe(F.col("r.conv_id")) & (F.col("l.block") == F.col("r.block"))
    sizes = turns.groupBy("conv_id", "block").agg(F.count("*").alias("size"))
    offsets = sizes.select("conv_id", "block", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset"))
    local = turns.withColumn("at", F.row_number().over(inside)).alias("l").join(offsets.alias("r"), same)
    numbered = local.select("l.conv_id", "l.block", (F.col("at") + F.col("offset")).alias("n"), F.col("l.r").alias("r"), "t", "t2")
    hashed = numbered.select("conv_id", "block", "n", *[h.alias(f"x{i}") for i, h in enumerate(_hash_parts(F.col("n"), F.col("r"), F.col("t"), F.col("t2")))])
    running = Window.partitionBy("conv_id", "block").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    sums = hashed.groupBy("conv_id", "block").agg(*[F.sum(f"x{i}").alias(f"s{i}") for i in range(4)])
    carried = sums.select("conv_id", "block", *[F.coalesce(F.sum(f"s{i}").over(before), F.lit(0)).alias(f"c{i}") for i in range(4)])
    within = hashed.select("*", *[F.sum(f"x{i}").over(running).alias(f"w{i}") for i in range(4)]).alias("l")
    return within.join(carried.alias("r"), same).select("l.conv_id", "n", *[(F.col(f"w{i}") + F.col(f"c{i}")).alias(f"h{i}") for i in range(4)])


def maximal(turns: DataFrame) -> DataFrame:
    """(conv_id, turns) of the conversations that are no prefix of a longer one; of equal ones the smallest id.

    ``turns`` comes from ``rolling_hashes``. The last rolling hash of a conversation stands for the whole; it is
    removed by an anti-join if some longer conversation has the same hash at the same turn number.
    """
    key = ["n", "h0", "h1", "h2", "h3"]
    lengths = turns.groupBy("conv_id").agg(F.max("n").alias("last"))
    marked = turns.select("conv_id", *key).alias("t").join(lengths.alias("l"), F.col("t.conv_id").eqNullSafe(F.col("l.conv_id"))).select("t.*", "last")
    whole = marked.where("n = last").groupBy(*key).agg(F.min("conv_id").alias("conv_id"))
    inner = marked.where("n < last").select(*key).distinct()
    return whole.join(inner, key, "left_anti").select("conv_id", F.col("n").alias("turns"))


def render(conversations: DataFrame) -> DataFrame:
    """Maximal conversations as training text: conv_id, part, n_turns (of the part), text.

    A turn reads ``<|role|>``, a newline, its text and ``<|end|>``. A part holds the turns of 256 turn numbers (part 0
    those from 0 to 255), so a long log never has to fit into one row; almost all conversations are one part.

    Turns are ordered by ``turn`` (nulls first, in part -1), then role and text; rows repeated in full count once. A null
    role renders as ``unknown`` and a null text as nothing, but neither equals an actual empty one in comparisons. Rows
    with a null conv_id form one conversation. A conversation with the turns of another, or with the first
    of them only, is left out; of equal ones that with the smallest id stays. An empty table gives no rows; other
    columns are ignored.
    """
    kept = staged(maximal(staged(rolling_hashes(conversations), "turn-hashes")).select("conv_id"), "maximal")
    rows = conversations.select("conv_id", "turn", "role", "text").alias("t")
    own = rows.join(kept.alias("k"), F.col("t.conv_id").eqNullSafe(F.col("k.conv_id")), "left_semi")
    turns = own.groupBy("conv_id", _block(F.col("turn")).cast("int").alias("part")).agg(
        F.array_sort(F.collect_set(F.struct("turn", "role", "text"))).alias("turns")
    )

    def line(turn: Column) -> Column:
        return F.concat(F.lit("<|"), F.coalesce(turn["role"], F.lit("unknown")), F.lit("|>\n"), F.coalesce(turn["text"], F.lit("")), F.lit("<|end|>\n"))

    return turns.select("conv_id", "part", F.size("turns").cast("long").alias("n_turns"), F.array_join(F.transform("turns", line), "").alias("text"))


ORACLE = """
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS n, turn, role, text
  FROM (SELECT DISTINCT conv_id, turn, role, text FROM conversations)),
p AS (
  SELECT conv_id, n, max(n) OVER (PARTITION BY conv_id) AS last,
         list({'r': role, 't': text}) OVER (PARTITION BY conv_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS turns
  FROM t),
kept AS (
  SELECT min(w.conv_id) AS conv_id
  FROM (SELECT conv_id, n, md5(CAST(turns AS VARCHAR)) AS h, turns FROM p WHERE n = last) w
  ANTI JOIN (SELECT DISTINCT n, turns FROM p WHERE n < last) i ON w.n = i.n AND w.turns = i.turns
  GROUP BY w.turns)
SELECT conv_id, CAST(floor(coalesce(turn, -1) / 256.0) AS INTEGER) AS part, count(*) AS n_turns,
       string_agg('<|' || coalesce(role, 'unknown') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10), '' ORDER BY n) AS text
FROM t WHERE EXISTS (SELECT 1 FROM kept WHERE kept.conv_id IS NOT DISTINCT FROM t.conv_id)
GROUP BY conv_id, floor(coalesce(turn, -1) / 256.0)
"""
