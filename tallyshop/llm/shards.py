"""Sharding by rendezvous hashing: every record goes to the shard that its key scores best with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyshop.llm.common import staged

SHARDS = 40
# Hex digits of the key's digest by which a shard is cut into ranges for numbering: 256 ranges a shard.
RANGE_DIGITS = 2
# Hex digits of a digest that make a score: 52 bits fill the mantissa of a double.
SCORE_DIGITS = 13


def _key(key: str) -> Column:
    return F.coalesce(F.col(key).cast("string"), F.lit(""))


def _scores(key: Column, weights: list[float]) -> Column:
    """(score, shard) of each shard: -ln(u) / weight for u in (0, 1) from the MD5 of ``key:shard``; the lowest wins.

    -ln(u) / weight is an exponential variable of that rate, so a shard wins with a chance in proportion to its weight.
    """
    rates = F.array(*[F.lit(float(w)) for w in weights])

    def score(shard: Column) -> Column:
        digits = F.substring(F.md5(F.concat(key, F.lit(":"), shard.cast("string")).cast("binary")), 1, SCORE_DIGITS)
        u = (F.conv(digits, 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(16**SCORE_DIGITS))
        return F.struct((-F.log(u) / F.get(rates, shard)).alias("score"), shard.alias("shard"))

    return F.transform(F.sequence(F.lit(0), F.lit(len(weights) - 1)), score)


def _weights(shards: int, weights: list[float] | None) -> list[float]:
    found = [1.0] * shards if weights is None else [float(w) for w in weights]
    if shards < 1 or len(found) != shards or min(found) <= 0:
        raise ValueError("one positive weight per shard is needed")
    return found


def shard_of(key: str = "doc_id", shards: int = SHARDS, weights: list[float] | None = None) -> Column:
    """The shard (0 to ``shards`` - 1) of a key. It depends on the key, the number of shards and their weights alone.

    A further shard, or a larger weight of one shard, only moves records into that shard. A null key counts as the empty text.
    """
    return F.array_min(_scores(_key(key), _weights(shards, weights)))["shard"]


def assign(docs: DataFrame, shards: int = SHARDS, weights: list[float] | None = None, new_weight: float = 1.0) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard), one row per row of ``docs``.

    size is the text's UTF-8 bytes plus 16; text_crc32 its unsigned CRC-32; grown_shard the shard if one more of
    ``new_weight`` were there. Slots count from 0 without gaps in each shard, in the order of the first digits of the key's
    digest, then doc_id (null first), text_crc32 and size, so they do not depend on how the table is dealt out. A null text
    has size 16 and CRC 0, as the empty text has. Rows with one key share a shard; rows that are equal
    in all three values get slots side by side. An empty table gives no rows; other columns are ignored.

    Nothing about a shard meets in one task: copies of a record are counted per input partition first, ranges of a shard are
    numbered apart, and one total per range (shards times 256 rows) carries the numbers on. Rows are 60 bytes; texts stay behind.
    """
    scores = _scores(F.col("key"), [*_weights(shards, weights), float(new_weight)])
    rows = docs.select(
        "doc_id", _key("doc_id").alias("key"), (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), F.spark_partition_id().alias("part"),
    ).withColumn("scores", scores)
    placed = rows.select(
        "doc_id", "size", "text_crc32", "part", F.array_min(F.slice("scores", 1, shards))["shard"].alias("shard"),
        F.array_min("scores")["shard"].alias("grown_shard"), F.substring(F.md5(F.col("key").cast("binary")), 1, RANGE_DIGITS).alias("range"),
    )
    counted = staged(placed.groupBy(*placed.columns).agg(F.count("*").alias("copies")), "shards")
    before = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    totals = counted.groupBy("shard", "range").agg(F.sum("copies").alias("total"))
    starts = totals.select("shard", "range", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("start"))
    earlier = (
        Window.partitionBy("shard", "range").orderBy(F.col("doc_id").asc_nulls_first(), "text_crc32", "size", "part")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    numbered = counted.withColumn("first", F.coalesce(F.sum("copies").over(earlier), F.lit(0)))
    # shards times 16^RANGE_DIGITS rows at most, whatever the input
    joined = numbered.join(F.broadcast(starts), ["shard", "range"])
    copies = joined.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy"))
    return copies.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
        (F.col("start") + F.col("first") + F.col("copy")).alias("slot"), "grown_shard",
    )


def write(docs: DataFrame, folder: str, shards: int = SHARDS, weights: list[float] | None = None, rows_per_file: int = 1_000_000) -> None:
    """Write all columns of ``docs`` as Parquet, one folder ``shard=<number>`` per shard. A column ``shard`` of the input is replaced.

    Rows move once, to tasks that hold a part of one shard each, and files end after ``rows_per_file`` rows.
    """
    placed = docs.withColumn("shard", shard_of("doc_id", shards, weights))
    spread = F.pmod(F.xxhash64(*docs.columns, F.monotonically_increasing_id()), F.lit(8))
    placed.repartition("shard", spread).write.option("maxRecordsPerFile", rows_per_file).partitionBy("shard").parquet(folder)


ORACLE = """
WITH steps AS (
  SELECT list(v ORDER BY k) AS tb FROM (
    SELECT k, list_reduce(list_prepend(k, range(8)::UBIGINT[]), lambda c, i: xor(c >> 1, (3988292384 * (c & 1))::UBIGINT)) AS v
    FROM (SELECT range::UBIGINT AS k FROM range(256)))),
rows AS (
  SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), '') AS key, CAST(strlen(coalesce(text, '')) + 16 AS BIGINT) AS size,
         CAST(xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::UBIGINT)),
                              lambda c, b: xor(c >> 8, tb[CAST(xor(c, b) & 255 AS INTEGER) + 1])), 4294967295::UBIGINT) AS BIGINT) AS text_crc32
  FROM documents, steps),
scored AS (
  SELECT *, list_transform(range(41), lambda i: {'score': -ln((('0x' || substr(md5(key || ':' || i), 1, 13))::BIGINT + 0.5) / 4503599627370496.0), 'shard': CAST(i AS INTEGER)}) AS s
  FROM rows),
placed AS (
  SELECT doc_id, key, size, text_crc32, list_sort(s[1:40])[1].shard AS shard, list_sort(s)[1].shard AS grown_shard FROM scored)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY substr(md5(key), 1, 2), doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, grown_shard
FROM placed
"""
