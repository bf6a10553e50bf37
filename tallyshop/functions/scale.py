"""Global order, running totals, exact percentiles and skew-safe lookups at any size.

None of these gathers a whole table, or an unbounded group, into one task: rows are range
partitioned on a total order, each partition works on its own rows, and only one total per
partition crosses over.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyshop.functions.columns import col, dbl
from tallyshop.session import materialise, released_shuffles


# Buckets of a running total per shuffle partition, sampled rows per bucket, and the most buckets.
BUCKETS, SAMPLED, MOST_BUCKETS = 4, 20, 2000

# An order column: ascending with nulls first, or descending with nulls last as ("column", "desc") or F.col("column").desc().
Order = Column | str | tuple[Column | str, str]


def _direction(order: Order) -> tuple[Column, bool]:
    """The expression to order by, and whether it falls."""
    if isinstance(order, tuple):
        if order[1] != "desc":
            raise ValueError("an order is a column or (column, 'desc')")
        return col(order[0]), True
    if isinstance(order, Column) and (sort := re.fullmatch(r"Column<'(.*) (ASC|DESC) NULLS (FIRST|LAST)'>", str(order))):
        name, way, nulls = sort.groups()
        if not re.fullmatch(r"\w+", name) or (way, nulls) not in (("ASC", "FIRST"), ("DESC", "LAST")):
            raise ValueError(f"say {order} as a column or (column, 'desc')")
        return F.col(name), way == "DESC"
    return col(order), False


def _falling(c: Column, kind: str) -> list[Column]:
    """Columns whose ascending order is the descending order of ``c``, nulls last."""
    if kind in ("byte", "short", "integer", "long"):
        return [c.isNull(), F.bitwise_not(c)]
    if kind == "date":
        return [c.isNull(), F.bitwise_not(F.unix_date(c))]
    if kind in ("float", "double"):
        return [F.when(c.isNull(), 2).when(F.isnan(c), 0).otherwise(1), -c]
    if kind.startswith("decimal"):
        return [c.isNull(), -c]
    raise ValueError(f"no descending order over {kind} columns")


def _edges_passed(edges: str, key: Column, most: int) -> Column:
    """How many of at most ``most`` rising edges lie at or below the key, by binary search: steps of falling powers of two."""
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(most.bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(edges, at + step - 1) <= key, at + step).otherwise(at))


def global_running(df: DataFrame, order: list[Order], sums: dict[str, Column | str]) -> DataFrame:
    """Running totals of the whole table in ``order`` (which must be total, i.e. end in a key).

    Adds one column per entry of ``sums``: the total of that expression up to and including
    the row. ``F.lit(1)`` gives the global row number. The table is written once to the checkpoint folder. Rows are put into
    buckets between the edges of a sample (twenty rows per bucket, 40,000 at most), move once, to their bucket, are summed there in order,
    and get the total of the buckets before theirs.
    """
    spark = df.sparkSession
    values = {f"_v_{name}": col(expr) for name, expr in sums.items()}
    parts = [_direction(o) for o in order]
    written = materialise(df.withColumns({**values, **{f"_k{i}": c for i, (c, _) in enumerate(parts)}}))
    keys = [F.col(f"_k{i}") for i in range(len(parts))]
    kinds = [written.schema[f"_k{i}"].dataType.typeName() for i in range(len(parts))]
    rising = [c for k, kind, (_, falls) in zip(keys, kinds, parts, strict=True) for c in (_falling(k, kind) if falls else [k])]
    key = F.struct(*[c.alias(f"f{i}") for i, c in enumerate(rising)])
    buckets = min(BUCKETS * int(spark.conf.get("spark.sql.shuffle.partitions")), MOST_BUCKETS)
    sample = written.select(key.alias("key")).orderBy(F.xxhash64("key"), "key").limit(SAMPLED * buckets)
    ranked = sample.select("key", (F.row_number().over(Window.orderBy("key")) - 1).alias("at"), F.count("*").over(Window.partitionBy()).alias("n"))
    # row at of n opens bucket floor(at * buckets / n) if the row before it lies in an earlier one
    opens = ranked.where(F.floor(F.col("at") * buckets / F.col("n")) > F.floor((F.col("at") - 1) * buckets / F.col("n"))).where("at > 0")
    edges = opens.agg(F.sort_array(F.collect_list("key")).alias("edges")).scalar()  # less than ``buckets`` of them
    placed = written.withColumn("_edges", edges).withColumn("_part", _edges_passed("_edges", key, buckets)).drop("_edges")
    totals = placed.groupBy("_part").agg(*[F.sum(v).alias(f"_t{v}") for v in values])
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_part", *[F.sum(f"_t{v}").over(before).alias(f"_o{v}") for v in values])
    sorting = [k.desc() if falls else k for k, (_, falls) in zip(keys, parts, strict=True)]
    local = Window.partitionBy("_part").orderBy(*sorting).rowsBetween(Window.unboundedPreceding, 0)
    running = placed.withColumns({f"_l{v}": F.sum(v).over(local) for v in values})
    # one row per bucket, whatever the size of the data
    joined = running.join(F.broadcast(offsets), "_part")
    done = {
        name: F.col(f"_l_v_{name}") + F.coalesce(F.col(f"_o_v_{name}"), F.lit(0).cast("int"))
        for name in sums
    }
    return joined.select(*df.columns, *[expr.alias(name) for name, expr in done.items()])


def with_row_number(df: DataFrame, order: list[Order], name: str = "rn") -> DataFrame:
    """Global row number 1..n in a total order."""
    return global_running(df, order, {name: F.lit(1).cast("long")})


def percentile_rows(
    df: DataFrame, value: Column | str, probabilities: list[float], by: tuple[str, ...] = (), few_groups: bool = False
) -> DataFrame:
    """Exact percentiles with linear interpolation, one row per group and probability.

    Returns ``by..., probability, value``. Rows are first collapsed to (value, count), then
    placed by a global running count, so no task ever holds all values of a group.
    ``few_groups`` promises that the groups are few whatever the data (column names), so that
    their totals may be broadcast.
    """
    counts = (
        df.select(*by, dbl(value).alias("_value"))
        .where(F.col("_value").isNotNull())
        .groupBy(*by, "_value")
        .agg(F.count("*").alias("_n"))
    )
    placed = global_running(counts, [*by, "_value"], {"_to": "_n"})
    placed = placed.withColumn("_from", F.col("_to") - F.col("_n"))
    groups = placed.groupBy(*by).agg(F.min("_from").alias("_start"), F.sum("_n").alias("_total"))
    if by:
        groups = F.broadcast(groups) if few_groups else groups
        keys = [F.col(f"p.{b}").eqNullSafe(F.col(f"g.{b}")) for b in by]
        joined = placed.alias("p").join(groups.alias("g"), keys).select("p.*", "_start", "_total")
    else:
        joined = placed.withColumns(
            {"_start": F.lit(0), "_total": groups.select("_total").scalar()}
        )
    joined = joined.withColumns(
        {"_first": F.col("_from") - F.col("_start"), "_past": F.col("_to") - F.col("_start")}
    )
    points = F.array(*[F.lit(float(p)) for p in probabilities])
    hits = F.filter(
        F.transform(
            points,
            lambda p: F.struct(
                p.alias("probability"), (p * (F.col("_total") - 1)).alias("position")
            ),
        ),
        lambda s: (F.ceil(s["position"]) >= F.col("_first"))
        & (F.floor(s["position"]) < F.col("_past")),
    )
    near = joined.withColumn("_hit", F.explode(hits))
    low = (F.floor("_hit.position") >= F.col("_first")) & (F.floor("_hit.position") < F.col("_past"))
    high = (F.ceil("_hit.position") >= F.col("_first")) & (F.ceil("_hit.position") < F.col("_past"))
    ends = near.groupBy(*by, F.col("_hit.probability").alias("probability")).agg(
        F.max(F.when(low, F.col("_value"))).alias("_low"),
        F.max(F.when(high, F.col("_value"))).alias("_high"),
        F.max("_hit.position").alias("_position"),
    )
    share = F.col("_position") - F.floor("_position")
    return ends.select(
        *by, "probability", (F.col("_low") + (F.col("_high") - F.col("_low")) * share).alias("value")
    )


def percentile_table(
    df: DataFrame, value: Column | str, named: dict[str, float], by: tuple[str, ...] = (), few_groups: bool = False
) -> DataFrame:
    """Exact percentiles as columns: one row per group, one column per name."""
    rows = percentile_rows(df, value, sorted(set(named.values())), by, few_groups)
    return rows.groupBy(*by).agg(
        *[F.max(F.when(F.col("probability") == p, F.col("value"))).alias(n) for n, p in named.items()]
    )


def percentile_scalar(df: DataFrame, value: Column | str, probability: float) -> Column:
    """One exact percentile as a scalar-subquery column."""
    return percentile_rows(df, value, [probability]).select("value").scalar()


def percentile_edges(df: DataFrame, value: Column | str, probabilities: list[float]) -> Column:
    """Exact percentiles of a table as one array-valued scalar-subquery column."""
    rows = percentile_rows(df, value, probabilities)
    ordered = F.sort_array(F.collect_list(F.struct("probability", "value")))  # one per probability
    return rows.agg(F.transform(ordered, lambda s: s["value"]).alias("edges")).scalar()


def small_domain_edges(df: DataFrame, value: str, probabilities: list[float]) -> Column:
    """Percentiles of a column of few distinct values (days, counts): one aggregate over its counts."""
    counts = df.groupBy(value).agg(F.count("*").alias("_n"))
    points = F.array(*[F.lit(float(p)) for p in probabilities])
    return counts.agg(F.percentile(value, points, F.col("_n")).alias("edges")).scalar()


def value_ranks(counts: DataFrame, value: str, n: str) -> DataFrame:
    """Average rank of each distinct value from a table of (value, count); adds its ``ties``.

    A value that a third of the rows share is one row of the ordering.
    """
    collapsed = counts.groupBy(value).agg(F.sum(n).alias("ties"))
    placed = global_running(collapsed, [value], {"_to": "ties"})
    return placed.select(value, (F.col("_to") - (F.col("ties") - 1) / 2).cast("double").alias("rank"), "ties")


def frequent_keys(df: DataFrame, key: str, share: float) -> list:
    """Keys that hold more than ``share`` of the rows (so at most 1/share of them)."""
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n").alias("_t")).scalar()
    hot = counts.where(F.col("_n") > total * share).select(key)
    with released_shuffles(df.sparkSession):
        return [row[0] for row in hot.collect()]


def lookup(fact: DataFrame, dimension: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """Join a fact to a dimension with one row per key.

    No broadcast is forced: Catalyst and AQE broadcast the dimension when its estimated or
    measured size is below the session threshold, and AQE splits skewed fact partitions else.
    """
    return fact.join(dimension, on, how)


def salted_lookup(
    fact: DataFrame, dimension: DataFrame, key: str, share: float = 0.01, salts: int = 32
) -> DataFrame:
    """Left lookup for a large dimension and a fact with hot keys.

    Rows of hot keys are spread over ``salts`` partitions by a hash of the whole row; only the
    dimension rows of those (at most 1/share) keys are repeated. The fact is read twice, first to find them: give a narrow one.
    """
    hot = frequent_keys(fact, key, share)
    is_hot = F.col(key).isin(hot) if hot else F.lit(False)
    spread = F.pmod(F.xxhash64(*[F.col(c) for c in fact.columns]), F.lit(salts)).cast("int")
    salted = fact.withColumn("_salt", F.when(is_hot, spread).otherwise(0))
    copies = F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    repeated = dimension.withColumn("_salt", F.explode(copies))
    return salted.join(repeated, [key, "_salt"], "left").drop("_salt")
