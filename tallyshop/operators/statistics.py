"""Statistics: moments, correlations, rank tests, contingency, mutual information, seasonality."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation, KolmogorovSmirnovTest
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyshop.functions.columns import count_if, dbl, flag, ratio
from tallyshop.functions.distributions import (
    chi_square_sf,
    correlation_p,
    correlation_t,
    normal_two_sided,
)
from tallyshop.functions.scale import lookup, percentile_rows, value_ranks, with_row_number
from tallyshop.operators.quality import long_values
from tallyshop.session import materialise


def moments(df: DataFrame, columns: list[str]) -> DataFrame:
    """Mean, sample standard deviation, bias-corrected skewness and excess kurtosis per column."""
    rows = long_values(df, columns).where("value IS NOT NULL")
    agg = rows.groupBy("column").agg(
        F.count("*").cast("double").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.skewness("value").alias("g1"), F.kurtosis("value").alias("g2"),
    )
    n = F.col("n")
    skew = F.sqrt(n * (n - 1)) / (n - 2) * F.col("g1")
    kurt = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("g2") + 6)
    return agg.select(
        "column", n.cast("long").alias("n"), "mean", "std",
        F.when(n > 2, skew).alias("skewness"), F.when(n > 3, kurt).alias("kurtosis"),
    )


def ks_normal(df: DataFrame, column: str) -> DataFrame:
    """Kolmogorov-Smirnov test of the standardised column against the standard normal."""
    stats = df.agg(F.struct(F.avg(dbl(column)).alias("m"), F.stddev_samp(dbl(column)).alias("s")).alias("x")).scalar()
    z = df.select(((dbl(column) - stats["m"]) / stats["s"]).alias("z")).where("z IS NOT NULL")
    result = KolmogorovSmirnovTest.test(z, "z", "norm", 0.0, 1.0)
    return result.select(F.lit(column).alias("column"), F.col("statistic"), F.col("pValue").alias("p_value"))


def pearson(df: DataFrame, x: Column | str, y: Column | str) -> DataFrame:
    """Pearson correlation with its t statistic and two-sided p-value."""
    both = dbl(x).isNotNull() & dbl(y).isNotNull()
    agg = df.agg(count_if(both).alias("n"), F.corr(dbl(x), dbl(y)).alias("r"))
    return agg.select("n", "r", correlation_t("r", "n").alias("t"), correlation_p("r", "n").alias("p_value"))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Spearman correlation: Pearson over average ranks.

    Rows are collapsed to (x, y, count); ranks join those, and deviations are taken from the
    known mean rank (n + 1) / 2, which keeps large ranks exact.
    """
    known = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    cells = known.groupBy(F.col(x).alias("_x"), F.col(y).alias("_y")).agg(F.count("*").alias("w"))
    for axis in ("_x", "_y"):
        ranks = value_ranks(cells, axis, "w").select(axis, F.col("rank").alias(f"rank{axis}"))
        cells = lookup(cells, ranks, [axis], "inner")
    middle = (cells.agg(F.sum("w").alias("n")).scalar() + 1) / 2
    dx, dy = F.col("rank_x") - middle, F.col("rank_y") - middle
    agg = cells.agg(
        F.sum("w").alias("n"), F.sum(F.col("w") * dx * dy).alias("xy"), F.sum(F.col("w") * dx * dx).alias("xx"),
        F.sum(F.col("w") * dy * dy).alias("yy"),
    ).withColumn("r", F.try_divide("xy", F.sqrt("xx") * F.sqrt("yy")))
    return agg.select("n", "r", correlation_t("r", "n").alias("t"), correlation_p("r", "n").alias("p_value"))


def numeric_columns(df: DataFrame, exclude: tuple[str, ...] = ()) -> list[str]:
    """Names of the numeric columns of a table, sorted."""
    numeric = ("byte", "short", "integer", "long", "float", "double", "decimal")
    return sorted(f.name for f in df.schema.fields if f.name not in exclude and f.dataType.typeName().split("(")[0] in numeric)


def correlation_pairs(df: DataFrame, columns: list[str]) -> DataFrame:
    """Correlation of every pair of columns; the matrix is columns × columns, whatever the rows.

    Columns are standardised first, so that large means cost no digits. Rows with a null in any column are left out;
    constant columns give NULL.
    """
    rows = df.select(*[dbl(c).alias(c) for c in columns]).dropna()
    stats = {
        r["column"]: r
        for r in long_values(rows, columns).groupBy("column").agg(
            F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), (F.min("value") < F.max("value")).alias("moves")
        ).collect()
    }  # one row per column
    moving = [c for c in columns if c in stats and stats[c]["moves"]]
    place = {c: i for i, c in enumerate(moving)}
    if moving:
        scaled = rows.select(*[((F.col(c) - stats[c]["mean"]) / stats[c]["std"]).alias(c) for c in moving])
        vectors = VectorAssembler(inputCols=moving, outputCol="_vector").transform(scaled)
        matrix = Correlation.corr(vectors, "_vector").first()[0].toArray()
    pairs = [
        (a, b, float(matrix[place[a], place[b]]) if a in place and b in place else None)
        for i, a in enumerate(columns)
        for b in columns[i + 1 :]
    ]
    return df.sparkSession.createDataFrame(pairs, "feature_a string, feature_b string, r double")


def top_pairs(pairs: DataFrame, k: int = 20, positive: bool = True) -> DataFrame:
    """The k most positive or most negative pairs."""
    order = F.col("r").desc_nulls_last() if positive else F.col("r").asc_nulls_last()
    sign = F.col("r") > 0 if positive else F.col("r") < 0
    return pairs.where(sign).orderBy(order, "feature_a", "feature_b").limit(k)


def line_fit(df: DataFrame, x: Column | str, y: Column | str) -> DataFrame:
    """Slope, intercept and R² of a straight line."""
    return df.agg(
        F.regr_slope(dbl(y), dbl(x)).alias("slope"), F.regr_intercept(dbl(y), dbl(x)).alias("intercept"),
        F.regr_r2(dbl(y), dbl(x)).alias("r2"),
    )


def cogs_ratio(sales: DataFrame) -> DataFrame:
    """Mean and deviation of COGS over revenue, and the two-deviation band."""
    r = ratio("COGS", "Revenue")
    agg = sales.agg(F.count("*").alias("days"), F.avg(r).alias("mean"), F.stddev_samp(r).alias("std"))
    return agg.select(
        "days", "mean", "std", (F.col("mean") - 2 * F.col("std")).alias("low"), (F.col("mean") + 2 * F.col("std")).alias("high")
    )


# --- rank tests ------------------------------------------------------------------------------


def group_ranks(df: DataFrame, value: str, group: str) -> DataFrame:
    """Rows, rank sum per group, and the tie term, from counts of (value, group)."""
    known = df.where(F.col(value).isNotNull() & F.col(group).isNotNull())
    cells = known.groupBy(value, group).agg(F.count("*").alias("w"))
    ranked = lookup(cells, value_ranks(cells, value, "w"), [value], "inner")
    # every row of a tie of size t carries t² − 1; over the tie that is t³ − t
    tie = F.col("ties").cast("double") * F.col("ties") - 1
    return ranked.groupBy(group).agg(
        F.sum("w").cast("double").alias("n"), F.sum(F.col("w") * F.col("rank")).alias("rank_sum"), F.sum(F.col("w") * tie).alias("tie_sum")
    )


def kruskal_wallis(df: DataFrame, value: str, group: str) -> DataFrame:
    """Tie-corrected H, effect size and its level."""
    per_group = group_ranks(df, value, group)
    total = per_group.agg(
        F.sum("n").alias("n"), F.count("*").alias("k"),
        F.sum(F.col("rank_sum") * F.col("rank_sum") / F.col("n")).alias("q"), F.sum("tie_sum").alias("ties"),
    )
    n = F.col("n")
    raw = 12 / (n * (n + 1)) * F.col("q") - 3 * (n + 1)
    out = total.withColumn("H", raw / (1 - F.col("ties") / (n * n * n - n)))
    out = out.withColumn("epsilon_squared", (F.col("H") - F.col("k") + 1) / (n - F.col("k")))
    level = F.when(F.col("epsilon_squared") >= 0.16, "large").when(F.col("epsilon_squared") >= 0.04, "medium").otherwise("small")
    return out.select(
        F.lit(group).alias("grouping"), n.cast("long").alias("n"), F.col("k").alias("groups"), "H", "epsilon_squared",
        level.alias("level"),
    )


def kruskal_p_value(result: DataFrame) -> DataFrame:
    """Adds the p-value of H: chi-square with one degree of freedom less than there are groups."""
    return result.withColumn("p_value", chi_square_sf("H", F.col("groups") - 1))


def dunn_posthoc(df: DataFrame, value: str, group: str) -> DataFrame:
    """z and Bonferroni p of each pair of groups, from mean ranks.

    Groups are numbered; each asks for the numbers above its own, which an equality join answers, so pairs spread over tasks.
    """
    stats = materialise(group_ranks(df, value, group).select(F.col(group).alias("g"), (F.col("rank_sum") / F.col("n")).alias("mean"), "n", "tie_sum"))
    sums = stats.agg(F.struct(F.sum("n").alias("N"), F.sum("tie_sum").alias("ties"), F.count("*").alias("k")).alias("s")).scalar()
    numbered = materialise(with_row_number(stats, ["g"], "i"))
    k = sums["k"]
    asked = numbered.where(F.col("i") < k).select(F.struct("g", "mean", "n").alias("a"), F.explode(F.sequence(F.col("i") + 1, k)).alias("j"))
    pairs = asked.join(numbered.select(F.col("i").alias("j"), F.struct("g", "mean", "n").alias("b")), "j").select(
        "a", "b", sums["N"].alias("N"), sums["ties"].alias("ties"), (k * (k - 1) / 2).alias("comparisons")
    )
    variance = (F.col("N") * (F.col("N") + 1) / 12 - F.col("ties") / (12 * (F.col("N") - 1))) * (1 / F.col("a.n") + 1 / F.col("b.n"))
    z = (F.col("a.mean") - F.col("b.mean")) / F.sqrt(variance)
    return pairs.select(
        F.col("a.g").alias("group_a"), F.col("b.g").alias("group_b"), z.alias("z"),
        F.least(F.lit(1.0), normal_two_sided(z) * F.col("comparisons")).alias("p_bonferroni"),
    )


def chi_square(df: DataFrame, row: str, column: str) -> DataFrame:
    """Contingency χ² without Yates correction: N (Σ o²/(r·c) − 1), so empty cells need no rows."""
    cells = materialise(
        df.where(F.col(row).isNotNull() & F.col(column).isNotNull()).groupBy(row, column).agg(F.count("*").cast("double").alias("o"))
    )  # one row per cell; margins, total and sizes all read it
    rows = cells.groupBy(row).agg(F.sum("o").alias("r"))
    columns = cells.groupBy(column).agg(F.sum("o").alias("c"))
    n = cells.agg(F.sum("o").alias("n")).scalar()
    sizes = rows.agg(F.count("*").alias("k")).scalar(), columns.agg(F.count("*").alias("k")).scalar()
    joined = lookup(lookup(cells, rows, [row]), columns, [column])
    total = joined.agg(F.sum(F.col("o") * F.col("o") / (F.col("r") * F.col("c"))).alias("s"))
    return total.select(
        (n * (F.col("s") - 1)).alias("chi2"), ((sizes[0] - 1) * (sizes[1] - 1)).cast("long").alias("dof"),
        n.cast("long").alias("n"),
    )


# --- mutual information ------------------------------------------------------------------------


def binned_mutual_information(df: DataFrame, features: list[str], target: Column, bins: int = 8) -> DataFrame:
    """Mutual information (nats) of each feature with a target, both in equal-frequency bins.

    Edges are exact percentiles, bins are closed on the right; only bin counts are shuffled. A null leaves its feature's row out.
    """
    probabilities = [i / bins for i in range(1, bins)]
    data = df.select(*[dbl(f).alias(f) for f in features], dbl(target).alias("_target"))
    values = long_values(data, [*features, "_target"])
    edges = percentile_rows(values, "value", probabilities, ("column",), few_groups=True).groupBy("column").agg(
        F.sort_array(F.collect_list("value")).alias("edges")
    )
    packed = edges.agg(F.map_from_entries(F.collect_list(F.struct("column", "edges"))).alias("m"))
    table = packed.select(
        F.explode("m").alias("feature", "x_edges"), F.col("m")["_target"].alias("y_edges")
    ).where("feature <> '_target'")  # one row per feature

    def bin_of(value: str, inner: str) -> Column:
        return F.size(F.filter(inner, lambda e: e < F.col(value)))

    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("x_value")) for f in features])
    rows = data.select(F.col("_target").alias("y_value"), F.inline(pairs)).where("x_value IS NOT NULL AND y_value IS NOT NULL")
    binned = rows.join(F.broadcast(table), "feature").select(
        "feature", bin_of("x_value", "x_edges").alias("x"), bin_of("y_value", "y_edges").alias("y")
    )
    joint = binned.groupBy("feature", "x", "y").agg(F.count("*").cast("double").alias("n"))
    by_feature, by_x, by_y = (Window.partitionBy(*k) for k in (["feature"], ["feature", "x"], ["feature", "y"]))
    n, nx, ny = (F.sum("n").over(w) for w in (by_feature, by_x, by_y))  # bins × bins rows
    terms = joint.select("feature", (F.col("n") / n * F.log(F.col("n") * n / (nx * ny))).alias("t"))
    return terms.groupBy("feature").agg(F.sum("t").alias("mi"))


def mutual_information(daily: DataFrame, features: list[str], target: str, era_start: str, bins: int = 8, useless: float = 0.01) -> DataFrame:
    """Mutual information over the whole history and over a recent era: change, ranks, useless flag."""
    goal = F.log1p(dbl(target))
    full = binned_mutual_information(daily, features, goal, bins).withColumnRenamed("mi", "mi_full")
    recent = daily.where(F.col("date") >= F.lit(era_start).cast("date"))
    era = binned_mutual_information(recent, features, goal, bins).withColumnRenamed("mi", "mi_era")
    both = full.join(era, "feature")
    rank = [F.row_number().over(Window.orderBy(F.round(m, 9).desc(), "feature")) for m in ("mi_full", "mi_era")]
    return both.select(
        "feature", "mi_full", "mi_era", (F.col("mi_era") - F.col("mi_full")).alias("delta"),
        rank[0].alias("rank_full"), rank[1].alias("rank_era"),
        flag((F.col("mi_full") < useless) & (F.col("mi_era") < useless)).alias("useless"),
    )  # one row per feature


# --- seasonality ---------------------------------------------------------------------------------


def decompose(daily: DataFrame, value: str, series: str = "series_id", period: int = 365) -> DataFrame:
    """Classical decomposition per series: centred moving mean, mean by day of year, remainder."""
    half = period // 2
    order = Window.partitionBy(series).orderBy("date")  # one row per day of a series
    centred = order.rowsBetween(-half, half)
    trend = F.when(F.count(value).over(centred) == 2 * half + 1, F.avg(value).over(centred))
    out = daily.withColumn("trend", trend)
    by_day = Window.partitionBy(series, F.dayofyear("date"))
    out = out.withColumn("seasonal", F.avg(F.col(value) - F.col("trend")).over(by_day))
    return out.withColumn("residual", F.col(value) - F.col("trend") - F.col("seasonal"))


def seasonal_strengths(daily: DataFrame, value: str, series: str = "series_id", period: int = 365) -> DataFrame:
    """Deviation of each component over the deviation of the series."""
    parts = decompose(daily, value, series, period)
    spread = F.stddev_samp(value)
    return parts.groupBy(series).agg(
        *[F.try_divide(F.stddev_samp(c), spread).alias(f"{c}_strength") for c in ("trend", "seasonal", "residual")]
    )

