"""Calendars: day spines, interval rows, gap filling and as-of values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyshop.functions.columns import col


def date_spine(spark: SparkSession, start: str, end: str, name: str = "date") -> DataFrame:
    """One row per day from ``start`` to ``end``, both included."""
    days = F.sequence(F.to_date(F.lit(start)), F.to_date(F.lit(end)))
    return spark.range(1).select(F.explode(days).alias(name))


def spine_of(df: DataFrame, date: str, name: str = "date") -> DataFrame:
    """One row per day from the first to the last day of a table."""
    bounds = df.agg(F.min(date).alias("_lo"), F.max(date).alias("_hi")).where("_lo IS NOT NULL")
    return bounds.select(F.explode(F.sequence("_lo", "_hi")).alias(name))


def explode_interval(df: DataFrame, start: str, end: str, name: str = "date") -> DataFrame:
    """One row per active day of an interval row; rows with ``end < start`` vanish."""
    valid = df.where(F.col(start) <= F.col(end))
    return valid.withColumn(name, F.explode(F.sequence(F.col(start), F.col(end))))


def align_to_calendar(df: DataFrame, date: str, fill: dict[str, object] | None = None, spine: DataFrame | None = None) -> DataFrame:
    """Add the missing days of a daily table as NULL rows (or with the given fills)."""
    days = spine if spine is not None else spine_of(df, date, date)
    out = days.join(df, date, "left")
    return out.fillna(fill) if fill else out


def series_spine(df: DataFrame, series: str, date: str) -> DataFrame:
    """Every day between the first and last day of each series."""
    bounds = df.groupBy(series).agg(F.min(date).alias("_lo"), F.max(date).alias("_hi"))
    return bounds.select(series, F.explode(F.sequence("_lo", "_hi")).alias(date))


def forward_fill(column: Column | str, window) -> Column:
    """Last value that is not NULL, up to and including the row."""
    frame = window.rowsBetween(Window.unboundedPreceding, 0)
    return F.last(col(column), ignorenulls=True).over(frame)


def linear_interpolate(df: DataFrame, value: str, date: str, by: tuple[str, ...] = (), name: str | None = None) -> DataFrame:
    """Fill NULLs on the straight line between the neighbouring values (outside: nearest value)."""
    window = Window.partitionBy(*by).orderBy(date)
    known_day = F.when(F.col(value).isNotNull(), F.col(date))
    back = window.rowsBetween(Window.unboundedPreceding, 0)
    ahead = window.rowsBetween(0, Window.unboundedFollowing)
    left, right = F.last(value, True).over(back), F.first(value, True).over(ahead)
    left_day, right_day = F.last(known_day, True).over(back), F.first(known_day, True).over(ahead)
    step = F.try_divide(F.datediff(F.col(date), left_day), F.datediff(right_day, left_day))
    between = left + (right - left) * step
    # leading gaps stay NULL, trailing gaps keep the last value, as in a forward interpolation
    return df.withColumn(name or value, F.coalesce(F.col(value), between, left))


def as_of_daily(spine: DataFrame, snapshots: DataFrame, date: str, snapshot_date: str, columns: list[str], delay_days: int = 1) -> DataFrame:
    """Daily view of snapshots that become known ``delay_days`` later and hold until the next.

    Adds ``days_since_snapshot``; before the first snapshot the values are NULL and the age
    counts from the first day of the spine.
    """
    known = snapshots.select(
        F.date_add(F.col(snapshot_date), delay_days).alias(date),
        F.col(snapshot_date).alias("_snapshot"),
        *columns,
    )
    joined = spine.join(known, date, "left")
    window = Window.orderBy(date)  # one row per calendar day
    first_day = F.min(date).over(Window.partitionBy())
    filled = joined.withColumns({c: forward_fill(c, window) for c in [*columns, "_snapshot"]})
    return filled.withColumn(
        "days_since_snapshot", F.datediff(F.col(date), F.coalesce(F.col("_snapshot"), first_day))
    ).drop("_snapshot")
