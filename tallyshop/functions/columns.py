"""Column expressions: numbers, dates, bands, flags. No Python runs per row."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def col(column: Column | str) -> Column:
    return F.col(column) if isinstance(column, str) else column


# --- numbers -----------------------------------------------------------------------------


def dbl(column: Column | str) -> Column:
    return col(column).cast("double")


def ratio(numerator: Column | str, denominator: Column | str) -> Column:
    """Double division; NULL where the denominator is zero."""
    return F.try_divide(dbl(numerator), dbl(denominator))


def r6(column: Column | str) -> Column:
    """Output form of a rate or mean: a double with six decimals."""
    return F.round(dbl(column), 6)


def money(column: Column | str) -> Column:
    """Output form of an exact decimal amount: rounded to cents, then double."""
    return F.round(col(column), 2).cast("double")


def mean_exact(column: Column | str) -> Column:
    """Mean as sum over count, so that exact inputs (decimal, integer) give one result."""
    return ratio(F.sum(column), F.count(column))


def total_of(column: Column | str) -> Column:
    """Grand total beside each row; only for tables of a few groups (one window task)."""
    return F.sum(column).over(Window.partitionBy())


def flag(condition: Column) -> Column:
    """1 where the condition holds, otherwise 0 (also for NULL)."""
    return F.when(condition, 1).otherwise(0)


def count_if(condition: Column) -> Column:
    return F.sum(flag(condition))


def clip(column: Column | str, low: float | None = None, high: float | None = None) -> Column:
    out = col(column)
    if low is not None:
        out = F.greatest(out, F.lit(low))
    if high is not None:
        out = F.least(out, F.lit(high))
    return out


def margin(price: Column | str, cogs: Column | str) -> Column:
    return ratio(col(price) - col(cogs), price)


# --- money of an order line ----------------------------------------------------------------


def gross_value() -> Column:
    return F.col("quantity") * F.col("unit_price")


def net_value() -> Column:
    return gross_value() - F.col("discount_amount")


# --- bands -----------------------------------------------------------------------------------


def cut(value: Column | str, edges: list[float], labels: list[str]) -> Column:
    """Right-closed bands: ``edges[i] < value <= edges[i+1]``; NULL outside all of them."""
    value, out = col(value), F.lit(None).cast("string")
    for low, high, label in reversed(list(zip(edges, edges[1:], labels))):
        inside = value > F.lit(low)
        if high != float("inf"):
            inside = inside & (value <= F.lit(high))
        out = F.when(inside, F.lit(label)).otherwise(out)
    return out


def edge_score(value: Column | str, edges: Column, scores: list[int]) -> Column:
    """Score by value edges (an array column of len(scores)-1 inner edges), right-closed."""
    value, out = dbl(value), F.lit(scores[-1])
    for i in range(len(scores) - 2, -1, -1):
        out = F.when(value <= edges[i], F.lit(scores[i])).otherwise(out)
    return F.when(value.isNotNull(), out)


# --- dates -----------------------------------------------------------------------------------


def month_of(date: Column | str) -> Column:
    return F.trunc(col(date), "MM")


def month_number(date: Column | str) -> Column:
    """Months since year 0, so that differences are month distances."""
    return F.year(date) * 12 + F.month(date)


def month_end(date: Column | str) -> Column:
    return F.last_day(date)


def quarter_end(date: Column | str) -> Column:
    return F.last_day(F.make_date(F.year(date), F.quarter(date) * 3, F.lit(1)))


def day_index(date: Column | str) -> Column:
    """Days since 1970-01-01, for calendar-range windows."""
    return F.unix_date(col(date))


# --- output ----------------------------------------------------------------------------------


def shown(df: DataFrame, exact: tuple[str, ...] = ()) -> DataFrame:
    """Output form of a table: decimals as money, doubles with six decimals, the rest as is.

    Columns named in ``exact`` are one division of exact sums and stay unrounded.
    """

    def cell(field) -> Column:
        kind = field.dataType.typeName()
        name = F.col(f"`{field.name}`")
        if kind.startswith("decimal"):
            return money(name).alias(field.name)
        rounded = kind == "double" and field.name not in exact
        return (r6(name) if rounded else name).alias(field.name)

    return df.select(*[cell(f) for f in df.schema.fields])


def slug(value: str) -> str:
    """Column-name form of a category value."""
    return re.sub(r"[^a-z0-9]+", "_", value.lower()).strip("_")


def one_hot_counts(column: str, values: list[str], prefix: str | None = None) -> list[Column]:
    """Count of rows per value as aggregate columns ``prefix_value``, from a fixed value list."""
    prefix = prefix or column
    return [count_if(F.col(column) == v).alias(f"{prefix}_{slug(v)}") for v in values]
