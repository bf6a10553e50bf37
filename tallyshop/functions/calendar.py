"""Calendar, Fourier and holiday features of a date column."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyshop.functions.columns import col, dbl, flag, month_end, quarter_end

# Lunar new year days.
LUNAR_NEW_YEAR = (
    "2012-01-23", "2013-02-10", "2014-01-31", "2015-02-19", "2016-02-08", "2017-01-28", "2018-02-16",
    "2019-02-05", "2020-01-25", "2021-02-12", "2022-02-01", "2023-01-22", "2024-02-10", "2025-01-29",
)
# Hung Kings commemoration days.
HUNG_KINGS = (
    "2012-03-31", "2013-04-19", "2014-04-09", "2015-03-29", "2016-04-16", "2017-04-05", "2018-03-25",
    "2019-04-14", "2020-04-02", "2021-04-21", "2022-04-10", "2023-04-29", "2024-04-18",
)
# Public holidays by month and day.
FIXED_HOLIDAYS = ("01-01", "04-30", "05-01", "09-02", "12-25")
# Month-days around the lunar new year that count as holidays in the daily model.
LUNAR_CLUSTER = ("01-25", "01-26", "01-27", "01-28", "01-29", "01-30")
# The trend starts at this day and is scaled by about five years.
TREND_ORIGIN = "2017-01-01"
TREND_SCALE_DAYS = 1826


def calendar_features(date: Column | str) -> dict[str, Column]:
    """Date parts, distances to period ends and season flags."""
    date = col(date)
    month, day = F.month(date), F.day(date)
    to_month, to_quarter = F.datediff(month_end(date), date), F.datediff(quarter_end(date), date)
    last_day = F.day(month_end(date))
    return {
        "dow": F.weekday(date), "dom": day, "month": month, "quarter": F.quarter(date), "year": F.year(date),
        "woy": F.weekofyear(date), "doy": F.dayofyear(date), "day_name": F.date_format(date, "EEEE"),
        "is_weekend": flag(F.weekday(date) >= 5), "is_month_end": flag(to_month == 0), "is_month_start": flag(day == 1),
        "days_to_month_end": to_month, "is_last3_days": flag(to_month <= 2), "is_last7_days": flag(to_month <= 6),
        "days_to_quarter_end": to_quarter, "is_last3_quarter": flag(to_quarter <= 2),
        "dom_ratio": dbl(day) / last_day, "dom_position": (dbl(day) - 1) / (last_day - 1),
        "is_peak_season": flag(month.isin(4, 5, 6)), "is_low_season": flag(month.isin(11, 12, 1)),
        "is_quarter_end_month": flag(month.isin(3, 6, 9, 12)),
        "is_year_end_window": flag(((month == 12) & (day >= 20)) | ((month == 1) & (day <= 5))),
        "is_lunar_window": flag(((month == 1) & (day >= 20)) | ((month == 2) & (day <= 20))),
    }


def cyclic_features(date: Column | str) -> dict[str, Column]:
    """Month and weekday on the unit circle."""
    date, turn = col(date), 2 * math.pi
    return {
        "month_sin": F.sin(turn * F.month(date) / 12), "month_cos": F.cos(turn * F.month(date) / 12),
        "dow_sin": F.sin(turn * F.weekday(date) / 7), "dow_cos": F.cos(turn * F.weekday(date) / 7),
    }


def fourier_features(date: Column | str, yearly: int = 10, weekly: int = 0) -> dict[str, Column]:
    """Sine and cosine harmonics of the year (365.25 days) and of the week."""
    date, turn = col(date), 2 * math.pi
    out = {}
    for k in range(1, yearly + 1):
        angle = turn * k * F.dayofyear(date) / 365.25
        out[f"year_sin{k}"], out[f"year_cos{k}"] = F.sin(angle), F.cos(angle)
    for k in range(1, weekly + 1):
        angle = turn * k * F.weekday(date) / 7
        out[f"week_sin{k}"], out[f"week_cos{k}"] = F.sin(angle), F.cos(angle)
    return out


def days_from_nearest(date: Column | str, days: tuple[str, ...]) -> Column:
    """Signed days from the nearest of some fixed days: negative before it, positive after.

    The earlier day wins a tie. The list is a literal of the plan, so no join is needed.
    """
    listed = F.array(*[F.lit(d).cast("date") for d in days])
    nearest = F.array_min(
        F.transform(
            listed,
            lambda h: F.struct(F.abs(F.datediff(col(date), h)).alias("gap"), h.alias("day")),
        )
    )
    return F.datediff(col(date), nearest["day"])


def lunar_features(date: Column | str, days: tuple[str, ...] = LUNAR_NEW_YEAR, width: float = 7.0) -> dict[str, Column]:
    """Distance to the lunar new year, its week and month, the two weeks before, the week after, a bell curve."""
    gap = days_from_nearest(date, days)
    return {
        "days_to_lunar": gap, "is_lunar_week": flag(F.abs(gap) <= 7), "is_lunar_month": flag(F.abs(gap) <= 30),
        "is_pre_lunar2w": flag((gap >= -14) & (gap < 0)),
        "is_post_lunar1w": flag((gap > 0) & (gap <= 7)), "lunar_proximity": F.exp(-0.5 * F.pow(gap / width, F.lit(2))),
    }


def holiday_days(years: range, lunar: tuple[str, ...] = LUNAR_NEW_YEAR, hung_kings: tuple[str, ...] = HUNG_KINGS) -> tuple[str, ...]:
    """All holidays of some years: fixed days, Hung Kings, and the lunar new year from its eve to day four."""
    from datetime import date, timedelta

    out = {f"{y}-{md}" for y in years for md in FIXED_HOLIDAYS}
    out |= {d for d in hung_kings if int(d[:4]) in years}
    for d in lunar:
        if int(d[:4]) in years:
            out |= {str(date.fromisoformat(d) + timedelta(days=k)) for k in range(-1, 4)}
    return tuple(sorted(out))


def holiday_features(date: Column | str, holidays: tuple[str, ...], hung_kings: tuple[str, ...] = HUNG_KINGS) -> dict[str, Column]:
    """Fixed-day flag, distance to the nearest holiday, windows before, around and after it."""
    date = col(date)
    listed = F.array(*[F.lit(d).cast("date") for d in holidays])

    def near(low: int, high: int) -> Column:
        """A holiday lies between ``low`` and ``high`` days ahead."""
        return flag(F.exists(listed, lambda h: F.datediff(h, date).between(low, high)))

    out = {
        "is_fixed_holiday": flag(F.date_format(date, "MM-dd").isin(*FIXED_HOLIDAYS, *LUNAR_CLUSTER)),
        "days_to_holiday": F.abs(days_from_nearest(date, holidays)),
        "is_holiday_window": near(-2, 2), "pre_holiday": near(1, 5), "post_holiday": near(-3, -1),
    }
    if hung_kings:
        out["near_hung_kings"] = flag(F.abs(days_from_nearest(date, hung_kings)) <= 5)
    return out


def trend_features(date: Column | str, origin: str = TREND_ORIGIN, scale_days: int = TREND_SCALE_DAYS, freeze: str | None = None) -> dict[str, Column]:
    """Days from an origin, raw and scaled; after ``freeze`` the value stands still."""
    date = col(date)
    if freeze is not None:
        date = F.least(date, F.lit(freeze).cast("date"))
    days = F.datediff(date, F.lit(origin).cast("date"))
    return {"trend_days": days, "trend_norm": days / F.lit(float(scale_days))}
