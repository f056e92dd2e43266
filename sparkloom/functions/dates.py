"""Calendar arithmetic on date and timestamp columns. Mixed amounts are added in the order years,
months, days, then time; months clamp at a month's end at each step."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def add_days(c: Column, n: int) -> Column:
    return F.date_add(c, n)


def add_weeks(c: Column, n: int) -> Column:
    return F.date_add(c, 7 * n)


def add_months(c: Column, n: int) -> Column:
    return F.add_months(c, n)


def add_years(c: Column, n: int) -> Column:
    return F.add_months(c, 12 * n)


def add_time(c: Column, hours: int = 0, minutes: int = 0, seconds: float = 0) -> Column:
    return c + F.make_dt_interval(F.lit(0), F.lit(hours), F.lit(minutes), F.lit(float(seconds)).cast("decimal(18,6)"))


def add_milliseconds(c: Column, n: int) -> Column:
    return c + F.make_dt_interval(secs=(F.lit(n).cast("decimal(18,6)") / 1000).cast("decimal(18,6)"))


def add_parts(c: Column, years: int = 0, months: int = 0, days: int = 0, hours: int = 0, minutes: int = 0, seconds: float = 0) -> Column:
    """A timestamp moved by all six parts, the largest first; the time of day stays while dates move."""
    moved = c + F.make_ym_interval(F.lit(years)) + F.make_ym_interval(F.lit(0), F.lit(months)) + F.make_dt_interval(F.lit(days))
    return add_time(moved, hours, minutes, seconds)


def add_date(c: Column, years: int = 0, months: int = 0, days: int = 0) -> Column:
    return F.date_add(F.add_months(F.add_months(c, 12 * years), months), days)


def between_symmetric(c: Column, a, b) -> Column:
    """BETWEEN whose bounds may come in either order."""
    low, high = F.least(F.lit(a), F.lit(b)), F.greatest(F.lit(a), F.lit(b))
    return (c >= low) & (c <= high)


def time_of_day(c: Column) -> Column:
    return F.date_format(c, "HH:mm:ss")
