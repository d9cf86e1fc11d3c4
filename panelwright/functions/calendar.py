"""Date expressions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, functions as F

# Weekday numbers as Spark's weekday() gives them.
WEEKDAYS = {
    "monday": 0, "tuesday": 1, "wednesday": 2, "thursday": 3,
    "friday": 4, "saturday": 5, "sunday": 6,
}


def week_number(date: Column | str, first_weekday: str = "wednesday") -> Column:
    """Week of the year when weeks start on ``first_weekday``.

    Week 1 starts on the year's first such weekday; the days before it are week 0.
    """
    d = F.col(date) if isinstance(date, str) else date
    days_into_week = F.pmod(F.weekday(d) - F.lit(WEEKDAYS[first_weekday]), F.lit(7))
    return F.floor((F.dayofyear(d) + 6 - days_into_week) / 7).cast("int")


def week_of(day: dt.date, first_weekday: str = "wednesday") -> int:
    """``week_number`` for one date that the caller already holds."""
    days_into_week = (day.weekday() - WEEKDAYS[first_weekday]) % 7
    return (day.timetuple().tm_yday + 6 - days_into_week) // 7


def month_number(date: Column | str) -> Column:
    return F.month(date)
