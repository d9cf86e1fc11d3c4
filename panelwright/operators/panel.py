"""Daily panels: totals, lags, running means.

A panel has one row per key and day. ``daily_totals`` makes it so with an aggregate
that combines on the map side, whatever share of the raw rows one key holds. After it a
key has at most as many rows as the calendar has days, which bounds every window below.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelwright.functions.calendar import week_of


@dataclass(frozen=True)
class Period:
    """A span of days. The first day only seeds the lag; the last one is reported."""

    seed_day: dt.date
    last_day: dt.date

    def week(self, first_weekday: str = "wednesday") -> int:
        return week_of(self.last_day, first_weekday)


def daily_totals(df: DataFrame, keys: Sequence[str | Column], timestamp: str,
                 totals: Mapping[str, Column], date: str = "date") -> DataFrame:
    """One row per key and day with the given aggregates."""
    return (df.groupBy(*keys, F.to_date(timestamp).alias(date))
            .agg(*[agg.alias(name) for name, agg in totals.items()]))


def running_total(value: str, key: str, date: str) -> Column:
    """Cumulative sum per key up to and including the row's day."""
    return F.sum(value).over(Window.partitionBy(key).orderBy(date))


def previous_row(value: str | Column, keys: str | Sequence[str], date: str) -> Column:
    """Value of the row before, per key. By row, not by day: a gap is bridged."""
    return F.lag(value, 1).over(Window.partitionBy(keys).orderBy(date))


def running_mean(value: str, keys: Sequence[str], date: str) -> Column:
    """Mean over the rows of the same keys up to and including the row's day."""
    return F.avg(value).over(Window.partitionBy(*keys).orderBy(date))


def in_spans(date: str | Column, spans: Sequence[tuple[dt.date, dt.date]]) -> Column:
    """True when the day lies in any of the closed spans."""
    d = F.col(date) if isinstance(date, str) else date
    hit = F.lit(False)
    for first, last in spans:
        hit = hit | d.between(F.lit(first), F.lit(last))
    return hit


def on_days(date: str | Column, days: Sequence[dt.date]) -> Column:
    d = F.col(date) if isinstance(date, str) else date
    return d.isin(*days)
