"""Change of the mean rate between two periods of a cumulative daily panel."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from panelwright.functions.calendar import week_number
from panelwright.functions.shares import rate_per
from panelwright.operators.panel import (
    Period, in_spans, on_days, previous_row, running_mean,
)


@dataclass(frozen=True)
class PanelColumns:
    """Column names of the panel and of the population table."""

    key: str = "county_fips_code"
    date: str = "date"
    total: str = "confirmed_cases"
    carried: tuple[str, ...] = ("county_name", "state")
    unused: tuple[str, ...] = ("deaths",)
    population_key: str = "geo_id"
    population: str = "total_pop"
    first_weekday: str = "wednesday"


def _spans(periods: Sequence[Period]):
    return [(p.seed_day, p.last_day) for p in periods]


def stages(panel: DataFrame, population: DataFrame, periods: Sequence[Period],
           names: PanelColumns = PanelColumns()) -> list[tuple[str, DataFrame]]:
    """Every step as its own DataFrame, each built on the one before.

    Filters sit where the windows need them: the spans before the first lag, the weeks
    after it, the last days before the second lag.
    """
    c = names
    head = (c.key, *c.carried, c.date, "week")
    weeks = [p.week(c.first_weekday) for p in periods]
    last_days = [p.last_day for p in periods]
    people = population.select(F.col(c.population_key).alias(c.key), c.population)

    def lagged(df: DataFrame) -> DataFrame:
        return (df.drop(*c.unused).filter(in_spans(c.date, _spans(periods)))
                .withColumn("cases_previous_day", previous_row(c.total, c.key, c.date)))

    def new_cases(df: DataFrame) -> DataFrame:
        return (df.withColumn("week", week_number(c.date, c.first_weekday))
                .withColumn("new_cases", F.col(c.total) - F.col("cases_previous_day")))

    def unchanged(df: DataFrame) -> DataFrame:
        return df.select("*")

    def whole_weeks(df: DataFrame) -> DataFrame:
        return df.filter(F.col("week").isin(*weeks))

    def with_population(df: DataFrame) -> DataFrame:
        return df.join(people, c.key, "left").select(*head, "new_cases", c.population)

    def rate(df: DataFrame) -> DataFrame:
        return df.select(*head, rate_per("new_cases", c.population).alias("new_cases_per_10k"))

    def weekly_mean(df: DataFrame) -> DataFrame:
        return df.withColumn(
            "avg_new_cases_per_10k", running_mean("new_cases_per_10k", [c.key, "week"], c.date))

    def previous_period(df: DataFrame) -> DataFrame:
        return (df.drop("new_cases_per_10k").filter(on_days(c.date, last_days))
                .withColumn("avg_new_cases_per_10k_prev",
                            previous_row("avg_new_cases_per_10k", c.key, c.date)))

    def difference(df: DataFrame) -> DataFrame:
        return df.withColumn(
            "new_cases_per_10k_difference",
            F.col("avg_new_cases_per_10k") - F.col("avg_new_cases_per_10k_prev"))

    def complete(df: DataFrame) -> DataFrame:
        return (df.filter(F.col("new_cases_per_10k_difference").isNotNull())
                .select(c.key, *c.carried, "new_cases_per_10k_difference"))

    listed, current = [], panel
    for step in (lagged, new_cases, unchanged, whole_weeks, with_population, rate,
                 weekly_mean, previous_period, difference, complete):
        current = current.transform(step)
        listed.append((step.__name__, current))
    return listed


def show_stages(listed: Sequence[tuple[str, DataFrame]], final_only: bool = False,
                rows: int = 5) -> None:
    """Print the columns and some rows of every stage, or of the last one."""
    first = len(listed) - 1 if final_only else 0
    for position, (name, frame) in list(enumerate(listed))[first:]:
        print(f"stage {position}: {name} ({', '.join(f'{c} {t}' for c, t in frame.dtypes)})")
        frame.show(rows, truncate=False)


def period_means(panel: DataFrame, before: Period, after: Period,
                 names: PanelColumns = PanelColumns()) -> DataFrame:
    """Mean daily increase of each key in both periods, for keys that report both last days.

    The running mean is read only on a period's last day, where it is a plain mean, so the
    rows of a key fold into one right after the lag, in the partitioning the lag already has.
    """
    c = names

    def mean_of(period: Period) -> Column:
        inside = (F.col("week") == period.week(c.first_weekday)) & (
            F.col(c.date) <= F.lit(period.last_day))
        return F.avg(F.when(inside, F.col("new_cases")))

    def reported(period: Period) -> Column:
        return F.max(F.when(F.col(c.date) == F.lit(period.last_day), F.lit(1)))

    last = F.col(c.date) == F.lit(after.last_day)
    lagged = (
        panel.drop(*c.unused).filter(in_spans(c.date, _spans((before, after))))
        .withColumn("new_cases", F.col(c.total) - previous_row(c.total, c.key, c.date))
        .withColumn("week", week_number(c.date, c.first_weekday))
    )
    return (
        lagged.groupBy(c.key).agg(
            *[F.max_by(name, F.when(last, 1)).alias(name) for name in c.carried],
            mean_of(before).alias("mean_before"), mean_of(after).alias("mean_after"),
            reported(before).alias("has_before"), reported(after).alias("has_after"))
        .filter("has_before = 1 AND has_after = 1 "
                "AND mean_before IS NOT NULL AND mean_after IS NOT NULL")
        .drop("has_before", "has_after")
    )


def rate_change(population: str) -> Column:
    """Difference of the two period means as rates."""
    return rate_per("mean_after", population) - rate_per("mean_before", population)


def period_change(panel: DataFrame, population: DataFrame, before: Period, after: Period,
                  names: PanelColumns = PanelColumns()) -> DataFrame:
    """Same rows as the last of ``stages`` for two periods, with one exchange of the panel.

    The population joins one row per key instead of every day. An unmatched key would end
    as NULL and be dropped, hence the inner join.
    """
    c = names
    people = population.select(F.col(c.population_key).alias(c.key), c.population)
    return (
        period_means(panel, before, after, names).join(people, c.key)
        .withColumn("new_cases_per_10k_difference", rate_change(c.population))
        .filter(F.col("new_cases_per_10k_difference").isNotNull())
        .select(c.key, *c.carried, "new_cases_per_10k_difference")
    )
