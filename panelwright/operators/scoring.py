"""Goodness of fit on scored rows, whole and by group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from panelwright.functions.shares import ratio
from panelwright.operators.summary import squared_deviations
from panelwright.runtime import stored


def rmspe(observed: str | Column, predicted: str | Column) -> Column:
    """Root mean squared prediction error, as an aggregate."""
    o = F.col(observed) if isinstance(observed, str) else observed
    p = F.col(predicted) if isinstance(predicted, str) else predicted
    return F.sqrt(F.avg((o - p) * (o - p)))


def residual_sum(residual: str) -> Column:
    return F.sum(F.col(residual) * F.col(residual))


def r_squared(observed: str, residual: str) -> Column:
    """``1 - RSS/TSS`` about the mean of the aggregated rows; may be negative."""
    return F.lit(1.0) - ratio(residual_sum(residual), squared_deviations(observed))


def fit_sums(scored: DataFrame, observed: str, residual: str) -> DataFrame:
    """RSS, TSS, R-squared and row count in one row."""
    return scored.agg(
        residual_sum(residual).alias("rss"), squared_deviations(observed).alias("tss"),
        r_squared(observed, residual).alias("r_squared"), F.count(observed).alias("n"))


def group_r_squared(scored: DataFrame, group: str, observed: str,
                    residuals: dict[str, str]) -> DataFrame:
    """R-squared of each model within each group. ``residuals`` maps result to residual column."""
    return scored.groupBy(group).agg(
        *[r_squared(observed, e).alias(name) for name, e in residuals.items()])


def results_table(scored: DataFrame, key: str, group: str, observed: str,
                  residuals: dict[str, str]) -> DataFrame:
    """One row per key with the R-squared of its group.

    The groups' rows are stored first, so that Spark knows their size when it plans the join and
    leaves the scored rows where they are if the groups are few.
    """
    by_group = stored(group_r_squared(scored, group, observed, residuals), "by-group")
    return scored.select(key, group).join(by_group, group).select(key, group, *residuals)
