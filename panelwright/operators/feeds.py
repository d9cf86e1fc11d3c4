"""Rows behind charts: long scatter rows, map rows, model plot rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from panelwright.functions.keys import fixed_decimals
from panelwright.operators.ordering import sample_flag


def scatter_rows(df: DataFrame, x: str, ys: Sequence[str], size: str | None = None) -> DataFrame:
    """Wide to long: (x, size, variable, value)."""
    ids = [x] if size is None else [x, size]
    typed = df.select(*ids, *[F.col(y).cast("double").alias(y) for y in ys])
    return typed.unpivot(ids, list(ys), "variable", "value")


def clamped(value: str | Column, low: float, high: float) -> Column:
    """Value held inside a colour range; NULL stays NULL."""
    v = F.col(value) if isinstance(value, str) else value
    return F.when(v.isNotNull(), F.least(F.greatest(v, F.lit(low)), F.lit(high)))


def map_rows(df: DataFrame, key: str, value: str, value_range: tuple[float, float] | None,
             hover: Mapping[str, str], decimals: Mapping[str, int] | None = None) -> DataFrame:
    """Key, colour value and labelled hover fields. ``hover`` maps columns to labels."""
    decimals = decimals or {}
    colour = F.col(value) if value_range is None else clamped(value, *value_range)
    labels = [
        (fixed_decimals(c, decimals[c]) if c in decimals else F.col(c)).alias(label)
        for c, label in hover.items()]
    return df.select(key, colour.alias("colour"), *labels)


def with_shapes(rows: DataFrame, features: DataFrame, key: str) -> DataFrame:
    """Attach the geometry of each key; rows without one are kept."""
    return rows.join(features, key, "left")


def model_plot_rows(scored: DataFrame, key: str, y: str, fitted: str, residual: str,
                    fraction: float = 0.1, seed: int = 101) -> DataFrame:
    """Observed, fitted, residual and absolute residual on a keyed sample of rows."""
    drawn = scored.filter(sample_flag(scored, key, fraction, seed))
    return drawn.select(key, F.col(y).alias("observed"), F.col(fitted).alias("fitted"),
                        F.col(residual).alias("residual"),
                        F.abs(residual).alias("abs_residual"))
