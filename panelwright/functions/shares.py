"""Rates, shares, row sums, recodes and interactions."""

from __future__ import annotations

import functools
import operator
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(part: Column | str, whole: Column | str) -> Column:
    """``part / whole`` in doubles, NULL when the whole is zero or NULL."""
    return F.try_divide(_col(part).cast("double"), _col(whole).cast("double"))


def rate_per(count: Column | str, population: Column | str, per: int = 10_000) -> Column:
    return ratio(_col(count) * F.lit(per), population)


def row_sum(columns: Sequence[Column | str]) -> Column:
    """Sum across columns of one row; NULL if any of them is NULL."""
    return functools.reduce(operator.add, [_col(c) for c in columns])


def remainder(total: Column | str, parts: Sequence[Column | str]) -> Column:
    """What the parts leave of the total; negative values are kept."""
    return _col(total) - row_sum(parts)


def reversed_z(value: Column | str, mean: Column | str, spread: Column | str) -> Column:
    """``(mean - value) / spread``: positive below the mean. NULL when the spread is 0."""
    return ratio(_col(mean) - _col(value), spread)


def redefine(df: DataFrame, columns: Mapping[str, Column], drop: Sequence[str] = ()) -> DataFrame:
    """Replace columns under their own names.

    Redefined columns move to the end, in the order given, as they do when a
    SELECT drops and re-adds them.
    """
    gone = set(columns) | set(drop)
    kept = [F.col(f"`{c}`") for c in df.columns if c not in gone]
    return df.select(*kept, *[expr.alias(name) for name, expr in columns.items()])


def shares_of_total(df: DataFrame, parts: Sequence[str], total: str,
                    drop: Sequence[str] = ()) -> DataFrame:
    """Every part over ``total``, under the part's own name."""
    return redefine(df, {p: ratio(p, total) for p in parts}, drop=drop)


def recode(df: DataFrame, keep: Sequence[str], groups: Mapping[str, Sequence[str]]) -> DataFrame:
    """Collapse categories: each new column is the sum of its old ones."""
    return df.select(*keep, *[row_sum(old).alias(new) for new, old in groups.items()])


def interactions(terms: Mapping[str, tuple[str, str]]) -> dict[str, Column]:
    """Product columns for ``withColumns``."""
    return {name: F.col(a) * F.col(b) for name, (a, b) in terms.items()}


def shifted(value: Column | str, by: float) -> Column:
    return _col(value) + F.lit(float(by))


def power(value: Column | str, exponent: float) -> Column:
    """``value ** exponent``, or the natural log when the exponent is 0.

    A negative value with a fractional exponent gives NaN.
    """
    v = _col(value).cast("double")
    return F.ln(v) if exponent == 0 else F.pow(v, F.lit(float(exponent)))
