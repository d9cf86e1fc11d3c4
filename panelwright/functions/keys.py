"""Key repair, prefixes, code flags and labels."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, functions as F

# Census regions of the United States by state FIPS code.
STATE_REGIONS = {
    "Northeast": (9, 23, 25, 33, 34, 36, 42, 44, 50),
    "Midwest": (17, 18, 19, 20, 26, 27, 29, 31, 38, 39, 46, 55),
    "South": (1, 5, 10, 11, 12, 13, 21, 22, 24, 28, 37, 40, 45, 47, 48, 51, 54),
    "West": (2, 4, 6, 8, 15, 16, 30, 32, 35, 41, 49, 53, 56),
}

# Urban-rural classes that count as metropolitan.
METROPOLITAN_CLASSES = (1, 2, 3, 4)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def restore_leading_zero(code: Column | str, short: int = 4) -> Column:
    """Text of an integer code; only texts of exactly ``short`` characters get a zero."""
    text = _col(code).cast("string")
    return F.when(F.length(text) == short, F.concat(F.lit("0"), text)).otherwise(text)


def slice_text(text: Column | str, start: int, length: int) -> Column:
    """1-based substring; an empty text when ``start`` lies past the end."""
    return F.substring(_col(text), start, length)


def leading_int(text: Column | str, length: int) -> Column:
    """The first ``length`` characters as an integer."""
    return slice_text(text, 1, length).cast("int")


def has_prefix(text: Column | str, prefix: str) -> Column:
    """Prefix test in the form that reaches the file scan."""
    return _col(text).startswith(prefix)


def member_flag(code: Column | str, codes: Iterable[int]) -> Column:
    """1 when the code is in the list, else 0 (also for NULL)."""
    return F.when(_col(code).isin(*codes), F.lit(1)).otherwise(F.lit(0))


def group_flags(code: Column | str, groups: Mapping[str, Iterable[int]]) -> dict[str, Column]:
    """One 0/1 column per group of codes, for ``withColumns``."""
    return {name: member_flag(code, codes) for name, codes in groups.items()}


def group_label(code: Column | str, groups: Mapping[str, Iterable[int]]) -> Column:
    """Name of the group that holds the code, NULL when none does."""
    return F.coalesce(*[
        F.when(_col(code).isin(*codes), F.lit(name)) for name, codes in groups.items()
    ])


def fixed_decimals(value: Column | str, places: int = 4) -> Column:
    """A number as text with a fixed number of decimals."""
    return F.format_string(f"%.{places}f", _col(value))
