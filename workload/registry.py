"""Collects queries and the SQL they are checked against."""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

QueryFunction = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    run: QueryFunction
    covers: str
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(covers: str, sql: str | None = None, name: str | None = None):
    """Register a query under its function name with the survey lines it covers."""
    def register(run: QueryFunction) -> QueryFunction:
        label = name or run.__name__
        if label in QUERIES:
            raise ValueError(f"query {label} is registered twice")
        QUERIES[label] = Query(run, covers, sql)
        return run
    return register


@functools.cache
def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table. Kept per session, since every fresh read looks into the file again."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(column: str | Column, places: int = 6) -> Column:
    """Rounded double without a negative zero, as the checking SQL rounds."""
    c = F.col(column) if isinstance(column, str) else column
    return F.round(c.cast("double"), places) + F.lit(0.0)


def round_all(df: DataFrame, places: int = 6, **special: int) -> DataFrame:
    """Round every double column."""
    return df.select(*[
        rounded(F.col(f"`{c}`"), special.get(c, places)).alias(c) if t == "double" else F.col(f"`{c}`")
        for c, t in df.dtypes])
