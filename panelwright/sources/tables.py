"""Named tables: run, look, drop, load."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def run_query(spark: SparkSession, query: str) -> DataFrame:
    """Result of a statement; empty for one that returns no rows."""
    return spark.sql(query)


def read_table(spark: SparkSession, table: str) -> DataFrame:
    return spark.read.table(table)


def columns(spark: SparkSession, table: str) -> list[str]:
    return spark.table(table).columns


def head(spark: SparkSession, table: str, rows: int = 10, show: bool = True) -> DataFrame:
    """Some rows of a table, printed and returned."""
    some = spark.table(table).limit(rows)
    if show:
        some.show(rows, truncate=False)
    return some


def drop_table(spark: SparkSession, table: str) -> None:
    """Drop a table. A missing one is no error."""
    spark.sql(f"DROP TABLE IF EXISTS {table}")


def load_table(spark: SparkSession, table: str, df: DataFrame | None = None,
               query: str | None = None, file: str | None = None, overwrite: bool = True,
               preview_rows: int = 0, schema: str | None = None, path: str | None = None,
               buckets: tuple[int, str] | None = None) -> str:
    """Load a table from a frame, a query or a CSV file, whichever is given first.

    With ``overwrite`` an existing table is replaced, otherwise the rows are appended. The
    types of a CSV file are inferred from all of its rows unless ``schema`` states them, which
    saves a pass. ``path`` puts the files of a new table where the caller wants them.
    ``buckets`` (how many, by which column) stores a panel by its key, so that the windows and
    joins on that key need no exchange later.
    """
    if df is not None:
        rows = df
    elif query is not None:
        rows = spark.sql(query)
    elif file is not None:
        reader = spark.read.option("header", True)
        rows = (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(file)
    else:
        raise ValueError("give a df, a query or a file")
    writer = rows.write.mode("overwrite" if overwrite else "append")
    if path is not None:
        writer = writer.option("path", path)
    if buckets is not None:
        count, key = buckets
        writer = writer.bucketBy(count, key).sortBy(key)
    writer.saveAsTable(table)
    if preview_rows > 0:
        head(spark, table, preview_rows)
    return table
