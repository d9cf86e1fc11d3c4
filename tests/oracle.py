"""Runs registered queries next to their checking SQL and compares the rows."""

from __future__ import annotations

import datetime as dt
import math
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return float(repr(value))
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None)
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    if hasattr(value, "asDict"):
        return tuple(_plain(v) for v in value)
    return value


def _sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(r[i]) for i in order) for r in rows]
    return sorted(columns), sorted(plain, key=repr)


# Column types of both engines that count as the same.
SAME_TYPES = {"INTEGER": "int", "BIGINT": "bigint", "DOUBLE": "double", "VARCHAR": "string",
              "DATE": "date", "BOOLEAN": "boolean", "TIMESTAMP": "timestamp_ntz"}


def compare(spark_df, con, sql: str) -> str | None:
    """None when equal, else what differs."""
    got_columns, got = _sorted_rows(spark_df.columns, spark_df.collect())
    cursor = con.execute(sql)
    want_columns, want = _sorted_rows([d[0] for d in cursor.description], cursor.fetchall())
    if got_columns != want_columns:
        return f"columns {got_columns} against {want_columns}"
    types = dict(spark_df.dtypes)
    for name, kind, *_ in cursor.description:
        if SAME_TYPES.get(str(kind)) != types[name]:
            return f"type of {name}: {types[name]} against {kind}"
    if len(got) != len(want):
        return f"{len(got)} rows against {len(want)}"
    for g, w in zip(got, want):
        if g != w or [type(x) for x in g] != [type(x) for x in w]:
            return f"first difference {g} against {w} in {got_columns}"
    return None


def main(sf_dir: str, names: list[str]) -> int:
    sys.path.insert(0, ".")
    import __spark_entry__ as entry
    from panelwright.runtime import local_session
    spark = local_session(8)
    con = connect(sf_dir)
    queries, oracle = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in names or queries:
        start = time.time()
        try:
            frame = queries[name](spark, sf_dir)
            if name in oracle:
                found = compare(frame, con, oracle[name])
                verdict = "ok" if found is None else f"DIFFERS {found}"
                rows = len(con.execute(oracle[name]).fetchall())
            else:
                rows = len(frame.collect())
                verdict = "rows only"
        except Exception as error:  # a report line per query, whatever went wrong
            verdict, rows = f"FAILED {type(error).__name__}: {str(error)[:600]}", -1
        bad += verdict.startswith(("DIFFERS", "FAILED"))
        print(f"{name:34s} {rows:7d} rows {time.time() - start:6.2f}s {verdict}", flush=True)
    print(f"{bad} bad of {len(names or queries)}")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1], sys.argv[2:]) else 0)
