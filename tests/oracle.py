"""Comparison of a query's rows with those of its SQL in DuckDB."""

from __future__ import annotations

import datetime
import decimal
import math
from collections import Counter
from pathlib import Path

import duckdb


def plain(value):
    """Values of both engines in one form; floats by eight significant digits."""
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else 0.0 if value == 0 else float(f"{value:.8g}")
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, datetime.date):
        return value.isoformat()
    if isinstance(value, dict):
        return tuple(sorted((str(k), plain(v)) for k, v in value.items()))
    if isinstance(value, list | tuple):
        return tuple(plain(v) for v in value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), Counter(tuple(plain(r[i]) for i in order) for r in rows)


def duck(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in sorted(Path(folder).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def differences(df, con, sql: str) -> str:
    """Empty if both have the same columns and rows."""
    got_names, got = rows_of(df.columns, df.collect())
    cursor = con.execute(sql)
    want_names, want = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    if got_names != want_names:
        return f"columns {got_names}, wanted {want_names}"
    if got == want:
        return ""
    more, less = got - want, want - got
    return f"{got.total()} rows, wanted {want.total()}; only here: {list(more)[:3]}; only in SQL: {list(less)[:3]}"


def main(folder: str, *names: str) -> None:
    """Every query (or those named) on a folder, with seconds: ``python -m tests.oracle FOLDER [NAME...]``."""
    import time

    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, queries, sql = duck(folder), entry.queries(), entry.oracle_sql()
    for name in names or queries:
        began = time.time()
        try:
            df = queries[name](spark, folder)
            said = (differences(df, con, sql[name]) or "equal") if name in sql else f"{df.count()} rows, no SQL"
        except Exception as e:  # noqa: BLE001  the next ones are wanted too
            said = f"FAILED {type(e).__name__}: {str(e)[:300]}"
        print(f"{name} {time.time() - began:.1f} s: {said}", flush=True)
    spark.stop()


if __name__ == "__main__":
    import sys

    main(*sys.argv[1:])
