"""Compare queries with their SQL: ``python -m tests.compare SF_DIR [name ...]``."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for file in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{file}')")
    return con


def normal(value):
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return value
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    return int(value) if float(value).is_integer() and not isinstance(value, float) else float(value)


def spark_rows(df) -> tuple[list[str], list[tuple]]:
    columns = sorted(df.columns)
    return columns, sorted(
        (tuple(normal(v) for v in row) for row in df.select(columns).collect()), key=lambda r: tuple(map(str, r))
    )


def oracle_rows(con, sql: str) -> tuple[list[str], list[tuple]]:
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    columns = sorted(names)
    places = [names.index(c) for c in columns]
    rows = [tuple(normal(row[i]) for i in places) for row in cursor.fetchall()]
    return columns, sorted(rows, key=lambda r: tuple(map(str, r)))


def differences(spark, con, sf_dir: str, query, sql: str) -> tuple[str, int]:
    columns, rows = spark_rows(query(spark, sf_dir))
    want_columns, want = oracle_rows(con, sql)
    if columns != want_columns:
        return f"columns {columns} != {want_columns}", len(rows)
    if len(rows) != len(want):
        return f"{len(rows)} rows, not {len(want)}", len(rows)
    wrong = [(a, b) for a, b in zip(rows, want, strict=True) if a != b]
    return (f"{len(wrong)} rows differ, e.g. {wrong[0]}" if wrong else ""), len(rows)


def main() -> None:
    from __spark_entry__ import oracle_sql, queries
    from catalog.folders import name_folder
    from graphslice.plans.workspace import release
    from graphslice.session import build_session

    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark = build_session(
        master="local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="12g"
    )
    spark.sparkContext.setLogLevel("ERROR")
    name_folder(spark)
    con, sql = connect(sf_dir), oracle_sql()
    bad = 0
    for name, query in queries().items():
        if names and name not in names:
            continue
        began = time.time()
        try:
            if name in sql:
                problem, n = differences(spark, con, sf_dir, query, sql[name])
            else:
                problem, n = "", len(query(spark, sf_dir).collect())
        except Exception as error:  # report every query, then fail
            problem, n = f"{type(error).__name__}: {str(error)[:600]}", 0
        bad += bool(problem)
        state = "BAD " + problem if problem else "ok" if name in sql else "ok (rows only)"
        print(f"{name:24s} {n:8d} rows {time.time() - began:6.1f}s  {state}", flush=True)
    release(spark)
    print("bad:", bad)
    sys.exit(bool(bad))


if __name__ == "__main__":
    main()
