"""Compare a query with its SQL on DuckDB, without regard to row order."""

from __future__ import annotations

from pathlib import Path

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c


def norm(v):
    if isinstance(v, float):
        return None if v != v else round(v, 9)
    if isinstance(v, dict):
        return tuple(norm(x) for x in v.values())
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def rows_of(df) -> list:
    cols = sorted(df.columns)
    return sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)


def rows_of_sql(c: duckdb.DuckDBPyConnection, sql: str) -> tuple[list[str], list]:
    res = c.execute(sql)
    cols = [d[0] for d in res.description]
    at = [cols.index(k) for k in sorted(cols)]
    return sorted(cols), sorted((tuple(norm(r[i]) for i in at) for r in res.fetchall()), key=repr)


def same(df, c, sql) -> None:
    cols, expected = rows_of_sql(c, sql)
    assert sorted(df.columns) == cols
    assert rows_of(df) == expected
