"""Rows of a DataFrame against those of DuckDB, in any order."""

from __future__ import annotations

import math
import os

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*' if os.path.isdir(path) else ''}')")
    return con


def plain(v) -> str:
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, float):
        return f"{v:.7g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    return str(v)


def rows(columns, values) -> list[str]:
    return sorted("|".join(plain(r[c]) for c in columns) for r in values)


def assert_same(df, con, sql: str) -> None:
    got = [r.asDict(recursive=True) for r in df.collect()]
    want = con.sql(sql).to_arrow_table()
    columns = sorted(df.columns)
    assert columns == sorted(want.column_names)
    assert rows(columns, got) == rows(columns, want.to_pylist())
