"""Compare a query with its SQL in DuckDB, as bags of rows."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb

DATA = "/root/testdata/sf0.001"


def norm(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, float):
        return float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    if type(v).__name__ == "Decimal":
        return float(v)
    return v


def duck(sql: str, data: str = DATA):
    con = duckdb.connect()
    for p in Path(data).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    return con.execute(sql).to_arrow_table()


def compare(spark, query, sql: str, data: str = DATA) -> int:
    got, want = query(spark, data), duck(sql, data)
    cols = sorted(got.columns)
    assert cols == sorted(want.column_names), (cols, sorted(want.column_names))
    a = Counter(tuple(norm(r[c]) for c in cols) for r in got.collect())
    b = Counter(tuple(norm(r[c]) for c in cols) for r in want.to_pylist())
    assert a == b, f"only here: {list((a - b).items())[:5]}; only there: {list((b - a).items())[:5]}"
    return sum(a.values())
