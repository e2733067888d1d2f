"""A query's rows beside those of DuckDB, columns by name, rows in any order."""

import decimal
import math
from pathlib import Path

import duckdb

DATA = "/root/testdata/sf0.001"


def cell(x):
    if isinstance(x, decimal.Decimal):
        x = float(x)
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x:.9g}"
    return str(x)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted([cell(r[k]) for k in order] for r in data)


def compare(df, sql, data=DATA):
    con = duckdb.connect()
    for p in Path(data).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    want = rows(names, found.fetchall())
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    assert sorted(names) == sorted(df.columns)
    assert got == want, next((a, b) for a, b in zip([*got, None], [*want, None], strict=False) if a != b)
