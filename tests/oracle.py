"""Compares queries with their SQL, row by row without order."""

from __future__ import annotations

import datetime
import decimal
import math

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def value(v):
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, decimal.Decimal)) and not isinstance(v, bool):
        return f"{float(v):.6g}" if isinstance(v, decimal.Decimal) else str(v)
    if isinstance(v, float):
        return "None" if math.isnan(v) else f"{v:.6f}"
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return str(v)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted([tuple(value(r[i]) for i in order) for r in data])


def compare(spark, sf, name, query, sql):
    import os

    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}/*.parquet')" if os.path.isdir(p) else f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    con.execute(sql)
    want_names = [c[0] for c in con.description]
    want = rows(want_names, con.fetchall())
    df = query(spark, sf)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    if sorted(want_names) != sorted(df.columns):
        return f"columns {df.columns} {want_names}"
    if got != want:
        a, b = set(got) - set(want), set(want) - set(got)
        return f"rows {len(got)} {len(want)}; only spark {sorted(a)[:4]}; only sql {sorted(b)[:4]}"
    return ""
