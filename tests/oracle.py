"""Compare a registered query with its SQL in DuckDB on the driver's tables."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return ""
    if isinstance(v, float):
        return f"{v:.6g}"
    if isinstance(v, bool) or type(v).__name__ == "bool_":
        return str(bool(v))
    return str(v)[:10] if type(v).__name__ in ("date", "datetime", "Timestamp") else str(v)


def rows_of_duckdb(sql, sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted([norm(r[i]) for i in order] for r in cur.fetchall())


def rows_of_spark(df):
    names = sorted(df.columns)
    return names, sorted([norm(r[c]) for c in names] for r in df.collect())
