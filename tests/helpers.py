"""Running a query and its SQL side by side on a folder of tables."""

import math
import os

import duckdb


def views(d: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in os.listdir(d):
        if t.endswith(".parquet"):
            con.execute(f"CREATE VIEW {t[:-8]} AS SELECT * FROM '{d}/{t}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if hasattr(v, "isoformat"):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, list | tuple):
        return str([plain(x) for x in v])
    return str(v)


def same_rows(df, con, sql: str) -> None:
    got = [tuple(r) for r in df.collect()]
    cur = con.execute(sql)
    names = [x[0] for x in cur.description]
    want = cur.fetchall()
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    key = lambda rows, cols: sorted(tuple(plain(r[cols.index(c)]) for c in order) for r in rows)
    assert key(got, df.columns) == key(want, names)
