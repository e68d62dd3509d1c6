"""Side-by-side comparison of a registered query and its SQL."""

from __future__ import annotations

import datetime as dt
import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return round(float(v), 6)
    return str(v)


def rows_of_spark(df):
    columns = sorted(df.columns)
    return columns, sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)


def rows_of_sql(con, text):
    got = con.execute(text)
    names = [c[0] for c in got.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in got.fetchall()), key=repr)


def difference(df, con, text) -> str | None:
    ca, a = rows_of_spark(df)
    cb, b = rows_of_sql(con, text)
    if ca != cb:
        return f"columns {ca} / {cb}"
    if a == b:
        return None
    sa, sb = set(a), set(b)
    return f"{len(a)} / {len(b)} rows; only spark {sorted(sa - sb, key=repr)[:2]}; only sql {sorted(sb - sa, key=repr)[:2]}"
