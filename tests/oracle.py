"""Runs a query in Spark and its SQL in DuckDB and compares the rows as multisets."""

from __future__ import annotations

import math
import os
from collections import Counter

import duckdb

DATA = "/root/testdata"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else 0.0 if v == 0 else v
    return v.replace(tzinfo=None) if hasattr(v, "tzinfo") and v.tzinfo else tuple(v) if isinstance(v, list) else v


def sql_rows(sql: str, d: str) -> tuple[list[str], Counter]:
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        if os.path.exists(p := f"{d}/{t}.parquet"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    out = con.sql(sql)
    names = out.columns
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), Counter(tuple(plain(r[i]) for i in order) for r in out.fetchall())


def spark_rows(df) -> tuple[list[str], Counter]:
    names = sorted(df.columns)
    return names, Counter(tuple(plain(v) for v in r) for r in df.select(*[f"`{n}`" for n in names]).collect())


def difference(df, sql: str, d: str) -> str:
    """Empty if the two agree."""
    (names, mine), (theirs_names, theirs) = spark_rows(df), sql_rows(sql, d)
    if names != theirs_names:
        return f"columns {names} and {theirs_names}"
    return "" if mine == theirs else f"{sum((mine - theirs).values())} and {sum((theirs - mine).values())} rows of {sum(mine.values())} and {sum(theirs.values())} differ: {sorted((mine - theirs).items(), key=str)[:3]} {sorted((theirs - mine).items(), key=str)[:3]}"
