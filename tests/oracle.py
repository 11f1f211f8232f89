"""Compares a query's rows with those of its DuckDB SQL."""

from __future__ import annotations

import datetime
import decimal
import math
import os

import duckdb

DATA = "/root/testdata"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    """A value as plain Python, the same for both engines."""
    if isinstance(v, dict):
        return tuple(plain(x) for x in v.values())
    if hasattr(v, "asDict"):
        return tuple(plain(x) for x in v)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, decimal.Decimal):
        v = float(v) if v % 1 else int(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else (int(v) if v == int(v) and abs(v) < 2**53 else v)
    if isinstance(v, (datetime.date, datetime.datetime)):
        return str(v)
    return v


def rows(names: list[str], data) -> list:
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def differences(spark_df, con, sql: str) -> str:
    """What differs between a DataFrame and a query, or nothing."""
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    if sorted(names) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} and {sorted(names)}"
    want, got = rows(names, found.fetchall()), rows(spark_df.columns, spark_df.collect())
    if len(want) != len(got):
        return f"{len(got)} rows and {len(want)} of SQL; only here: {[r for r in got if r not in set(want)][:2]}"
    bad = [(g, w) for g, w in zip(got, want, strict=True) if g != w]
    return f"{len(bad)} of {len(got)} rows differ: {bad[:2]}" if bad else ""
