"""Spark-vs-DuckDB comparison in the style of the driver's correctness gate:
same row count, same column names, equal values (order-insensitive, columns
sorted by name). Values are compared exactly after normalising types."""

from __future__ import annotations

import datetime as dt
import decimal
import hashlib
import math

import duckdb

VIEWS = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
         "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for v in VIEWS:
        con.sql(f"CREATE VIEW {v} AS SELECT * FROM '{sf_dir}/{v}.parquet'")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else repr(float(v))
    if isinstance(v, decimal.Decimal):
        return repr(float(v))
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, int):
        return str(v)
    if isinstance(v, dt.datetime):
        return v.isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    return str(v)


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    key = lambda t: tuple((v is None, v or "") for v in t)
    return (sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=key),
            [cols[i] for i in order])


def digest(rows) -> str:
    h = hashlib.sha1()
    for r in rows:
        h.update(repr(r).encode())
    return h.hexdigest()


def compare(spark_df, con, sql: str) -> dict:
    s_cols = spark_df.columns
    s_rows = [tuple(r) for r in spark_df.collect()]
    rel = con.sql(sql)
    d_cols = rel.columns
    d_rows = rel.fetchall()
    s_sorted, s_names = rows_of(s_cols, s_rows)
    d_sorted, d_names = rows_of(d_cols, d_rows)
    out = {
        "rows_spark": len(s_rows), "rows_oracle": len(d_rows),
        "columns_match": s_names == d_names,
        "values_match": s_sorted == d_sorted,
    }
    if not out["values_match"] and out["columns_match"]:
        diff_s = [r for r in s_sorted if r not in set(d_sorted)][:3]
        diff_d = [r for r in d_sorted if r not in set(s_sorted)][:3]
        out["sample_spark_only"] = diff_s
        out["sample_oracle_only"] = diff_d
    if not out["columns_match"]:
        out["spark_cols"], out["oracle_cols"] = s_names, d_names
    out["ok"] = out["columns_match"] and out["values_match"] and len(s_rows) == len(d_rows)
    return out
