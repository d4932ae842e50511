"""Compare a Spark result with DuckDB running the oracle SQL on the same
parquet tables: row count, column names and an order-insensitive value hash."""

from __future__ import annotations

import datetime as dt
import decimal
import hashlib
import math

import duckdb
import pandas as pd

SOURCE_VIEWS = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
                "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in SOURCE_VIEWS:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return f"{v:.6g}" if abs(v) < 1e15 else f"{v:.9e}"
    if isinstance(v, decimal.Decimal):
        return _norm(float(v))
    if isinstance(v, (pd.Timestamp, dt.datetime)):
        return pd.Timestamp(v).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if hasattr(v, "item"):
        return _norm(v.item())
    if isinstance(v, (list, tuple)):
        return str([_norm(x) for x in v])
    return str(v)


def digest(df: pd.DataFrame) -> tuple[int, list[str], str]:
    cols = sorted(df.columns)
    rows = sorted("|".join(str(_norm(x)) for x in r)
                  for r in df[cols].astype(object).where(df[cols].notna(), None).itertuples(index=False))
    h = hashlib.sha256("\n".join(rows).encode()).hexdigest()
    return len(df), cols, h


def compare(spark_df, con, sql: str) -> dict:
    sp = spark_df.toPandas()
    ok = con.execute(sql).df()
    a, b = digest(sp), digest(ok)
    res = {"rows": (a[0], b[0]), "cols_match": a[1] == b[1], "hash_match": a[2] == b[2]}
    if a[1] != b[1]:
        res["cols"] = (a[1], b[1])
    res["ok"] = a[0] == b[0] and a[1] == b[1] and a[2] == b[2]
    return res
