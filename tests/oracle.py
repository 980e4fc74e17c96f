"""Compares a Spark result with DuckDB's, as the driver does: columns by name, rows in any order."""

from __future__ import annotations

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canon(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]

    def value(x: object) -> object:
        if x is None or x is pd.NaT or (isinstance(x, float) and x != x) or x is pd.NA:
            return None
        if hasattr(x, "isoformat"):
            return pd.Timestamp(x).isoformat()
        if isinstance(x, bool) or type(x).__name__ == "bool_":
            return bool(x)
        if isinstance(x, (int, float)) or hasattr(x, "item"):
            return round(float(x), 6)
        return str(x)

    return sorted((tuple(value(x) for x in row) for row in frame.itertuples(index=False)), key=str)


def differ(spark_frame: pd.DataFrame, sql_frame: pd.DataFrame) -> str:
    """Nothing, or what differs."""
    if sorted(spark_frame.columns) != sorted(sql_frame.columns):
        return f"columns {sorted(spark_frame.columns)} and {sorted(sql_frame.columns)}"
    a, b = canon(spark_frame), canon(sql_frame)
    if len(a) != len(b):
        return f"{len(a)} and {len(b)} rows"
    return next((f"{x} and {y}" for x, y in zip(a, b, strict=True) if x != y), "")
