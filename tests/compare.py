"""Side-by-side comparison of a Spark result and a DuckDB statement."""

from __future__ import annotations

import math

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def _cell(value):
    if value is None:
        return (0, "")
    if isinstance(value, bool):
        return (1, float(value))
    if isinstance(value, (int, float)) or value.__class__.__name__ == "Decimal":
        number = float(value)
        return (1, "nan" if math.isnan(number) else round(number, 5) + 0.0)
    return (2, str(value))


def normalised(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(row[i]) for i in order) for row in rows)


def differences(spark_df, con: duckdb.DuckDBPyConnection, sql: str) -> str:
    """Empty when column names and rows agree, else a short description."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    theirs = normalised(names, result.fetchall())
    ours = normalised(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    if sorted(names) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} vs {sorted(names)}"
    if ours == theirs:
        return ""
    left, right = set(ours), set(theirs)
    return f"rows {len(ours)} vs {len(theirs)}; only Spark {sorted(left - right)[:2]}; only SQL {sorted(right - left)[:2]}"
