"""Compare registered queries with their SQL in DuckDB.

Run as a script for a report: ``python tests/oracle.py [sf_dir] [query ...]``.
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame[sorted(frame.columns)].copy()
    for c in frame.columns:
        column = frame[c]
        if pd.api.types.is_datetime64_any_dtype(column):
            frame[c] = column.astype("datetime64[us]").astype(str)
        elif pd.api.types.is_float_dtype(column):
            frame[c] = column.map(lambda x: "" if pd.isna(x) else repr(float(x)))
        else:
            frame[c] = column.map(
                lambda x: "" if x is None or x is pd.NaT or (isinstance(x, float) and np.isnan(x))
                else str(x)
            )
    return frame.sort_values(list(frame.columns)).reset_index(drop=True)


def differences(spark_rows: pd.DataFrame, sql_rows: pd.DataFrame) -> str:
    """Empty when both hold the same rows, else what differs."""
    if sorted(spark_rows.columns) != sorted(sql_rows.columns):
        return f"columns {sorted(spark_rows.columns)} / {sorted(sql_rows.columns)}"
    kinds = {
        c: (spark_rows[c].dtype, sql_rows[c].dtype)
        for c in spark_rows
        if spark_rows[c].dtype.kind != sql_rows[c].dtype.kind
        and not spark_rows[c].isna().any()
        and not sql_rows[c].isna().any()
    }
    if kinds:
        return f"types {kinds}"
    if len(spark_rows) != len(sql_rows):
        return f"rows {len(spark_rows)} / {len(sql_rows)}"
    a, b = _plain(spark_rows), _plain(sql_rows)
    unequal = (a != b).any(axis=1)
    if not unequal.any():
        return ""
    i = int(np.flatnonzero(unequal)[0])
    bad = [c for c in a if a[c][i] != b[c][i]]
    return f"{int(unequal.sum())} rows; first {a.loc[i, bad].to_dict()} / {b.loc[i, bad].to_dict()}"


def main() -> None:
    from wattframe.plans.checks import CHECKS
    from wattframe.plans.registry import QUERIES
    from wattframe.session import build_session
    from wattframe.workspace import use_local_folder

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark = build_session(
        master="local[8]", conf={"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    use_local_folder(spark)
    con = connect(sf_dir)
    failed = 0
    for name in names:
        start = time.time()
        try:
            rows = QUERIES[name](spark, sf_dir).toPandas()
            took = time.time() - start
            if name not in CHECKS:
                print(f"rows  {name} {len(rows)} {took:.1f}s", flush=True)
                continue
            found = differences(rows, con.execute(CHECKS[name]).df())
        except Exception as error:
            found, took, rows = f"error {str(error)[:600]}", time.time() - start, ()
        failed += bool(found)
        print(f"{'FAIL' if found else 'ok  '}  {name} {len(rows)} {took:.1f}s {found}", flush=True)
    print(f"{failed} failed of {len(names)}")


if __name__ == "__main__":
    main()
