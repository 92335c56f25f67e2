"""Run registered queries beside their SQL; ``python -m tests.oracle_check [sf] [name ...]``."""

from __future__ import annotations

import sys
import time

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for name in df.columns:
        if pd.api.types.is_float_dtype(df[name]):
            df[name] = df[name] + 0.0
        elif pd.api.types.is_extension_array_dtype(df[name]) and pd.api.types.is_integer_dtype(df[name]):
            # Spark hands over whole numbers with nulls as floats.
            df[name] = df[name].astype("float64" if df[name].isna().any() else "int64")
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def difference(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    """What differs, or None."""
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} against {sorted(want.columns)}"
    if len(got) != len(want):
        return f"{len(got)} rows against {len(want)}"
    got, want = canonical(got), canonical(want)
    for name in got.columns:
        if got[name].dtype != want[name].dtype:
            return f"{name}: {got[name].dtype} against {want[name].dtype}"
        wrong = (got[name] != want[name]) & ~(got[name].isna() & want[name].isna())
        if wrong.any():
            return f"{name}: {int(wrong.sum())} values, first {got[wrong].iloc[0].to_dict()} against {want[wrong].iloc[0].to_dict()}"
    return None


if __name__ == "__main__":
    from __spark_entry__ import oracle_sql, queries

    from sealrank.session import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    spark, con = build_session(), connect(sf_dir)
    spark.sparkContext.setLogLevel("ERROR")
    failed = []
    for name, run in queries().items():
        if len(sys.argv) > 2 and name not in sys.argv[2:]:
            continue
        start = time.time()
        try:
            got = run(spark, sf_dir).toPandas()
            mid = time.time()
            want = con.execute(oracle_sql()[name]).df() if name in oracle_sql() else None
            wrong = None if want is None else difference(got, want)
            print(f"{'FAIL' if wrong else 'ok':4} {name:26} rows={len(got):7} spark={mid - start:5.1f}s sql={time.time() - mid:5.1f}s {wrong or ''}", flush=True)
        except Exception as error:  # a failing query must not stop the rest
            wrong = str(error)[:600]
            print(f"ERR  {name} {wrong}", flush=True)
        if wrong:
            failed.append(name)
    print("failed:", failed)
