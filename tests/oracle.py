"""Compare queries with their SQL: python tests/oracle.py SF_DIR [NAME...]; also used by the tests."""

from __future__ import annotations

import os
import sys

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def expected(sf_dir: str, sql: str) -> pd.DataFrame:
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con.sql(sql).df()


def _plain(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df:
        if str(df[c].dtype).startswith("datetime"):
            df[c] = df[c].dt.strftime("%Y-%m-%d %H:%M:%S")
        elif df[c].dtype == object or str(df[c].dtype) in ("str", "string"):
            df[c] = [None if x is None or x is pd.NaT or x != x else x if isinstance(x, (int, float)) else f"{x} 00:00:00" if type(x).__name__ == "date" else str(x) for x in df[c]]
        else:
            df[c] = df[c].astype(float)
    return df.sort_values(list(df.columns), ignore_index=True)


def differs(got: pd.DataFrame, want: pd.DataFrame) -> str:
    """What differs, or nothing."""
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} and {sorted(want.columns)}"
    if len(got) != len(want):
        return f"{len(got)} rows and {len(want)}"
    try:
        pd.testing.assert_frame_equal(_plain(got), _plain(want), check_dtype=False, atol=2e-6, rtol=1e-9)
    except AssertionError as e:
        return str(e)
    return ""


if __name__ == "__main__":
    import time

    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "6g").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir, oracle, queries = sys.argv[1], entry.oracle_sql(), entry.queries()
    for name in sys.argv[2:] or oracle:
        began = time.time()
        try:
            got = queries[name](spark, sf_dir).toPandas()
            why = differs(got, expected(sf_dir, oracle[name])) if name in oracle else "no SQL"
            print("RESULT", name, len(got), f"{time.time() - began:.1f}s", "equal" if not why else why[:400].replace("\n", " "), flush=True)
        except Exception as e:
            print("RESULT", name, "ERROR", str(e)[:400].replace("\n", " "), flush=True)
