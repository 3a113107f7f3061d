"""Run queries in Spark and their oracle in DuckDB over the same tables and compare."""

from __future__ import annotations

import glob
import os
import sys
import tempfile
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def session(cores: int = 8):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-checkpoint-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def normal(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if str(df[c].dtype).startswith("datetime"):
            df[c] = df[c].astype("datetime64[us]")
        if str(df[c].dtype) == "Int64" and df[c].isna().any():
            df[c] = df[c].astype("float64")  # as Spark returns whole numbers among nulls
    rows = df.astype(object).where(df.notna(), None)
    order = rows.astype(str).sort_values(list(rows.columns)).index
    return df.loc[order].reset_index(drop=True)


KINDS = {"int32": "int", "int64": "int", "float64": "float", "Int64": "int", "Int32": "int"}


def difference(left: pd.DataFrame, right: pd.DataFrame) -> str | None:
    if sorted(left.columns) != sorted(right.columns):
        return f"columns {sorted(left.columns)} vs {sorted(right.columns)}"
    if len(left) != len(right):
        return f"rows {len(left)} vs {len(right)}"
    a, b = normal(left), normal(right)
    for c in a.columns:
        if str(a[c].dtype) != str(b[c].dtype):
            return f"type of {c}: {a[c].dtype} vs {b[c].dtype}"
        x, y = a[c], b[c]
        same = (x == y) | (x.isna() & y.isna())
        if not same.all():
            i = same.idxmin()
            return f"{(~same).sum()} values of {c}, first at {i}:\n{a.loc[i].to_dict()}\n{b.loc[i].to_dict()}"
    return None


def main() -> int:
    import __spark_entry__ as entry

    sf = os.environ.get("SF", "0.01")
    sf_dir = f"/root/testdata/sf{sf}"
    wanted = sys.argv[1:]
    spark, con = session(), duck(sf_dir)
    oracles = entry.oracle_sql()
    bad = 0
    for name, query in entry.queries().items():
        if wanted and not any(name == w or name.startswith(w.rstrip("*")) and w.endswith("*") for w in wanted):
            continue
        start = time.time()
        try:
            got = query(spark, sf_dir).toPandas()
            took = time.time() - start
            if name in oracles:
                start = time.time()
                diff = difference(got, con.execute(oracles[name]).df())
                duck_s = time.time() - start
            else:
                diff, duck_s = None, 0
        except Exception as e:  # show and go on with the next query
            got, took, duck_s, diff = [], time.time() - start, 0, f"{type(e).__name__}: {str(e)[:1500]}"
        bad += diff is not None
        state = "DIFF" if diff else ("ok" if name in oracles else "rows")
        print(f"{state:5}{name:32}{len(got):8} rows {took:6.2f}s  duck {duck_s:.2f}s", flush=True)
        if diff:
            print("     ", diff, flush=True)
    print("differences:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(min(1, main()))
