"""Registry of named queries, each with the SQL that states its result where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixtures as fx

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# Frame and canvas of the views: 1920×1080 maps to 1115×3345.
FRAME = (1920, 1080)
CANVAS = (1115, 3345)


def query(name: str, oracle: str | None = None):
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


def view(name: str) -> str:
    return fx.for_duckdb(getattr(fx, name.upper()))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return fx.load(spark, sf_dir, getattr(fx, name.upper()))


def raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def big(*names: str) -> list[Column]:
    return [F.col(n).cast("bigint").alias(n) for n in names]


def r6(*names: str) -> list[Column]:
    return [F.round(F.col(n), 6).alias(n) for n in names]


def sql_big(*names: str) -> str:
    return ", ".join(f"CAST({n} AS BIGINT) AS {n}" for n in names)


def sql_r6(*names: str) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


def sql_project(x: str, y: str, h: str = "h", out: str = "p") -> str:
    """SQL for the image of a point: ``out_x`` and ``out_y``, null at infinity."""
    w = f"nullif({h}.h20 * {x} + {h}.h21 * {y} + 1.0, 0)"
    return (
        f"({h}.h00 * {x} + {h}.h01 * {y} + {h}.h02) / {w} AS {out}_x, "
        f"({h}.h10 * {x} + {h}.h11 * {y} + {h}.h12) / {w} AS {out}_y"
    )
