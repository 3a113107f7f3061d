"""Helpers shared by operators: reliable lineage cuts and joins on skewed keys."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it in ``spark.checkpoint.dir``.

    Only a local session without one gets a folder of its own.
    """
    sc = spark.sparkContext
    folder = sc.getCheckpointDir()
    if folder is None:
        folder = sc.getConf().get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="spark-checkpoint-")
        sc.setCheckpointDir(folder)
        folder = sc.getCheckpointDir()
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    A lost executor then costs no replay of what came before, the next plan
    starts from a plain scan, and its join choices rest on the true size.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str, most: int | None = None) -> DataFrame:
    """Hash-partition by ``keys`` into the session's shuffle partitions, or one per core if more.

    The explicit number keeps adaptive execution from merging small inputs of
    work that is heavy per row. With ``most``, the rows are counted first, and partitions grow in
    number so that one holds about that many rows, whatever the input's size.
    """
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    if most is not None:
        n = max(n, -(-df.count() // most))
    return df.repartition(n, *keys)


def map_groups(
    df: DataFrame, keys: list[str], order: list[str], fn: Callable[[pd.DataFrame, np.ndarray], pd.DataFrame], schema
) -> DataFrame:
    """Whole small groups through ``fn``, many at a time: its rows sorted by key and ``order``, and
    where each group starts (and the last one ends).

    One call serves an Arrow batch of rows, so a group costs no frame of its own. Rows of a group
    that goes on in the next batch wait for it: groups have to be bounded.
    """

    def starts(pdf: pd.DataFrame) -> np.ndarray:
        new = np.zeros(max(0, len(pdf) - 1), bool)
        for k in keys:
            now, before = pdf[k].iloc[1:], pdf[k].iloc[:-1]
            same = (now.to_numpy() == before.to_numpy()) | (now.isna().to_numpy() & before.isna().to_numpy())
            new |= ~same
        return np.r_[0, np.flatnonzero(new) + 1, len(pdf)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for pdf in batches:
            if held is not None:
                pdf = pd.concat([held, pdf], ignore_index=True)
            if pdf.empty:
                continue
            at = starts(pdf)
            held = pdf.iloc[at[-2] :].reset_index(drop=True)
            if len(at) > 2:
                yield fn(pdf.iloc[: at[-2]], at[:-1])
        if held is not None:
            yield fn(held, np.array([0, len(held)]))

    return spread(df, *keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def salted_join(facts: DataFrame, small: DataFrame, keys, how="inner", salts=16, by=None):
    """Join many ``facts`` rows to few ``small`` rows per key, spreading each key over tasks.

    ``small`` must hold a bounded number of rows per key; it is copied once per
    salt. The salt stays part of the join key only, so an aggregate by the key
    after the join combines in each task before its own shuffle.
    """
    salt = F.pmod(F.xxhash64(*(by or [c for c in facts.columns if c not in keys])), F.lit(salts))
    left = facts.withColumn("__salt", salt.cast("int"))
    right = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*keys, "__salt"], how).drop("__salt")
