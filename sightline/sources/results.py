"""Sinks for per-frame results.

A result belongs to the content it was computed from and to the settings it was computed with
(``content_hash``, ``settings_key``). A store keeps the rows of each such pair once, in the batch
that brought them first.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

STORED = ("video_id", "content_hash", "settings_key")


def write_results(df: DataFrame, path: str, mode: str = "append") -> None:
    """Write results keyed by ``content_hash`` and ``settings_key``, one folder per video."""
    _check(df)
    df.write.mode(mode).partitionBy("video_id").parquet(path)


def _check(df: DataFrame) -> None:
    missing = set(STORED) - set(df.columns)
    if missing:
        raise ValueError(f"results lack {sorted(missing)}")


def read_results(spark: SparkSession, path: str) -> DataFrame | None:
    """All rows of a store with the ``batch`` that brought them; None if nothing was saved yet."""
    try:
        return spark.read.option("basePath", path).parquet(f"{path}/batch=*")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


def save_results(df: DataFrame, path: str, batch: str | int) -> None:
    """Add the results that the store does not have, as ``batch``.

    Safe to run again, whether the first run failed on the way or not: a batch has a folder of its
    own that a repetition replaces, and what other batches hold is left out by content and
    settings. One batch is written at a time. Rows of one content and settings belong together
    and should come in one batch. A null hash or key is a value like others.
    """
    _check(df)
    old = read_results(df.sparkSession, path)
    if old is not None:
        known = old.where(F.col("batch").cast("string") != str(batch)).select(*(F.col(c).alias(f"{c}_known") for c in STORED)).distinct()
        df = df.join(known, on=[df[c].eqNullSafe(known[f"{c}_known"]) for c in STORED], how="left_anti")
    df.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def stream_results(df: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """``save_results`` of each batch of a stream: a batch that is replayed replaces what it left."""

    def write(batch: DataFrame, batch_id: int) -> None:
        save_results(batch, path, batch_id)

    writer = df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
