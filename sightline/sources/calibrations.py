"""Append-only registry of calibrations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.projective import H_COLUMNS
from ..operators.calibration import normalize_payload


def save_homography(df: DataFrame, path: str, description: str | None = None) -> None:
    """Append calibrations with their metadata; the newest per video counts when reading."""
    stamped = df if "created_at" in df.columns else df.withColumn(
        "created_at", F.current_timestamp()
    )
    frame = F.col("frame_index") if "frame_index" in df.columns else F.lit(0)
    stamped.select(
        "video_id", frame.cast("bigint").alias("frame_index"),
        F.col("created_at").cast("timestamp").alias("created_at"),
        *[F.col(c).cast("double") for c in H_COLUMNS],
        F.lit(description).cast("string").alias("description"),
    ).write.mode("append").parquet(path)


def read_homographies(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    """All saved calibrations; JSON records may hold the parameters nested or flat."""
    raw = spark.read.format(format).load(path)
    if format == "json":
        if "metadata" in raw.columns:
            inner = raw.schema["metadata"].dataType.fieldNames()
            known = set(raw.columns)
            raw = raw.withColumns(
                {
                    c: F.coalesce(*([F.col(c)] if c in known else []), F.col(f"metadata.{c}"))
                    for c in ("video_id", "created_at", "frame_index") if c in inner
                }
            )
        raw = normalize_payload(raw).withColumn("created_at", F.col("created_at").cast("timestamp"))
    return raw.select("video_id", "frame_index", "created_at", *H_COLUMNS)
