"""Work reuse by frame content: duplicates, what is left to do, repeat rate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORK = ("content_hash", "settings_key")


def content_hash(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn("content_hash", F.md5(F.col(column)))


def settings_key(*stages: tuple[str, bool]) -> str:
    """Key of a run's settings: which stages are on, in order."""
    return "|".join(str(on) for _, on in stages)


def unprocessed_frames(frames: DataFrame, done: DataFrame, keys=WORK) -> DataFrame:
    """Frames whose content was not yet processed with the same settings."""
    return frames.join(done.select(*keys).distinct(), list(keys), "left_anti")


def dedup_frames(frames: DataFrame, keys=("content_hash",)) -> DataFrame:
    """The first frame (by video, then index) of each content.

    Copies fold together inside each task, so a content shared by very many
    frames shuffles one row per task.
    """
    rest = [c for c in frames.columns if c not in ("video_id", "frame_idx", *keys)]
    first = F.min(F.struct("video_id", "frame_idx", *rest))
    return (
        frames.groupBy(*keys)
        .agg(first.alias("f"), F.count("*").alias("copies"))
        .select(*keys, "f.*", "copies")
    )


def repeat_rate(frames: DataFrame, keys=WORK, by=()) -> DataFrame:
    """Share of requests that repeat an earlier (content, settings)."""
    per_key = frames.groupBy(*by, *keys).agg(F.count("*").alias("n"))
    d = per_key.groupBy(*by).agg(
        F.sum("n").cast("bigint").alias("requests"), F.count("*").alias("misses")
    )
    hits = F.col("requests") - F.col("misses")
    return d.withColumns({"hits": hits, "hit_rate": F.try_divide(hits, F.col("requests"))})
