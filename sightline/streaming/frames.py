"""Stateless and windowed work on detection, timing and metric streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import detections as det
from ..operators import telemetry as tel
from ..settings import DEFAULT_FPS, TRACK

STAGES = ("threshold", "players", "foot", "crop")


def detection_stream(
    detections: DataFrame, stages=STAGES, width: int = 1920, height: int = 1080
) -> DataFrame:
    """Per-detection stages over a stream; a stage that is off is not in the plan."""
    unknown = set(stages) - set(STAGES)
    if unknown:
        raise ValueError(f"unknown stages {sorted(unknown)}")
    out = detections
    if "threshold" in stages:
        out = det.filter_confidence(out)
    if "players" in stages:
        out = det.player_only(out)
    if "foot" in stages:
        out = det.foot_point(out)
    if "crop" in stages:
        out = det.min_crop_filter(det.jersey_crop(out, width, height))
    return out


def drop_repeats(frames: DataFrame, delay: str = "10 seconds", keys=("content_hash",)) -> DataFrame:
    """First arrival of each content within the delay; late copies fall to the watermark."""
    return frames.withWatermark("ts", delay).dropDuplicatesWithinWatermark(list(keys))


def stage_windows(
    timings: DataFrame, length: str = "1 minute", delay: str = "10 seconds", keys=("video_id",)
) -> DataFrame:
    """Newest, mean and highest duration of each stage per time window."""
    d = tel.categorize_stage(timings).withColumn("sub", F.coalesce("sub", F.lit("")))
    if d.isStreaming:
        d = d.withWatermark("ts", delay)
    return d.groupBy(*keys, F.window("ts", length).alias("w"), "category", "sub").agg(
        F.count("*").alias("samples"),
        F.max_by("duration_ms", "seq").alias("last_ms"),
        F.avg("duration_ms").alias("avg_ms"),
        F.max("duration_ms").alias("max_ms"),
    ).select(*keys, F.col("w.start").alias("window_start"), "category", "sub", "samples",
             "last_ms", "avg_ms", "max_ms")


def track_sessions(
    tracks: DataFrame, max_age: int = TRACK.max_age, fps: float = DEFAULT_FPS,
    delay: str = "10 seconds", gap: str | None = None,
) -> DataFrame:
    """Unbroken appearances of each track: a pause above ``max_age`` frames ends one."""
    gap = gap or f"{max_age / fps} seconds"
    d = tracks.withWatermark("ts", delay) if tracks.isStreaming else tracks
    return d.groupBy("video_id", "track_id", F.session_window("ts", gap).alias("s")).agg(
        F.count("*").alias("sightings")
    ).select("video_id", "track_id", F.col("s.start").alias("session_start"),
             F.col("s.end").alias("session_end"), "sightings")


def live_comparison(metrics: DataFrame, baseline: DataFrame) -> DataFrame:
    """Each arriving metric beside the baseline run's value for the same epoch."""
    base = baseline.select("metric", "epoch", F.col("value").alias("baseline"))
    return metrics.join(base, ["metric", "epoch"], "left").withColumn(
        "delta", F.col("value") - F.col("baseline")
    )
