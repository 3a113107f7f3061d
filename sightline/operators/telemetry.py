"""Stage timings: categories, recent statistics, roll-ups and frame rates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.labels import stage_category
from ..settings import TELEMETRY
from .ordered import newest, rolling

STAGE = ("video_id", "category", "sub")


def categorize_stage(df: DataFrame) -> DataFrame:
    category, sub = stage_category(F.col("process_name"))
    return df.withColumns({"category": category, "sub": sub})


def stage_stats(timings: DataFrame, history: int = TELEMETRY.history, keys=STAGE) -> DataFrame:
    """Last, mean and highest of the newest ``history`` durations of each stage."""
    recent = newest(categorize_stage(timings), keys, ["seq"], history)
    return recent.groupBy(*keys).agg(
        F.count("*").alias("samples"),
        F.max("seq").alias("last_seq"),
        F.max(F.when(F.col("age") == 1, F.col("duration_ms"))).alias("last_ms"),
        F.avg("duration_ms").alias("avg_ms"),
        F.max("duration_ms").alias("max_ms"),
    )


def stage_rollup(stats: DataFrame, keys=("video_id",)) -> DataFrame:
    """One row per category: its own series if it has one, else the sum of its parts.

    Field Segmentation always shows the sum of its parts.
    """
    own = F.col("sub").isNull()
    groups = stats.groupBy(*keys, "category")
    aggs = [F.max(own & (F.col("category") != "Field Segmentation")).alias("own_series")]
    for c in ("last_ms", "avg_ms", "max_ms"):
        aggs.append(F.max(F.when(own, F.col(c))).alias(f"own_{c}"))
        aggs.append(F.coalesce(F.sum(F.when(~own, F.col(c))), F.lit(0.0)).alias(f"parts_{c}"))
    d = groups.agg(*aggs)
    return d.select(
        *keys, "category", "own_series",
        *[
            F.when(F.col("own_series"), F.col(f"own_{c}")).otherwise(F.col(f"parts_{c}")).alias(c)
            for c in ("last_ms", "avg_ms", "max_ms")
        ],
    )


def stage_latest(timings: DataFrame, keys=("video_id",)) -> DataFrame:
    """Newest duration of each stage, shown as 0 if it did not run in the newest frame."""
    keys = list(keys)
    d = categorize_stage(timings)
    last = d.groupBy(*keys, "category", "sub").agg(
        F.max(F.struct("seq", "frame_idx", "duration_ms")).alias("m"),
        F.max("frame_idx").alias("newest_run"),
    )
    frame = d.groupBy(*keys).agg(F.max("frame_idx").alias("newest_frame"))
    out = last.join(frame, keys)
    touched = F.col("newest_run") == F.col("newest_frame")
    return out.select(
        *keys, "category", "sub", "newest_frame",
        F.when(touched, F.col("m.duration_ms")).otherwise(0.0).alias("shown_ms"),
    )


def inference_breakdown(timings: DataFrame, keys=("video_id",)) -> DataFrame:
    """Model phases ``(model, phase, duration_ms)`` → totals, player:disc ratio, inference %."""
    ms = F.col("duration_ms")

    def total(cond):
        return F.coalesce(F.sum(F.when(cond, ms)), F.lit(0.0))

    model, phase = F.col("model"), F.col("phase")
    d = timings.groupBy(*keys).agg(
        total(model == "player").alias("player_ms"),
        total(model == "disc").alias("disc_ms"),
        total(phase == "inference").alias("inference_ms"),
        F.sum(ms).alias("total_ms"),
    )
    both = (F.col("player_ms") > 0) & (F.col("disc_ms") > 0)
    return d.withColumns(
        {
            "model_ratio": F.when(both, F.col("player_ms") / F.col("disc_ms")),
            "inference_pct": F.when(
                both & (F.col("inference_ms") > 0),
                F.col("inference_ms") / F.col("total_ms") * F.lit(100.0),
            ),
        }
    )


def frame_times(timings: DataFrame, keys=("video_id",)) -> DataFrame:
    """Total processing time of each frame."""
    return timings.groupBy(*keys, "frame_idx").agg(F.sum("duration_ms").alias("frame_ms"))


def rolling_fps(
    frames: DataFrame, samples: int = TELEMETRY.fps_samples, keys=("video_id",)
) -> DataFrame:
    """Frames per second from the mean of each frame's and the preceding frames' times."""
    d = rolling(frames, list(keys), ["frame_idx"], samples, {"mean_ms": F.avg("frame_ms")})
    fps = F.when(F.col("mean_ms") > 0, F.lit(1000.0) / F.col("mean_ms")).otherwise(0.0)
    return d.withColumn("fps", fps)


def rolling_stage_stats(
    timings: DataFrame, n: int = TELEMETRY.recent, keys=("video_id", "process_name")
) -> DataFrame:
    """Mean and highest of each duration and the ``n - 1`` before it in the same stage."""
    from .ordered import chunk_of

    return rolling(
        timings, list(keys), ["seq"], n,
        {"avg_ms": F.avg("duration_ms"), "max_ms": F.max("duration_ms")},
        chunk=chunk_of("seq"),
    )
