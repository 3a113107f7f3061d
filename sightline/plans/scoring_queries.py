"""Queries through the model plug-in points, with arithmetic in place of a model."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions.registered import register_functions
from ..operators.scoring import score_crops, score_frames
from .catalog import query, raw, table, view


def stub_detector():
    """Two box slots per frame, the second left empty on every third frame."""

    def predict(numbers: np.ndarray) -> np.ndarray:
        n = numbers.astype(np.float32)
        left = np.mod(n, 500)
        first = [left, left + 1, left + 40.5, left + 90.5, np.mod(n, 4) * 0.25, n * 0]
        second = [left + 9, left, left + 30, left + 60, n * 0 + 0.75, n * 0]
        second[4] = np.where(np.mod(n, 3) == 0, np.nan, second[4])
        return np.stack(first + second, axis=1)

    return predict


def stub_reader():
    def predict(numbers: list[int]) -> list[str]:
        return [f'[{{"poly": [], "text": "{n % 100}", "conf": {n % 8 / 8}}}]' for n in numbers]

    return predict


@query(
    "score_frames",
    """SELECT event_id AS frame_idx, CAST(i AS BIGINT) AS det_idx, CAST(CASE i WHEN 0 THEN event_id % 500 ELSE event_id % 500 + 9 END AS BIGINT) AS x1,
    CAST(CASE i WHEN 0 THEN event_id % 500 + 90 ELSE event_id % 500 + 60 END AS BIGINT) AS y2,
    CASE i WHEN 0 THEN event_id % 4 * 0.25::DOUBLE ELSE 0.75::DOUBLE END AS confidence, 'player_model' AS model_type
    FROM events, range(0, 2) t(i) WHERE i = 0 OR event_id % 3 <> 0""",
)
def _(spark, sf):
    frames = raw(spark, sf, "events").select(
        (F.col("user_id") % 4).alias("video_id"), F.col("event_id").alias("frame_idx"),
        F.col("event_id").cast("float").alias("n"),
    )
    out = score_frames(frames, stub_detector, ["n"], "player")
    return out.select(
        "frame_idx", "det_idx", F.col("x1").cast("bigint").alias("x1"),
        F.col("y2").cast("bigint").alias("y2"), "confidence", "model_type",
    )


@query(
    "score_crops",
    "SELECT event_id AS crop_id, CAST(event_id % 100 AS VARCHAR) AS text, CAST(event_id % 8 AS DOUBLE) / 8 AS conf FROM events",
)
def _(spark, sf):
    crops = raw(spark, sf, "events").select(
        F.col("event_id").alias("crop_id"), F.col("event_id").alias("n")
    )
    out = score_crops(crops, stub_reader, ["n"])
    return out.select("crop_id", F.inline("results")).select("crop_id", "text", "conf")


@query(
    "sql_track_objects",
    f"SELECT video_id, count(*) AS rows FROM {view('detections')} GROUP BY 1",
)
def _(spark, sf):
    register_functions(spark)
    d = table(spark, sf, "detections").select(
        "video_id", "frame_idx", "det_idx", "x1", "y1", "x2", "y2", "class_name", "confidence"
    )
    out = spark.sql(
        "SELECT * FROM track_objects(TABLE({d}) PARTITION BY video_id ORDER BY (frame_idx, det_idx))",
        d=d,
    )
    return out.groupBy("video_id").agg(F.count("track_id").alias("rows"))
