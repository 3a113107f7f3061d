"""Online tracking as keyed state: one video per key, frames in order."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.tracking import COLUMNS, TRACKED, TrackSet, track_rows
from ..settings import TRACK, TrackDefaults
from .ordered import InOrder, carry_code


class _Tracker(InOrder):
    order = ("frame_idx", "det_idx")

    def __init__(self, settings: TrackDefaults, age_by: str, looks: bool, idle_ms: int):
        self.settings, self.age_by, self.idle_ms = settings, age_by, idle_ms
        self.columns = (
            "ts TIMESTAMP, frame_idx BIGINT, det_idx BIGINT, x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, "
            "y2 DOUBLE, class_name STRING, confidence DOUBLE"
        ) + (", embedding ARRAY<DOUBLE>" if looks else "")

    def start(self, handle) -> None:
        self.live = handle.getValueState("live", "next_id BIGINT, last_frame BIGINT, tracks STRING")

    def forget(self) -> None:
        # Ids keep counting up, so a video that resumes does not reuse one.
        if self.live.exists():
            next_id, last_frame, _ = self.live.get()
            self.live.update((next_id, last_frame, "[]"))

    def advance(self, key, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = TrackSet(self.settings, self.age_by)
        if self.live.exists():
            state.next_id, state.last_frame, tracks = self.live.get()
            state.tracks = json.loads(tracks)
            for t in state.tracks:
                t["looks"] = [np.array(v) for v in t["looks"]]
        for rows in frames:
            yield track_rows(state, rows).assign(video_id=int(key[0]))[COLUMNS]
        kept = [{**t, "looks": [v.tolist() for v in t["looks"]]} for t in state.tracks]
        self.live.update((int(state.next_id), int(state.last_frame), json.dumps(kept)))


def track_stream(
    detections: DataFrame, delay: str = "2 seconds", settings: TrackDefaults = TRACK,
    age_by: str = "frame", idle_ms: int = 60_000,
) -> DataFrame:
    """Tracks of each video as frames arrive (append mode); frames out of order wait."""
    carry_code()
    looks = "embedding" in detections.columns
    box = [F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")]
    keep = [F.col("embedding").cast("array<double>").alias("embedding")] if looks else []
    d = detections.select(
        "video_id", F.col("ts").cast("timestamp").alias("ts"), "frame_idx", "det_idx", *box,
        "class_name", "confidence", *keep,
    )
    return d.withWatermark("ts", delay).groupBy("video_id").transformWithStateInPandas(
        statefulProcessor=_Tracker(settings, age_by, looks, idle_ms), outputStructType=TRACKED,
        outputMode="Append", timeMode="EventTime",
    )
