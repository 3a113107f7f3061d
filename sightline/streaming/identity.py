"""Jersey fusion as keyed state: the batch fold, one track at a time, as readings arrive."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.identity import FUSED, JerseyFusion, _weighted
from ..settings import JERSEY, JerseyDefaults
from .ordered import InOrder, carry_code


class _Fusion(InOrder):
    columns = "ts TIMESTAMP, frame_idx BIGINT, seq BIGINT, jersey_number STRING, weight DOUBLE"
    order = ("frame_idx", "seq")

    def __init__(self, settings: JerseyDefaults, idle_ms: int):
        self.settings, self.idle_ms = settings, idle_ms

    def start(self, handle) -> None:
        # One value, so that a track costs one read and one write however many numbers it has.
        self.fused = handle.getValueState(
            "fused", "readings ARRAY<STRUCT<number: STRING, weight: DOUBLE>>, "
            "live ARRAY<STRUCT<number: STRING, probability: DOUBLE, last_seen: BIGINT, count: BIGINT>>"
        )

    def forget(self) -> None:
        self.fused.clear()

    def advance(self, key, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        readings, live = self.fused.get() or ((), ())
        fusion = JerseyFusion(self.settings, [tuple(r) for r in readings], {n: tuple(e) for n, *e in live})
        for rows in frames:
            fusion.take(rows["frame_idx"].to_numpy(), rows["jersey_number"].tolist(), rows["weight"].to_numpy())
        entries = [(number, *entry) for number, entry in fusion.live.items()]
        self.fused.update(([tuple(r) for r in fusion.window], entries))
        yield pd.DataFrame(
            [(int(key[0]), int(key[1]), *entry) for entry in entries],
            columns=[c.split()[0] for c in FUSED.split(", ")],
        )


def fuse_jerseys_stream(
    measurements: DataFrame, delay: str = "2 seconds", settings: JerseyDefaults = JERSEY,
    idle_ms: int = 60_000,
) -> DataFrame:
    """Probabilities of each track after each advance of the watermark (update mode).

    Out-of-order readings wait for the watermark, so the result equals the batch
    fold over the readings passed so far.
    """
    carry_code()
    d = _weighted(measurements, settings).select(
        "video_id", "track_id", F.col("ts").cast("timestamp").alias("ts"), "frame_idx", "seq",
        "jersey_number", "weight",
    )
    return d.withWatermark("ts", delay).groupBy("video_id", "track_id").transformWithStateInPandas(
        statefulProcessor=_Fusion(settings, idle_ms), outputStructType=FUSED,
        outputMode="Update", timeMode="EventTime",
    )
