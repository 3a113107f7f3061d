"""Table functions for SQL: tracking and jersey fusion over partitioned, ordered tables."""

from __future__ import annotations

from operator import itemgetter

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from ..operators.identity import JerseyFusion
from ..operators.tracking import COLUMNS, TRACKED, TrackSet, track_rows

_ROW = [c for c in COLUMNS if c not in ("track_id", "confirmed")]
_FUSED = "track_id BIGINT, jersey_number STRING, probability DOUBLE, last_seen_frame BIGINT"


class _TrackObjects:
    """One partition is one video; whole frames are matched some thousand rows at a time."""

    BLOCK = 4096

    def __init__(self):
        self.state, self.frame, self.rows, self.at = TrackSet(), None, [], None

    def _flush(self):
        if self.rows:
            out = track_rows(self.state, pd.DataFrame(self.rows, columns=_ROW))
            yield from zip(*(out[c].tolist() for c in COLUMNS))
        self.rows = []

    def eval(self, row):
        if self.at is None:  # where the columns stand, looked up once
            places = {name: k for k, name in enumerate(row.__fields__)}
            self.at, self.place = itemgetter(*(places[c] for c in _ROW)), places["frame_idx"]
        frame = row[self.place]
        if frame != self.frame and len(self.rows) >= self.BLOCK:
            yield from self._flush()
        self.frame = frame
        self.rows.append(self.at(row))

    def terminate(self):
        yield from self._flush()


class _FuseJerseys:
    """One partition is one track; rows carry ``weight``, confidence × spatial weight. Readings are
    taken a block at a time."""

    def __init__(self):
        self.state, self.track, self.rows = JerseyFusion(), None, []

    def _flush(self):
        if self.rows:
            self.state.take(*zip(*self.rows))
        self.rows = []

    def eval(self, row):
        self.track = row["track_id"]
        if row["jersey_number"] is not None:
            self.rows.append((row["frame_idx"], row["jersey_number"], row["weight"]))
        if len(self.rows) >= JerseyFusion.BLOCK:
            self._flush()

    def terminate(self):
        self._flush()
        for number, (p, seen, _count) in self.state.live.items():
            yield self.track, number, p, seen


def register_functions(spark: SparkSession) -> None:
    """Make both callable from SQL, for example::

        SELECT * FROM track_objects(TABLE(SELECT … FROM detections)
            PARTITION BY video_id ORDER BY (frame_idx, det_idx))

    They run one row at a time and one partition per task; for large inputs use
    the DataFrame operators, which batch rows and cut long videos.
    """
    spark.udtf.register("track_objects", udtf(_TrackObjects, returnType=TRACKED))
    spark.udtf.register("fuse_jerseys", udtf(_FuseJerseys, returnType=_FUSED))
