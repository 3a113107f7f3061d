"""Streams against the batch operators they mirror."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from sightline.operators.identity import fuse_jerseys
from sightline.operators.tracking import TRACKED, track_objects
from sightline.plans import load_catalog
from sightline.plans.catalog import table
from sightline.streaming.frames import detection_stream, stage_windows, track_sessions
from sightline.streaming.identity import fuse_jerseys_stream
from sightline.streaming.ordered import InOrder
from sightline.streaming.tracking import track_stream

SF_DIR = "/root/testdata/sf0.001"
FAR = "2099-01-01 00:00:00"


def replay(spark, tmp_path, df, files, build, mode):
    """Feed ``df`` in ``files`` slices of time, then one far-off row, through ``build``."""
    source = str(tmp_path / "in")
    cut = df.withColumn("part", F.ntile(files).over(Window.orderBy("ts")))
    for n in range(1, files + 1):
        # Inside a slice rows come in any order.
        cut.filter(F.col("part") == n).drop("part").orderBy(F.rand(n)).coalesce(1).write.mode(
            "append").parquet(source)
    last = df.limit(1).withColumns({"ts": F.lit(FAR).cast("timestamp"), "video_id": F.lit(-1).cast("long")})
    last.coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(source)

    def write(batch, n):
        batch.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{tmp_path}/out/n={n}")

    q = (
        build(stream).writeStream.outputMode(mode).foreachBatch(write)
        .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return spark.read.parquet(f"{tmp_path}/out").filter("video_id >= 0")


def rows(df, columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=str)


@pytest.mark.parametrize("files", [1, 3])
def test_fusion_stream_equals_batch(spark, tmp_path, files):
    d = table(spark, SF_DIR, "measurements").withColumn("ts", F.timestamp_millis(10**9 + F.col("seq") * 400))
    stream = lambda s: fuse_jerseys_stream(s, "1 minute", idle_ms=10**12)
    out = replay(spark, tmp_path, d, files, stream, "update")
    newest = out.groupBy("video_id", "track_id").agg(F.max("batch").alias("batch"))
    final = out.join(newest, ["video_id", "track_id", "batch"])
    columns = ["video_id", "track_id", "jersey_number", F.round("probability", 9), "last_seen_frame"]
    assert rows(final, columns) == rows(fuse_jerseys(d), columns)


@pytest.mark.parametrize("files", [1, 3])
def test_tracking_stream_equals_batch(spark, tmp_path, files):
    d = table(spark, SF_DIR, "tracks").withColumns(
        {"det_idx": F.col("seq"), "ts": F.timestamp_millis(10**9 + F.col("frame_idx") * 40)}
    )
    d = d.select("video_id", "frame_idx", "det_idx", "ts", "x1", "y1", "x2", "y2", "class_name", "confidence")
    stream = lambda s: track_stream(s, "1 second", idle_ms=10**12)
    out = replay(spark, tmp_path, d, files, stream, "append")
    columns = [c.split()[0] for c in TRACKED.split(", ")]
    assert rows(out, columns) == rows(track_objects(d, segment_frames=10**6), columns)


def test_stream_queries_hand_on_every_row(spark):
    queries = load_catalog().QUERIES
    got = queries["stream_track_objects"](spark, SF_DIR)
    d = table(spark, SF_DIR, "tracks").withColumn("det_idx", F.col("seq"))
    columns = [c.split()[0] for c in TRACKED.split(", ")]
    assert rows(got, columns) == rows(track_objects(d, segment_frames=10**6), columns)
    out = queries["stream_fuse_jerseys"](spark, SF_DIR)
    columns = ["video_id", "track_id", "jersey_number", F.round("probability", 6), "last_seen_frame"]
    assert rows(out, columns) == rows(fuse_jerseys(table(spark, SF_DIR, "measurements")), columns)


def test_batch_windows_and_sessions(spark):
    t = table(spark, SF_DIR, "stage_timings").withColumn("ts", F.col("ts").cast("timestamp"))
    assert stage_windows(t, "1 day").agg(F.sum("samples")).first()[0] == t.count()
    d = spark.createDataFrame(
        [(1, 1, s) for s in (0, 100, 300, 900, 1000)], "video_id long, track_id long, ms long"
    ).withColumn("ts", F.timestamp_millis("ms"))
    got = track_sessions(d).orderBy("session_start").collect()
    assert [r["sightings"] for r in got] == [3, 2]


def test_stage_toggles(spark):
    d = table(spark, SF_DIR, "detections")
    assert "foot_x" not in detection_stream(d, ("threshold",)).columns
    assert "skipped_reason" in detection_stream(d).columns
    with pytest.raises(ValueError):
        detection_stream(d, ("blur",))


class _Timers:
    def __init__(self, now):
        self.now = now

    def getCurrentWatermarkInMs(self):
        return self.now


class _Value:
    def __init__(self):
        self.at = None

    def get(self):
        return self.at

    def update(self, value):
        self.at = value

    clear = lambda self: self.update(None)


class _Map(dict):
    getValue = dict.get

    def updateValue(self, key, value):
        self[key] = value

    removeKey = dict.pop


class _Handle:
    getValueState = lambda self, *_: _Value()
    getMapState = lambda self, *_: _Map()
    registerTimer = lambda self, ms: None


class _Kept(InOrder):
    columns = "ts TIMESTAMP, frame_idx BIGINT, det_idx BIGINT"
    order = ("frame_idx", "det_idx")
    piece = 50

    def advance(self, key, frames):
        yield from frames


@pytest.mark.parametrize("shuffled", [False, True])
def test_a_keys_rows_are_handed_on_in_small_frames(shuffled):
    """No frame holds all that a batch brings for a key, and rows after the watermark stay."""
    n = 20_000
    d = pd.DataFrame({"frame_idx": np.arange(n) // 3, "det_idx": np.arange(n) % 3})
    d.insert(0, "ts", pd.to_datetime(d["frame_idx"] * 40, unit="ms"))
    rows = d.sample(frac=1, random_state=1) if shuffled else d
    keeper = _Kept()
    keeper.init(_Handle())
    split = 200_000
    parts = iter([rows.iloc[i : i + 500] for i in range(0, n, 500)])
    early = list(keeper.handleInputRows((1,), parts, _Timers(split)))
    late = list(keeper.handleExpiredTimer((1,), _Timers(10**7), None))
    got = pd.concat(early + late, ignore_index=True)
    assert got[["frame_idx", "det_idx"]].values.tolist() == d[["frame_idx", "det_idx"]].values.tolist()
    assert max(map(len, early)) < n / 3 and sum(map(len, early)) == (d["frame_idx"] * 40 <= split).sum()
    whole = [f["frame_idx"].iloc[0] for f in early[1:]] > np.array([f["frame_idx"].iloc[-1] for f in early[:-1]])
    assert whole.all() and not keeper.pieces
