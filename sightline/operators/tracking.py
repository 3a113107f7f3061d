"""Multi-object tracking: greedy association of detections over frames."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..settings import TRACK, TrackDefaults
from .ordered import index_rows
from .support import cut_lineage, spread

TRACKED = (
    "video_id BIGINT, frame_idx BIGINT, det_idx BIGINT, track_id BIGINT, x1 DOUBLE, y1 DOUBLE, "
    "x2 DOUBLE, y2 DOUBLE, class_name STRING, confidence DOUBLE, confirmed BOOLEAN"
)
COLUMNS = [c.split()[0] for c in TRACKED.split(", ")]


def _iou_distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    wide = np.minimum(a[:, None, 2], b[None, :, 2]) - np.maximum(a[:, None, 0], b[None, :, 0])
    high = np.minimum(a[:, None, 3], b[None, :, 3]) - np.maximum(a[:, None, 1], b[None, :, 1])
    inter = np.maximum(wide, 0) * np.maximum(high, 0)
    size_a = (a[:, 2] - a[:, 0]) * (a[:, 3] - a[:, 1])
    size_b = (b[:, 2] - b[:, 0]) * (b[:, 3] - b[:, 1])
    union = size_a[:, None] + size_b[None, :] - inter
    return 1.0 - np.divide(inter, union, out=np.zeros_like(inter), where=union > 0)


def _differ(tracks: list[dict], classes: list) -> np.ndarray:
    codes: dict = {}
    of = lambda names: np.array([codes.setdefault(n, len(codes)) for n in names])
    return of(t["class_name"] for t in tracks)[:, None] != of(classes)[None, :]


def _greedy_pairs(cost: np.ndarray, limit: float) -> list[tuple[int, int]]:
    """Cheapest pairs first, each row and column once; ties to the lower row, then column."""
    rows, cols = np.nonzero(cost <= limit)
    used_r, used_c, out = set(), set(), []
    for i in np.lexsort((cols, rows, cost[rows, cols])):
        r, c = int(rows[i]), int(cols[i])
        if r not in used_r and c not in used_c:
            used_r.add(r)
            used_c.add(c)
            out.append((r, c))
    return out


class TrackSet:
    """Live tracks of one video: boxes, recent appearances, hits and age.

    A frame's detections are matched first to confirmed tracks by appearance
    (where they have one), then to all others by overlap. A track is confirmed
    after ``n_init`` hits, dropped at once if missed before that, and dropped
    after ``max_age`` frames unseen otherwise. Matching stays within a class.

    Tracks are kept in the order in which they were last seen, and ties in a match go to the
    first. So what comes next depends on nothing but the tracks' last boxes, looks and ages: two
    trackers that agree in these go on alike, whenever they began.
    """

    def __init__(self, settings: TrackDefaults = TRACK, age_by: str = "frame", tracks=None,
                 next_id: int = 1, last_frame: int | None = None):
        if age_by not in ("frame", "processed"):
            raise ValueError("age_by is 'frame' or 'processed'")
        self.settings, self.age_by = settings, age_by
        self.tracks: list[dict] = tracks or []
        self.next_id, self.last_frame = next_id, last_frame

    def step(self, frame: int, boxes: np.ndarray, classes: list, looks: list) -> list[dict]:
        """Take one frame; return the track of each detection, in order."""
        s = self.settings
        passed = 1
        if self.age_by == "frame" and self.last_frame is not None:
            passed = max(1, frame - self.last_frame)
        self.last_frame = frame
        for t in self.tracks:
            t["unseen"] += passed
        # In frame ageing, tracks that ran out between two frames are gone before matching.
        self.tracks = [
            t for t in self.tracks
            if t["unseen"] - 1 <= (s.max_age if t["hits"] >= s.n_init else 0)
        ]
        owner: list[dict | None] = [None] * len(boxes)
        seen = np.array([look is not None for look in looks], dtype=bool)
        confirmed = [t for t in self.tracks if t["hits"] >= s.n_init and t["looks"]]
        if confirmed and seen.any():
            at = np.flatnonzero(seen)
            new = np.stack([looks[i] for i in at])
            cost = np.stack([1.0 - (np.stack(t["looks"]) @ new.T).max(axis=0) for t in confirmed])
            cost[_differ(confirmed, [classes[i] for i in at])] = np.inf
            for r, c in _greedy_pairs(cost, s.max_cosine_distance):
                owner[int(at[c])] = confirmed[r]
        taken = {id(t) for t in owner if t is not None}
        rest = [t for t in self.tracks if id(t) not in taken]
        free = [i for i, t in enumerate(owner) if t is None]
        if rest and free:
            cost = _iou_distance(np.array([t["box"] for t in rest]), boxes[free])
            cost[_differ(rest, [classes[i] for i in free])] = np.inf
            for r, c in _greedy_pairs(cost, s.max_iou_distance):
                owner[free[c]] = rest[r]
        for i, t in enumerate(owner):
            if t is None:
                t = {"track_id": self.next_id, "hits": 0, "looks": [], "class_name": classes[i]}
                self.next_id += 1
                owner[i] = t
            t["box"], t["unseen"], t["hits"] = boxes[i].tolist(), 0, min(t["hits"] + 1, s.n_init)
            if looks[i] is not None:
                t["looks"] = (t["looks"] + [looks[i]])[-s.gallery_size:]
        # A new track missed once is dropped.
        self.tracks = [t for t in self.tracks if t["unseen"] and t["hits"] >= s.n_init] + owner
        return owner

    def dump(self) -> str:
        """All that later frames depend on: the last frame, and each live track in order."""
        fields = ("class_name", "box", "unseen", "hits")
        tracks = [[*(t[f] for f in fields), [v.tolist() for v in t["looks"]]] for t in self.tracks]
        return json.dumps([self.last_frame, tracks])

    def resume(self, dumped: str | None = None) -> None:
        """Go on from a dump, or from here, with the live tracks numbered 0, 1, 2 … in order."""
        if dumped is not None:
            self.last_frame, tracks = json.loads(dumped)
            names = ("class_name", "box", "unseen", "hits", "looks")
            self.tracks = [dict(zip(names, t)) | {"looks": [np.array(v) for v in t[4]]} for t in tracks]
        for k, t in enumerate(self.tracks):
            t["track_id"] = k
        self.next_id = len(self.tracks)


def _unit(v) -> np.ndarray | None:
    if v is None:
        return None
    v = np.asarray(v, dtype=float)
    norm = float(np.linalg.norm(v))
    return v / norm if norm > 0 else None


def track_rows(state: TrackSet, rows: pd.DataFrame) -> pd.DataFrame:
    """Whole frames, sorted by (frame, detection), through ``state``."""
    frames = rows["frame_idx"].to_numpy(np.int64)
    boxes = rows[["x1", "y1", "x2", "y2"]].to_numpy(dtype=float)
    classes = rows["class_name"].tolist()
    if "embedding" in rows.columns:
        looks = [_unit(v) for v in rows["embedding"]]
    else:
        looks = [None] * len(rows)
    ids, confirmed = np.empty(len(rows), np.int64), np.empty(len(rows), bool)
    cuts = [0, *(np.flatnonzero(np.diff(frames)) + 1).tolist(), len(rows)]
    for lo, hi in zip(cuts, cuts[1:]):
        if lo == hi:
            continue
        owners = state.step(int(frames[lo]), boxes[lo:hi], classes[lo:hi], looks[lo:hi])
        ids[lo:hi] = [t["track_id"] for t in owners]
        confirmed[lo:hi] = [t["hits"] >= state.settings.n_init for t in owners]
    out = rows.drop(columns="embedding", errors="ignore").assign(track_id=ids, confirmed=confirmed)
    return out.astype({c: float for c in ("x1", "y1", "x2", "y2", "confidence")})


def whole_frames(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Batches sorted by frame, cut again so that no frame spans two of them."""
    held: pd.DataFrame | None = None
    for pdf in batches:
        if held is not None:
            pdf = pd.concat([held, pdf], ignore_index=True)
        if pdf.empty:
            continue
        last = pdf["frame_idx"].to_numpy() == pdf["frame_idx"].iloc[-1]
        if not last.all():
            yield pdf[~last].reset_index(drop=True)
        held = pdf[last].reset_index(drop=True)
    if held is not None and len(held):
        yield held


SEGMENTED = TRACKED + ", segment BIGINT, start STRING, end STRING, ends ARRAY<BIGINT>"
_EMPTY = TrackSet().dump()
_FIRST = -(1 << 62)  # the frame of a row that only carries the state a segment starts from


def track_objects(
    detections: DataFrame, settings: TrackDefaults = TRACK, segment_frames: int = 3000,
    overlap: int = 60, age_by: str = "frame",
) -> DataFrame:
    """Follow objects through each video; returns one row per detection with its ``track_id``.

    The result is that of one pass over each video, with tracks numbered from 1 as they begin.
    To spread a long video over tasks it is cut into segments of ``segment_frames``, and all are
    run at once, each from a guess: the state after the ``overlap`` frames before it. Then the
    guess is compared with the state in which the segment before ended. Where they differ the
    segment is run again from that state, until every segment started as the one before it ended.
    Both numbers change the work only. Within a segment frames stream in order and only the live
    tracks are held.

    An empty table gives no rows; a video may start at any frame and have gaps.
    """
    if overlap >= segment_frames:
        raise ValueError("overlap must be shorter than a segment")
    keep = ["video_id", "frame_idx", "det_idx", "x1", "y1", "x2", "y2", "class_name", "confidence"]
    looks = ["embedding"] if "embedding" in detections.columns else []
    core = F.floor(F.col("frame_idx") / F.lit(segment_frames)).cast("bigint")
    early = F.pmod(F.col("frame_idx"), F.lit(segment_frames)) >= F.lit(segment_frames - overlap)
    both = F.when(early, F.array("core", F.col("core") + 1)).otherwise(F.array("core"))
    d = detections.select(*keep, *looks, core.alias("core"), F.lit(None).cast("string").alias("start"))
    first = d.withColumn("segment", F.explode(both))

    runs = [_run_segments(first, settings, age_by, looks)]
    state = _states(runs[0], 0)
    while True:
        state = cut_lineage(state)
        before = W.partitionBy("video_id").orderBy("segment")
        begin = F.coalesce(F.lag("end").over(before), F.lit(_EMPTY))
        again = state.select("video_id", "segment", "start", begin.alias("begin"))
        again = cut_lineage(again.where("start <> begin").drop("start"))
        if again.isEmpty():
            break
        own = runs[0].where("end IS NULL").withColumns({"core": F.col("segment"), "start": F.lit(None).cast("string")})
        rows = own.select(*keep, *looks, "core", "start", "segment").join(again.drop("begin"), ["video_id", "segment"], "left_semi")
        starts = again.select(
            "video_id", F.lit(_FIRST).alias("frame_idx"), F.col("segment").alias("core"), "segment", F.col("begin").alias("start")
        )
        runs.append(_run_segments(rows.unionByName(starts, allowMissingColumns=True), settings, age_by, looks))
        kept = state.join(again, ["video_id", "segment"], "left_anti")
        state = kept.unionByName(_states(runs[-1], len(runs) - 1))

    ids = _track_ids(state, runs)
    out = None
    for k, rows in enumerate(runs):
        last = state.where(F.col("run") == k).select("video_id", "segment")
        rows = rows.where("end IS NULL").withColumnRenamed("track_id", "local").select(*[c for c in COLUMNS if c != "track_id"], "segment", "local")
        rows = rows if len(runs) == 1 else rows.join(last, ["video_id", "segment"], "left_semi")
        out = rows if out is None else out.unionByName(rows)
    return out.join(ids, ["video_id", "segment", "local"]).select(*COLUMNS)


def _run_segments(rows: DataFrame, settings: TrackDefaults, age_by: str, looks: list[str]) -> DataFrame:
    """Tracked rows of each segment with numbers of its own, and a row with the states at its ends.

    A track that the segment starts with has its place in that state as number. ``ends`` are the
    numbers of the tracks that it ends with, in order.
    """
    names = [*COLUMNS, "segment", "start", "end", "ends", *looks]

    def run(key: tuple, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, start = TrackSet(settings, age_by, next_id=0), None
        for rows in whole_frames(batches):
            if start is None and rows["frame_idx"].iloc[0] == _FIRST:
                start = rows["start"].iloc[0]
                state.resume(start)
                rows = rows.iloc[1:]
            warm = (rows["segment"] != rows["core"]).to_numpy()
            if warm.any():
                track_rows(state, rows[warm].drop(columns=["core", "start"]))
                rows = rows[~warm]
            if not len(rows):
                continue
            if start is None:
                state.resume()
                start = state.dump()
            rows = rows.reset_index(drop=True)
            out = track_rows(state, rows).assign(start=None, end=None, ends=None)
            yield (out.assign(embedding=rows["embedding"]) if looks else out)[names]
        if start is not None:
            last = {"video_id": key[0], "segment": key[1], "start": start, "end": state.dump()}
            ends = [t["track_id"] for t in state.tracks]
            yield pd.DataFrame([dict.fromkeys(names) | last | {"ends": ends}], columns=names, dtype=object)

    kinds = "".join(f", {c} ARRAY<DOUBLE>" for c in looks)
    rows = rows.withColumns({c: F.col(c).cast("array<double>") for c in looks})
    ordered = spread(rows, "video_id", "segment").sortWithinPartitions(
        "video_id", "segment", "frame_idx", "det_idx"
    )
    return cut_lineage(ordered.groupBy("video_id", "segment").applyInPandas(run, SEGMENTED + kinds))


def _states(rows: DataFrame, run: int) -> DataFrame:
    found = rows.where("end IS NOT NULL")
    return found.select("video_id", "segment", "start", "end", "ends", F.lit(run).alias("run"))


def _track_ids(state: DataFrame, runs: list[DataFrame]) -> DataFrame:
    """(video_id, segment, local) → track_id: a track keeps the number it got where it began.

    A track that a segment starts with is the one at the same place in the state that the segment
    before ended with. Each pass doubles how far back a link reaches, so n segments take log2 n.
    """
    before = W.partitionBy("video_id").orderBy("segment")
    links = state.select(
        "video_id", "segment", F.lag("ends").over(before).alias("ends"), F.lag("segment").over(before).alias("to_segment"),
    ).select("video_id", "segment", "to_segment", F.posexplode("ends").alias("local", "to_local"))
    links = cut_lineage(links.withColumn("local", F.col("local").cast("long")))
    while True:
        onward = links.select(
            "video_id", F.col("segment").alias("to_segment"), F.col("local").alias("to_local"),
            F.col("to_segment").alias("far_segment"), F.col("to_local").alias("far_local"),
        )
        moved = cut_lineage(links.join(onward, ["video_id", "to_segment", "to_local"], "left"))
        done = moved.where("far_segment IS NOT NULL").isEmpty()
        links = moved.select(
            "video_id", "segment", "local", F.coalesce("far_segment", "to_segment").alias("to_segment"),
            F.coalesce("far_local", "to_local").alias("to_local"),
        )
        if done:
            break
    seen = None
    for k, rows in enumerate(runs):
        some = rows.where("end IS NULL").select("video_id", "segment", F.col("track_id").alias("local"))
        if len(runs) > 1:
            some = some.join(state.where(F.col("run") == k).select("video_id", "segment"), ["video_id", "segment"], "left_semi")
        seen = some if seen is None else seen.union(some)
    seen = seen.distinct().join(links, ["video_id", "segment", "local"], "left")
    seen = cut_lineage(seen.select(
        "video_id", "segment", "local", F.coalesce("to_segment", "segment").alias("root_segment"),
        F.coalesce("to_local", "local").alias("root_local"),
    ))
    roots = seen.select("video_id", "root_segment", "root_local").distinct()
    roots = index_rows(roots, ["video_id"], ["root_segment", "root_local"], "track_id", chunk=F.col("root_segment"))
    return seen.join(roots, ["video_id", "root_segment", "root_local"]).select(
        "video_id", "segment", "local", (F.col("track_id") + 1).alias("track_id")
    )
