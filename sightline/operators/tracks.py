"""Trajectories, motion and life cycle of tracks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..settings import DEFAULT_FPS, TRACK
from .detections import foot_point
from .ordered import Chunks, neighbour_rows, newest
from .suppression import mutual_best

KEYS = ("video_id", "track_id")
ORDER = ("frame_idx", "seq")


def track_history(df: DataFrame, n: int = TRACK.history_length) -> DataFrame:
    """The newest ``n`` foot points of each track, with ``point_idx`` 0 for the oldest held."""
    out = newest(foot_point(df), KEYS, ORDER, n)
    held = F.count("*").over(W.partitionBy(*KEYS))
    return out.withColumn("point_idx", held - F.col("age")).drop("age")


def track_paths(df: DataFrame, n: int = TRACK.history_length) -> DataFrame:
    """The same as one array of at most ``n`` points per track."""
    point = F.struct("point_idx", F.col("foot_x").alias("x"), F.col("foot_y").alias("y"))
    points = F.sort_array(F.collect_list(point))
    return track_history(df, n).groupBy(*KEYS).agg(
        F.transform(points, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("path")
    )


def trail_points(df: DataFrame, n: int = 10) -> DataFrame:
    """The newest ``n`` points with a fade weight rising to 1 at the newest."""
    held = F.count("*").over(W.partitionBy(*KEYS))
    return newest(foot_point(df), KEYS, ORDER, n).withColumn(
        "fade", (held - F.col("age") + 1) / F.least(F.lit(n), held)
    )


def track_segments(
    df: DataFrame, max_age: int = TRACK.max_age, n_init: int = TRACK.n_init
) -> DataFrame:
    """Number the unbroken stretches of each track.

    A gap above ``max_age`` frames starts a new ``segment``; ``sightings`` counts
    rows within it and a row is ``confirmed`` from the ``n_init``-th on.
    """
    c = Chunks(df, KEYS, ORDER)
    gap = F.col("frame_idx") - F.lag("frame_idx").over(c.inside)
    d = c.rows.withColumns(
        {"__rn": F.row_number().over(c.inside).cast("bigint"), "__new": (gap > max_age).cast("bigint")}
    )
    # Inside a chunk every break is known but the one at its first row.
    s = c.summary(
        d, F.count("*").alias("n"), F.min("frame_idx").alias("first"),
        F.max("frame_idx").alias("last"), F.coalesce(F.sum("__new"), F.lit(0)).alias("breaks"),
        F.max(F.when(F.col("__new") == 1, F.col("__rn"))).alias("break_rn"),
    )
    apart = F.col("first") - F.lag("last").over(c.across) > max_age
    s = s.withColumn("__opens", F.coalesce(apart, F.lit(True)).cast("bigint"))

    def total(column):
        return F.coalesce(F.sum(column).over(c.earlier), F.lit(0))

    s = s.withColumns(
        {"__rows": total(F.col("n")), "__breaks": total(F.col("breaks") + F.col("__opens"))}
    )
    start = F.coalesce(F.col("break_rn"), F.when(F.col("__opens") == 1, F.lit(1)))
    s = s.withColumn("__at", F.col("__rows") + start)
    s = s.withColumn("__carried", F.last("__at", ignorenulls=True).over(c.earlier))
    s = s.drop("n", "first", "last", "breaks", "break_rn", "__at")
    d = d.join(s, [*KEYS, "__chunk"], "left")
    upto = c.inside.rowsBetween(W.unboundedPreceding, 0)
    fresh = F.coalesce("__new", "__opens")
    at = F.col("__rows") + F.col("__rn")
    d = d.withColumns(
        {
            "segment": F.col("__breaks") + F.sum(fresh).over(upto),
            "__start": F.last(F.when(fresh == 1, at), ignorenulls=True).over(upto),
        }
    )
    sightings = at - F.coalesce("__start", "__carried") + 1
    return d.withColumns({"sightings": sightings, "confirmed": sightings >= n_init}).drop(
        "__chunk", "__rn", "__new", "__opens", "__rows", "__breaks", "__carried", "__start"
    )


def segment_summary(segments: DataFrame) -> DataFrame:
    """Life span of each segment, from the rows of ``track_segments``."""
    return segments.groupBy(*KEYS, "segment").agg(
        F.min("frame_idx").alias("first_frame"),
        F.max("frame_idx").alias("last_frame"),
        F.count("*").alias("sightings"),
        F.max("confirmed").alias("confirmed"),
    )


def confirmed_tracks(df: DataFrame, n_init: int = TRACK.n_init) -> DataFrame:
    """Tracks with ``n_init`` sightings that are not discs, with their newest class and score."""
    newest_row = F.max_by(
        F.struct("class_name", "confidence"), F.struct("frame_idx", "seq")
    )
    return (
        df.groupBy(*KEYS)
        .agg(F.count("*").alias("sightings"), newest_row.alias("__last"))
        .select(*KEYS, "sightings", "__last.class_name", "__last.confidence")
        .filter((F.col("sightings") >= n_init) & (F.lower("class_name") != "disc"))
    )


def direction_vectors(
    df: DataFrame, x: str = "field_x", y: str = "field_y", min_length: float = 5.0,
    arrow: float = 15.0,
) -> DataFrame:
    """Arrow from each projected foot along its move since the previous row of the track."""
    d = neighbour_rows(df, KEYS, ORDER, [x, y], "prev_")
    dx, dy = F.col(x) - F.col(f"prev_{x}"), F.col(y) - F.col(f"prev_{y}")
    length = F.sqrt(dx * dx + dy * dy)
    moved = length > min_length
    return d.withColumns(
        {
            "move_length": length,
            "arrow_dx": F.when(moved, (dx / length * F.lit(arrow)).cast("int")),
            "arrow_dy": F.when(moved, (dy / length * F.lit(arrow)).cast("int")),
        }
    )


def track_motion(
    df: DataFrame, x: str = "field_x", y: str = "field_y", units_per_px: float = 1.0,
    fps: Column | float = DEFAULT_FPS,
) -> DataFrame:
    """Distance, time and mean and top speed per track, from projected feet."""
    d = neighbour_rows(df, KEYS, ORDER, [x, y, "frame_idx"], "prev_")
    step = F.hypot(F.col(x) - F.col(f"prev_{x}"), F.col(y) - F.col(f"prev_{y}")) * F.lit(
        float(units_per_px)
    )
    rate = fps if isinstance(fps, Column) else F.lit(float(fps))
    seconds = (F.col("frame_idx") - F.col("prev_frame_idx")) / rate
    d = d.withColumns(
        {"__step": step, "__speed": F.when(seconds > 0, step / seconds), "__s": seconds}
    )
    return d.groupBy(*KEYS).agg(
        F.count("*").alias("points"),
        F.coalesce(F.sum("__step"), F.lit(0.0)).alias("distance"),
        F.coalesce(F.sum("__s"), F.lit(0.0)).alias("seconds"),
        F.max("__speed").alias("top_speed"),
        F.try_divide(F.sum("__step"), F.sum("__s")).alias("mean_speed"),
    )


def appearance_pairs(
    df: DataFrame, max_distance: float = TRACK.max_cosine_distance, keys=("video_id",),
    unit: bool = False,
) -> DataFrame:
    """Detections of frame t and t+1 that look alike: cosine distance up to ``max_distance``.

    ``embedding`` is compared only between neighbouring frames of a video. With
    ``unit`` the vectors are taken as already of length one.
    """
    keys = list(keys)

    def prepared():
        norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, v: s + v.cast("double") * v))
        vector = F.transform("embedding", lambda v: v.cast("double"))
        if not unit:
            vector = F.transform("embedding", lambda v: F.try_divide(v.cast("double"), F.col("__norm")))
            base = df.withColumn("__norm", norm)
        else:
            base = df
        return base.select(*keys, "frame_idx", "det_idx", vector.alias("v"))

    here = prepared().alias("a")
    after = prepared().withColumn("frame_idx", F.col("frame_idx") - 1).alias("b")
    dot = F.aggregate(
        F.zip_with("a.v", "b.v", lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p
    )
    join = F.lit(True)
    for k in (*keys, "frame_idx"):
        join = join & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    joined = here.join(after, join).select(
        *[F.col(f"a.{k}") for k in (*keys, "frame_idx")],
        F.col("a.det_idx").alias("det_idx"),
        F.col("b.det_idx").alias("next_det_idx"),
        (F.lit(1.0) - dot).alias("distance"),
    )
    return joined.filter(F.col("distance") <= max_distance)


def best_appearance(pairs: DataFrame, keys=("video_id",)) -> DataFrame:
    """Pairs whose ends are each other's nearest."""
    near = pairs.withColumn("similarity", F.lit(1.0) - F.col("distance"))
    return mutual_best(near, [*keys, "frame_idx"], "det_idx", "next_det_idx", "similarity")
