"""Queries over tracks: history, motion, life cycle, appearance."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import tracks as trk
from ..operators.calibration import latest_homography, project_to_field
from ..operators.detections import filter_confidence
from ..operators.suppression import nms
from ..operators.tracking import track_objects
from .catalog import CANVAS, big, query, r6, sql_big, sql_r6, table, view
from .identity_queries import PLACED

T = view("tracks")
FOOT = f"(SELECT *, CAST(trunc((x1 + x2) / 2.0) AS BIGINT) AS foot_x, CAST(y2 AS BIGINT) AS foot_y FROM {T})"
AGED = f"""(SELECT *, row_number() OVER (PARTITION BY video_id, track_id ORDER BY frame_idx DESC, seq DESC) AS age,
count(*) OVER (PARTITION BY video_id, track_id) AS total FROM {FOOT})"""


@query(
    "track_history",
    f"SELECT video_id, track_id, least(total, 300) - age AS point_idx, foot_x, foot_y FROM {AGED} WHERE age <= 300",
)
def _(spark, sf):
    return trk.track_history(table(spark, sf, "tracks")).select(
        "video_id", "track_id", *big("point_idx", "foot_x", "foot_y")
    )


@query(
    "track_paths",
    f"""SELECT video_id, track_id, count(*) AS points, string_agg(foot_x || ',' || foot_y, ' ' ORDER BY age DESC) AS path
    FROM {AGED} WHERE age <= 50 GROUP BY 1, 2""",
)
def _(spark, sf):
    d = trk.track_paths(table(spark, sf, "tracks"), 50)
    text = F.transform("path", lambda p: F.concat(p["x"], F.lit(","), p["y"]))
    return d.select(
        "video_id", "track_id", F.size("path").cast("bigint").alias("points"),
        F.array_join(text, " ").alias("path"),
    )


@query(
    "trail_points",
    f"SELECT video_id, track_id, seq, round((least(total, 10) - age + 1) / least(10, total), 6) AS fade FROM {AGED} WHERE age <= 10",
)
def _(spark, sf):
    return trk.trail_points(table(spark, sf, "tracks")).select(
        "video_id", "track_id", "seq", *r6("fade")
    )


SEGMENTS = f"""(SELECT *, row_number() OVER (PARTITION BY video_id, track_id, segment ORDER BY frame_idx, seq) AS sightings FROM
(SELECT *, sum(fresh) OVER (PARTITION BY video_id, track_id ORDER BY frame_idx, seq ROWS UNBOUNDED PRECEDING) AS segment FROM
(SELECT *, CASE WHEN frame_idx - lag(frame_idx) OVER (PARTITION BY video_id, track_id ORDER BY frame_idx, seq) <= 10 THEN 0 ELSE 1 END AS fresh FROM {T})))"""


@query(
    "track_segments",
    f"SELECT video_id, track_id, seq, {sql_big('segment', 'sightings')}, sightings >= 5 AS confirmed FROM {SEGMENTS}",
)
def _(spark, sf):
    return trk.track_segments(table(spark, sf, "tracks")).select(
        "video_id", "track_id", "seq", *big("segment", "sightings"), "confirmed"
    )


@query(
    "segment_summary",
    f"""SELECT video_id, track_id, CAST(segment AS BIGINT) AS segment, min(frame_idx) AS first_frame, max(frame_idx) AS last_frame,
    count(*) AS sightings, count(*) >= 5 AS confirmed FROM {SEGMENTS} GROUP BY ALL""",
)
def _(spark, sf):
    return trk.segment_summary(trk.track_segments(table(spark, sf, "tracks"))).select(
        "video_id", "track_id", *big("segment"), "first_frame", "last_frame", "sightings",
        "confirmed",
    )


@query(
    "confirmed_tracks",
    f"""SELECT video_id, track_id, total AS sightings, class_name, confidence FROM {AGED} WHERE age = 1 AND total >= 5 AND class_name <> 'disc'""",
)
def _(spark, sf):
    return trk.confirmed_tracks(table(spark, sf, "tracks"))


def placed(spark, sf):
    return project_to_field(
        table(spark, sf, "tracks"), latest_homography(table(spark, sf, "registry")), *CANVAS
    )


MOVES = f"""(SELECT *, sqrt(dx * dx + dy * dy) AS move_length FROM (SELECT *,
CAST(field_x - lag(field_x) OVER w AS DOUBLE) AS dx, CAST(field_y - lag(field_y) OVER w AS DOUBLE) AS dy, frame_idx - lag(frame_idx) OVER w AS df
FROM {PLACED} WINDOW w AS (PARTITION BY video_id, track_id ORDER BY frame_idx, seq)))"""


@query(
    "direction_vectors",
    f"""SELECT video_id, track_id, seq, round(move_length, 6) AS move_length,
    CASE WHEN move_length > 5 THEN CAST(trunc(dx / move_length * 15) AS BIGINT) ELSE 0 END AS arrow_dx,
    CASE WHEN move_length > 5 THEN CAST(trunc(dy / move_length * 15) AS BIGINT) ELSE 0 END AS arrow_dy FROM {MOVES}""",
)
def _(spark, sf):
    return trk.direction_vectors(placed(spark, sf)).fillna(0, ["arrow_dx", "arrow_dy"]).select(
        "video_id", "track_id", "seq", *r6("move_length"), *big("arrow_dx", "arrow_dy")
    )


@query(
    "track_motion",
    f"""SELECT video_id, track_id, count(*) AS points, round(coalesce(sum(move_length), 0), 6) AS distance,
    round(coalesce(sum(df / 25.0::DOUBLE), 0), 6) AS seconds, round(max(CASE WHEN df > 0 THEN move_length / (df / 25.0::DOUBLE) END), 6) AS top_speed,
    round(sum(move_length) / nullif(sum(df / 25.0::DOUBLE), 0), 6) AS mean_speed FROM {MOVES} GROUP BY 1, 2""",
)
def _(spark, sf):
    return trk.track_motion(placed(spark, sf)).select(
        "video_id", "track_id", "points", *r6("distance", "seconds", "top_speed", "mean_speed")
    )


A = view("appearance")


@query(
    "appearance_pairs",
    f"""SELECT a.video_id, a.frame_idx, a.det_idx, b.det_idx AS next_det_idx,
    round(1 - list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))), 6) AS distance
    FROM (SELECT *, embedding::DOUBLE[] AS v FROM {A}) a JOIN (SELECT *, embedding::DOUBLE[] AS v FROM {A}) b
    ON a.video_id = b.video_id AND a.frame_idx + 1 = b.frame_idx
    WHERE 1 - list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) <= 0.8""",
)
def _(spark, sf):
    return trk.appearance_pairs(table(spark, sf, "appearance"), 0.8).select(
        "video_id", "frame_idx", "det_idx", "next_det_idx", *r6("distance")
    )


@query("track_objects")
def _(spark, sf):
    d = filter_confidence(table(spark, sf, "detections"))
    return track_objects(nms(d), segment_frames=150, overlap=30)
