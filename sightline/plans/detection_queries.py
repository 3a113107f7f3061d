"""Queries over detections: projections, filters, unions, overlap."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.labels import format_elapsed
from ..operators import detections as det
from ..operators import suppression as sup
from ..settings import DETECTION
from ..sources.media import normalize_videos
from .catalog import FRAME, big, query, r6, raw, sql_big, sql_r6, table, view

D = view("detections")
ID = ["video_id", "frame_idx", "det_idx"]
BOX = ["x1", "y1", "x2", "y2"]
S_ID = ", ".join(ID)


@query(
    "normalize_videos",
    f"""SELECT video_id, CASE WHEN fps IS NULL OR fps < 1 OR fps > 120 THEN 25.0::DOUBLE ELSE fps END AS play_fps,
    round(CASE WHEN fps > 0 THEN frame_count / fps ELSE 0 END, 6) AS duration_seconds,
    CASE WHEN fps > 0 THEN lpad(CAST(CAST(floor(frame_count / fps / 60) AS BIGINT) AS VARCHAR),
      greatest(2, length(CAST(CAST(floor(frame_count / fps / 60) AS BIGINT) AS VARCHAR)))::INT, '0') || ':' ||
      lpad(CAST(CAST(floor(frame_count / fps) AS BIGINT) % 60 AS VARCHAR), 2, '0') ELSE 'Unknown' END AS duration
    FROM {view("videos")}""",
)
def _(spark, sf):
    return normalize_videos(table(spark, sf, "videos")).select(
        "video_id", "play_fps", *r6("duration_seconds"), "duration"
    )


@query(
    "filter_confidence",
    f"SELECT {S_ID}, model_type, confidence FROM {D} "
    "WHERE confidence >= CASE WHEN model_type = 'player_model' THEN 0.5 ELSE 0.3 END",
)
def _(spark, sf):
    return det.filter_confidence(table(spark, sf, "detections")).select(
        *ID, "model_type", "confidence"
    )


@query(
    "tag_detections",
    "SELECT l_orderkey, CAST(trunc(l_extendedprice / 7 - 900) AS INT) AS x1, CAST(trunc(l_quantity * 1.5) AS INT) AS y1, "
    "CAST(trunc(l_extendedprice / 7) AS INT) AS x2, CAST(trunc(l_quantity * 2.5 + 9.9) AS INT) AS y2, "
    "'disc' AS class_name, 'disc_model' AS model_type FROM lineitem",
)
def _(spark, sf):
    d = raw(spark, sf, "lineitem").select(
        "l_orderkey", (F.col("l_extendedprice") / 7 - 900).alias("x1"),
        (F.col("l_quantity") * 1.5).alias("y1"), (F.col("l_extendedprice") / 7).alias("x2"),
        (F.col("l_quantity") * 2.5 + 9.9).alias("y2"),
    )
    return det.tag_detections(d, "disc")


@query(
    "name_classes",
    f"SELECT {S_ID}, CASE class_id % 3 WHEN 0 THEN 'disc' WHEN 1 THEN 'player' ELSE 'unknown' END AS class_name, "
    "CASE class_id % 3 WHEN 1 THEN 'player_model' ELSE 'disc_model' END AS model_type "
    f"FROM (SELECT {S_ID}, class_id + x1 AS class_id FROM {D})",
)
def _(spark, sf):
    d = table(spark, sf, "detections").select(
        *ID, ((F.col("class_id") + F.col("x1")) % 3).alias("class_id")
    )
    return det.name_classes(d).drop("class_id")


@query(
    "to_tlwh",
    f"SELECT {S_ID}, CAST(x2 - x1 AS BIGINT) AS width, CAST(y2 - y1 AS BIGINT) AS height, "
    f"CAST((x2 - x1) * (y2 - y1) AS BIGINT) AS area, (x1 + x2) / 2.0::DOUBLE AS center_x, (y1 + y2) / 2.0::DOUBLE AS center_y FROM {D}",
)
def _(spark, sf):
    return det.to_tlwh(table(spark, sf, "detections")).select(
        *ID, *big("width", "height", "area"), "center_x", "center_y"
    )


def _raw_records(spark, sf):
    n = F.col("l_orderkey")
    coords = F.array(*[(F.col("l_partkey") + i).cast("string") for i in range(4)])
    bbox = (
        F.when(n % 10 == 0, F.lit(None)).when(n % 10 == 1, F.slice(coords, 1, 3))
        .when(n % 10 == 2, F.array(F.lit("a"), F.lit("1"), F.lit("2"), F.lit("3")))
        .otherwise(coords)
    )
    return raw(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", bbox.alias("bbox"),
        F.when(n % 10 == 3, "high").otherwise(F.col("l_discount").cast("string")).alias("confidence"),
        F.when(n % 10 == 4, "x").otherwise(F.col("l_linenumber").cast("string")).alias("class_id"),
    )


@query(
    "validate_detections_valid",
    "SELECT l_orderkey, l_linenumber, CAST(l_partkey AS DOUBLE) AS x1, CAST(l_partkey + 1 AS DOUBLE) AS y1, "
    "CAST(l_partkey + 2 AS DOUBLE) AS x2, CAST(l_partkey + 3 AS DOUBLE) AS y2, l_discount AS confidence, "
    "l_linenumber AS class_id FROM lineitem WHERE l_orderkey % 10 > 4",
)
def _(spark, sf):
    return det.validate_detections(_raw_records(spark, sf))[0]


@query(
    "validate_detections_quarantine",
    "SELECT l_orderkey, l_linenumber, CASE l_orderkey % 10 WHEN 0 THEN 'missing bbox' WHEN 1 THEN 'bbox length' "
    "ELSE 'not a number' END AS reason FROM lineitem WHERE l_orderkey % 10 <= 4",
)
def _(spark, sf):
    return det.validate_detections(_raw_records(spark, sf))[1].select(
        "l_orderkey", "l_linenumber", "reason"
    )


@query(
    "foot_point",
    "SELECT video_id, seq, CAST(trunc((x1 + x2) / 2.0) AS BIGINT) AS foot_x, CAST(y2 AS BIGINT) AS foot_y "
    f"FROM {view('tracks')}",
)
def _(spark, sf):
    return det.foot_point(table(spark, sf, "tracks")).select(
        "video_id", "seq", *big("foot_x", "foot_y")
    )


@query(
    "clamp_bbox",
    f"""SELECT {S_ID}, {sql_big("x1", "y1")}, CAST(greatest(x1 + 1, least(ox2, 1000)) AS BIGINT) AS x2,
    CAST(greatest(y1 + 1, least(oy2, 600)) AS BIGINT) AS y2 FROM (
    SELECT {S_ID}, greatest(0, least(x1, 999)) AS x1, greatest(0, least(y1, 599)) AS y1, x2 AS ox2, y2 AS oy2 FROM {D})""",
)
def _(spark, sf):
    return det.clamp_bbox(table(spark, sf, "detections"), 1000, 600).select(*ID, *big(*BOX))


@query(
    "player_only",
    f"SELECT {S_ID}, class_name FROM {D} WHERE class_name LIKE '%player%' OR class_name LIKE '%person%'",
)
def _(spark, sf):
    return det.player_only(table(spark, sf, "detections")).select(*ID, "class_name")


CROP = f"""(SELECT {S_ID}, greatest(0, x1) AS crop_x1, greatest(0, y1) AS crop_y1, least(1920, x2) AS crop_x2,
    least(1080, y1 + CAST(trunc((y2 - y1) * 0.45::DOUBLE) AS INT)) AS crop_y2 FROM {D})"""
CROP_COLUMNS = ("crop_x1", "crop_y1", "crop_x2", "crop_y2")


@query(
    "jersey_crop",
    f"SELECT {S_ID}, {sql_big(*CROP_COLUMNS)} FROM {CROP} WHERE crop_x2 > crop_x1 AND crop_y2 > crop_y1",
)
def _(spark, sf):
    return det.jersey_crop(table(spark, sf, "detections"), *FRAME).select(*ID, *big(*CROP_COLUMNS))


@query(
    "min_crop_filter",
    f"SELECT {S_ID}, CAST(crop_x2 - crop_x1 AS BIGINT) AS crop_width, CAST(crop_y2 - crop_y1 AS BIGINT) AS crop_height, "
    "CASE WHEN crop_x2 - crop_x1 < 40 OR crop_y2 - crop_y1 < 50 THEN 'crop_too_small' END AS skipped_reason "
    f"FROM {CROP} WHERE crop_x2 > crop_x1 AND crop_y2 > crop_y1",
)
def _(spark, sf):
    crops = det.jersey_crop(table(spark, sf, "detections"), *FRAME)
    return det.min_crop_filter(crops, 40, 50).select(
        *ID, *big("crop_width", "crop_height"), "skipped_reason"
    )


@query(
    "unletterbox_boxes",
    f"""SELECT {S_ID}, {sql_r6(*BOX)} FROM (SELECT {S_ID},
    greatest(0, least(x1 % 640 / s - 0, 1920)) AS x1, greatest(0, least(y1 % 640 / s - 420, 1080)) AS y1,
    greatest(0, least(x2 % 640 / s - 0, 1920)) AS x2, greatest(0, least(y2 % 640 / s - 420, 1080)) AS y2
    FROM (SELECT *, 640.0::DOUBLE / 1920 AS s FROM {D}))""",
)
def _(spark, sf):
    d = table(spark, sf, "detections").select(*ID, *[(F.col(c) % 640).alias(c) for c in BOX])
    return det.unletterbox_boxes(d, F.lit(FRAME[0]), F.lit(FRAME[1])).select(*ID, *r6(*BOX))


@query(
    "letterbox_boxes",
    f"""SELECT {S_ID}, {sql_r6(*BOX)} FROM (SELECT {S_ID}, x1 * s AS x1, (y1 + 420) * s AS y1,
    x2 * s AS x2, (y2 + 420) * s AS y2 FROM (SELECT *, 640.0::DOUBLE / 1920 AS s FROM {D}))""",
)
def _(spark, sf):
    d = table(spark, sf, "detections").select(*ID, *BOX)
    return det.letterbox_boxes(d, F.lit(FRAME[0]), F.lit(FRAME[1])).select(*ID, *r6(*BOX))


@query(
    "format_elapsed",
    """SELECT event_id, CASE WHEN s > 3600 THEN CAST(CAST(floor(s / 3600) AS BIGINT) AS VARCHAR) || 'h ' || CAST(CAST(floor((s % 3600) / 60) AS BIGINT) AS VARCHAR) || 'm'
    WHEN s > 60 THEN CAST(CAST(floor(s / 60) AS BIGINT) AS VARCHAR) || 'm ' || CAST(CAST(floor(s % 60) AS BIGINT) AS VARCHAR) || 's'
    ELSE CAST(CAST(floor(s) AS BIGINT) AS VARCHAR) || 's' END AS elapsed
    FROM (SELECT event_id, CAST(event_id * 7 % 9000 AS DOUBLE) / 2 AS s FROM events)""",
)
def _(spark, sf):
    seconds = (F.col("event_id") * 7 % 9000).cast("double") / 2
    return raw(spark, sf, "events").select("event_id", format_elapsed(seconds).alias("elapsed"))


@query("sample_frames", f"SELECT {S_ID} FROM {D} WHERE frame_idx % 5 = 0")
def _(spark, sf):
    return det.sample_frames(table(spark, sf, "detections"), 5).select(*ID)


@query(
    "union_detections",
    f"SELECT {S_ID}, model_type, CAST(CASE model_type WHEN 'player_model' THEN 0 ELSE 1 END AS BIGINT) AS source_order FROM {D}",
)
def _(spark, sf):
    d = table(spark, sf, "detections")
    both = det.union_detections(
        d.filter("model_type = 'player_model'"), d.filter("model_type = 'disc_model'")
    )
    return both.select(*ID, "model_type", *big("source_order"))




BOX_STRUCT = "{'x1': d.x1, 'y1': d.y1, 'x2': d.x2, 'y2': d.y2, 'id': d.det_idx}"
CLASH = """CAST(greatest(0, least(k.x2, d.x2) - greatest(k.x1, d.x1)) * greatest(0, least(k.y2, d.y2) - greatest(k.y1, d.y1)) AS DOUBLE)"""


def _nms_sql(kept: str) -> str:
    return f"""WITH RECURSIVE d AS (SELECT *, row_number() OVER (PARTITION BY video_id, frame_idx, model_type ORDER BY confidence DESC, det_idx) AS n FROM {D}),
    f AS (SELECT video_id, frame_idx, model_type, n, [{BOX_STRUCT}] AS kept FROM d WHERE n = 1
      UNION ALL SELECT d.video_id, d.frame_idx, d.model_type, d.n, CASE WHEN len(list_filter(f.kept, lambda k:
        {CLASH} > 0.45::DOUBLE * ((k.x2 - k.x1) * (k.y2 - k.y1) + (d.x2 - d.x1) * (d.y2 - d.y1) - {CLASH}))) > 0
        THEN f.kept ELSE list_append(f.kept, {BOX_STRUCT}) END
      FROM f JOIN d ON d.video_id = f.video_id AND d.frame_idx = f.frame_idx AND d.model_type = f.model_type AND d.n = f.n + 1),
    g AS (SELECT *, row_number() OVER (PARTITION BY video_id, frame_idx, model_type ORDER BY n DESC) AS last FROM f),
    k AS (SELECT video_id, frame_idx, model_type, unnest({kept}).id AS det_idx FROM g WHERE last = 1)
    SELECT {S_ID}, model_type, confidence, {sql_big(*BOX)} FROM {D} SEMI JOIN k USING (video_id, frame_idx, model_type, det_idx)"""


@query("nms_capped", _nms_sql("kept[1:CASE model_type WHEN 'player_model' THEN 50 ELSE 5 END]"))
def _(spark, sf):
    d = sup.nms(table(spark, sf, "detections"), max_det=DETECTION.max_det)
    return d.select(*ID, "model_type", "confidence", *big(*BOX))


@query("nms", _nms_sql("kept"))
def _(spark, sf):
    return sup.nms(table(spark, sf, "detections")).select(*ID, "model_type", "confidence", *big(*BOX))


IOU = """greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1))"""


@query(
    "iou_pairs",
    f"""WITH d AS MATERIALIZED (SELECT * FROM {D}), p AS (SELECT a.video_id, a.frame_idx, a.model_type, a.det_idx AS det_idx_a, b.det_idx AS det_idx_b,
    CAST({IOU} AS DOUBLE) AS i, (a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) AS s
    FROM d a JOIN d b ON a.video_id = b.video_id AND a.frame_idx = b.frame_idx AND a.model_type = b.model_type AND a.det_idx < b.det_idx)
    SELECT video_id, frame_idx, model_type, det_idx_a, det_idx_b, round(i / (s - i), 6) AS iou FROM p WHERE i > 0.45::DOUBLE * (s - i)""",
)
def _(spark, sf):
    pairs = sup.iou_pairs(table(spark, sf, "detections"), 0.45)
    return pairs.select("video_id", "frame_idx", "model_type", "det_idx_a", "det_idx_b", *r6("iou"))


@query(
    "link_candidates",
    f"""WITH d AS MATERIALIZED (SELECT * FROM {D}), p AS (SELECT a.video_id, a.model_type, a.frame_idx, a.det_idx, b.det_idx AS next_det_idx,
    CAST({IOU} AS DOUBLE) AS i, (a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) AS s
    FROM d a JOIN d b ON a.video_id = b.video_id AND a.frame_idx + 1 = b.frame_idx AND a.model_type = b.model_type),
    q AS (SELECT *, i / (s - i) AS iou FROM p WHERE i > 0.3::DOUBLE * (s - i)),
    r AS (SELECT *, row_number() OVER (PARTITION BY video_id, model_type, frame_idx, det_idx ORDER BY iou DESC, next_det_idx) AS f,
    row_number() OVER (PARTITION BY video_id, model_type, frame_idx, next_det_idx ORDER BY iou DESC, det_idx) AS g FROM q)
    SELECT video_id, model_type, frame_idx, det_idx, next_det_idx, round(iou, 6) AS iou FROM r WHERE f = 1 AND g = 1""",
)
def _(spark, sf):
    return sup.link_candidates(table(spark, sf, "detections")).select(
        "video_id", "model_type", "frame_idx", "det_idx", "next_det_idx", *r6("iou")
    )


@query(
    "detection_counts",
    "SELECT video_id, frame_idx, count(*) AS detections, count(*) FILTER (model_type = 'player_model') AS players, "
    f"count(*) FILTER (model_type = 'disc_model') AS discs FROM {D} GROUP BY 1, 2",
)
def _(spark, sf):
    return det.detection_counts(table(spark, sf, "detections"))


@query(
    "simple_track_ids",
    f"SELECT {S_ID}, frame_idx * 1000 + row_number() OVER (PARTITION BY video_id, frame_idx ORDER BY det_idx) - 1 AS track_id, "
    f"row_number() OVER (PARTITION BY video_id, frame_idx ORDER BY det_idx) > 1000 AS id_collides FROM {D}",
)
def _(spark, sf):
    return det.simple_track_ids(table(spark, sf, "detections")).select(
        *ID, "track_id", "id_collides"
    )
