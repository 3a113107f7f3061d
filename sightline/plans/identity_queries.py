"""Queries over OCR readings and jersey numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.labels import clean_jersey, jersey_band, spatial_weight, track_label
from ..operators import identity as ident
from ..sources.records import parse_ocr
from . import fixtures as fx
from .catalog import CANVAS, big, query, r6, raw, sql_big, sql_project, sql_r6, table, view
from .positions import who_is_where

M = view("measurements")
T = view("ocr_texts")
TRACK = ["video_id", "track_id"]
CROP_ID = ["video_id", "frame_idx", "track_id", "crop_id"]
S_CROP = ", ".join(CROP_ID)

SPATIAL = """CASE WHEN abs(center_x - 0.5::DOUBLE) <= 0.2::DOUBLE THEN 1 + 0.3::DOUBLE * (1 - abs(center_x - 0.5::DOUBLE) / 0.2::DOUBLE)
ELSE greatest(0.5::DOUBLE, 1 - (abs(center_x - 0.5::DOUBLE) - 0.2::DOUBLE) / 0.3::DOUBLE * 0.5::DOUBLE) END"""

RECENT = f"""(SELECT *, 0.5::DOUBLE + 0.5::DOUBLE * (held - age) / greatest(1, held - 1) AS age_weight FROM
(SELECT *, count(*) OVER (PARTITION BY video_id, track_id) AS held FROM
(SELECT *, row_number() OVER (PARTITION BY video_id, track_id ORDER BY frame_idx DESC, seq DESC) AS age FROM {M}) WHERE age <= 30))"""

SCORES = f"""(SELECT video_id, track_id, jersey_number, score, measurement_count,
round(score / sum(score) OVER (PARTITION BY video_id, track_id), 12) AS probability FROM
(SELECT video_id, track_id, jersey_number, sum(confidence * ({SPATIAL}) * age_weight) AS score, count(*) AS measurement_count
FROM {RECENT} GROUP BY 1, 2, 3))"""

TABLE = f"""(SELECT video_id, track_id, max(CASE WHEN rank = 1 THEN jersey_number END) AS best_jersey,
max(CASE WHEN rank = 1 THEN probability END) AS best_probability,
max(CASE WHEN rank = 2 THEN jersey_number END) AS second_jersey,
max(CASE WHEN rank = 2 THEN probability END) AS second_probability FROM
(SELECT *, row_number() OVER (PARTITION BY video_id, track_id ORDER BY probability DESC, jersey_number) AS rank FROM {SCORES})
WHERE rank <= 2 GROUP BY 1, 2)"""

REGISTRY_NEWEST = f"""(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY created_at DESC, frame_index DESC,
h00 DESC, h01 DESC, h02 DESC, h10 DESC, h11 DESC, h12 DESC, h20 DESC, h21 DESC) AS n FROM {view('registry')}) WHERE n = 1)"""

PLACED = f"""(SELECT * FROM (SELECT *, CAST(trunc(p_x) AS INT) AS field_x, CAST(trunc(p_y) AS INT) AS field_y FROM
(SELECT t.*, {sql_project("((t.x1 + t.x2) / 2.0::DOUBLE)", "t.y2")} FROM {view('tracks')} t JOIN {REGISTRY_NEWEST} h USING (video_id)))
WHERE field_x >= 0 AND field_x < {CANVAS[0]} AND field_y >= 0 AND field_y < {CANVAS[1]})"""


@query(
    "who_is_where",
    f"""SELECT video_id, frame_idx, seq, track_id, {sql_big("field_x", "field_y")},
    coalesce(best_jersey, 'Unknown') AS jersey_number,
    CASE WHEN best_jersey IS NULL THEN CAST(track_id AS VARCHAR) || ':?' ELSE '#' || best_jersey END AS label
    FROM {PLACED} LEFT JOIN {TABLE} USING (video_id, track_id) WHERE class_name <> 'disc'""",
)
def _(spark, sf):
    out = who_is_where(
        table(spark, sf, "tracks"), table(spark, sf, "measurements"),
        table(spark, sf, "registry"), *CANVAS,
    )
    return out.select(
        "video_id", "frame_idx", "seq", "track_id", *big("field_x", "field_y"),
        "jersey_number", "label",
    )


@query(
    "parse_ocr",
    "SELECT event_id, n, text, conf, CAST(n AS DOUBLE) AS first_x, CAST(n + 9 AS DOUBLE) AS third_x, CAST(n + 4 AS DOUBLE) AS third_y "
    "FROM (SELECT event_id, event_id % 50 AS n, CAST(event_id % 100 AS VARCHAR) AS text, CAST(event_id % 8 AS DOUBLE) / 8 AS conf FROM events)",
)
def _(spark, sf):
    n = F.col("event_id") % 50
    poly = F.format_string("[[%d,1],[%d,1],[%d,%d],[%d,5]]", n, n + 9, n + 9, n + 4, n)
    flat = F.format_string("[%d,1,%d,%d]", n, n + 9, n + 4)
    bbox = F.when(F.col("event_id") % 2 == 0, poly).otherwise(flat)
    text = F.format_string(
        '[{"bbox": %s, "text": "%d", "conf": %s}]', bbox, F.col("event_id") % 100,
        ((F.col("event_id") % 8).cast("double") / 8).cast("string"),
    )
    d = parse_ocr(raw(spark, sf, "events").select("event_id", n.alias("n"), text.alias("results")))
    r = F.col("results")[0]
    return d.select(
        "event_id", "n", r["text"].alias("text"), r["conf"].alias("conf"),
        r["poly"][0]["x"].alias("first_x"), r["poly"][2]["x"].alias("third_x"),
        r["poly"][2]["y"].alias("third_y"),
    )


@query(
    "filter_ocr",
    f"SELECT {S_CROP}, text, conf FROM {T} WHERE conf >= 0.5",
)
def _(spark, sf):
    d = ident.filter_ocr(fx.ocr_crops(spark, sf))
    return d.select(*CROP_ID, F.inline("results")).select(*CROP_ID, "text", "conf")


@query(
    "clean_jersey",
    f"""SELECT {S_CROP}, text, CASE WHEN TRY_CAST(digits AS BIGINT) BETWEEN 0 AND 99 THEN digits END AS jersey_number
    FROM (SELECT *, regexp_replace(text, '[^0-9]', '', 'g') AS digits FROM {T})""",
)
def _(spark, sf):
    d = fx.ocr_crops(spark, sf).select(*CROP_ID, F.inline("results"))
    return ident.with_clean_jersey(d).select(*CROP_ID, "text", "jersey_number")


@query(
    "ocr_center_x",
    f"""SELECT {S_CROP}, round(coalesce(greatest(0, least(1, avg(CASE WHEN conf >= 0.5 THEN (left_x + right_x) / 2 / crop_width END))), 0.5), 6) AS center_x
    FROM {T} GROUP BY ALL""",
)
def _(spark, sf):
    d = ident.ocr_center_x(ident.filter_ocr(fx.ocr_crops(spark, sf)))
    return d.select(*CROP_ID, *r6("center_x"))


@query(
    "ocr_box_to_frame",
    f"""WITH b AS (SELECT {S_CROP}, pos, 100 AS x1, 50 AS y1, 100 + crop_width AS x2, 150 AS y2, 45 AS jh,
      100 + CAST(trunc(CAST(trunc(left_x) AS INT) * (crop_width / (2.0::DOUBLE * crop_width)) * (crop_width / CAST(crop_width AS DOUBLE))) AS INT) AS l,
      100 + CAST(trunc(CAST(trunc(right_x) AS INT) * (crop_width / (2.0::DOUBLE * crop_width)) * (crop_width / CAST(crop_width AS DOUBLE))) AS INT) AS r,
      50 + CAST(trunc(CAST(trunc(top_y) AS INT) * 0.5::DOUBLE * (45 / 40.0::DOUBLE)) AS INT) AS t,
      50 + CAST(trunc(CAST(trunc(bottom_y) AS INT) * 0.5::DOUBLE * (45 / 40.0::DOUBLE)) AS INT) AS o FROM {T}),
    c AS (SELECT {S_CROP}, pos, x1, y1, x2, y2, jh, l, t, greatest(r, l + 3) AS r, greatest(o, t + 3) AS o FROM b),
    d AS (SELECT {S_CROP}, pos, x2, y1, jh, r, o, greatest(x1, least(l, x2 - 3)) AS text_x1, greatest(y1, least(t, y1 + jh - 3)) AS text_y1 FROM c)
    SELECT {S_CROP}, CAST(pos AS BIGINT) AS pos, {sql_big("text_x1", "text_y1")},
    CAST(greatest(text_x1 + 3, least(r, x2)) AS BIGINT) AS text_x2, CAST(greatest(text_y1 + 3, least(o, y1 + jh)) AS BIGINT) AS text_y2 FROM d""",
)
def _(spark, sf):
    d = fx.ocr_crops(spark, sf).select(
        *CROP_ID, "crop_width", F.posexplode("results").alias("pos", "r")
    )
    d = d.select(
        *CROP_ID, "pos", F.col("r.poly").alias("poly"),
        F.lit(100).alias("x1"), F.lit(50).alias("y1"), (100 + F.col("crop_width")).alias("x2"),
        F.lit(150).alias("y2"), "crop_width", F.lit(40).alias("crop_height"),
        (F.col("crop_width") * 2).alias("final_width"), F.lit(80).alias("final_height"),
    )
    out = ident.ocr_box_to_frame(d)
    return out.select(*CROP_ID, *big("pos", "text_x1", "text_y1", "text_x2", "text_y2"))


BEST = f"""(SELECT {S_CROP}, CASE WHEN TRY_CAST(digits AS BIGINT) BETWEEN 0 AND 99 THEN digits END AS jersey_number,
CASE WHEN TRY_CAST(digits AS BIGINT) BETWEEN 0 AND 99 THEN conf ELSE 0.0 END AS confidence FROM
(SELECT *, row_number() OVER (PARTITION BY {S_CROP} ORDER BY ok DESC, conf DESC, pos) AS n FROM
(SELECT *, conf >= 0.5 AND digits <> '' AS ok FROM (SELECT *, regexp_replace(text, '[^0-9]', '', 'g') AS digits FROM {T})))
WHERE n = 1 AND ok)"""


@query(
    "best_ocr",
    f"SELECT {S_CROP}, b.jersey_number, coalesce(b.confidence, 0) AS confidence FROM (SELECT DISTINCT {S_CROP} FROM {T}) LEFT JOIN {BEST} b USING ({S_CROP})",
)
def _(spark, sf):
    return ident.best_ocr(fx.ocr_crops(spark, sf)).select(*CROP_ID, "jersey_number", "confidence")


@query(
    "jersey_band",
    f"""SELECT {S_CROP}, conf, CASE WHEN conf >= 0.7 THEN 'high' WHEN conf >= 0.4 THEN 'medium' ELSE 'low' END AS band FROM {T}""",
)
def _(spark, sf):
    d = fx.ocr_crops(spark, sf).select(*CROP_ID, F.inline("results"))
    return d.select(*CROP_ID, "conf", jersey_band(F.col("conf")).alias("band"))


@query(
    "track_label",
    f"""SELECT {S_CROP}, pos, CASE WHEN j IS NULL OR j = 'Unknown' THEN CAST(track_id AS VARCHAR) || ':?' ELSE '#' || j END AS label FROM
    (SELECT {S_CROP}, pos, CASE WHEN crop_id % 4 = 0 THEN 'Unknown' WHEN TRY_CAST(text AS BIGINT) BETWEEN 0 AND 99 THEN text END AS j
    FROM {T})""",
)
def _(spark, sf):
    d = fx.ocr_crops(spark, sf).select(*CROP_ID, F.posexplode("results").alias("pos", "result"))
    text = F.col("result.text")
    known = F.when(text.try_cast("bigint").isNotNull(), clean_jersey(text))
    jersey = F.when(F.col("crop_id") % 4 == 0, "Unknown").otherwise(known)
    return d.select(*CROP_ID, "pos", track_label(F.col("track_id"), jersey).alias("label"))


@query(
    "attach_player_ids",
    f"""SELECT video_id, seq, track_id, coalesce(best_jersey, 'Unknown') AS jersey_number,
    CASE WHEN best_jersey IS NULL THEN CAST(track_id AS VARCHAR) || ':?' ELSE '#' || best_jersey END AS label
    FROM {view('tracks')} LEFT JOIN (SELECT * FROM {TABLE} WHERE best_probability > 0.1) USING (video_id, track_id)""",
)
def _(spark, sf):
    ids = ident.jersey_table(ident.jersey_scores(table(spark, sf, "measurements")))
    ids = ids.filter("best_probability > 0.1").withColumnRenamed("best_jersey", "jersey_number")
    return ident.attach_player_ids(table(spark, sf, "tracks"), ids).select(
        "video_id", "seq", "track_id", "jersey_number", "label"
    )


@query(
    "attach_ocr",
    f"""SELECT t.video_id, t.frame_idx, t.track_id, t.seq, b.jersey_number FROM {view('tracks')} t
    LEFT JOIN {BEST} b ON t.video_id = b.video_id AND t.frame_idx = b.frame_idx AND t.track_id = b.track_id AND b.jersey_number IS NOT NULL""",
)
def _(spark, sf):
    best = ident.best_ocr(fx.ocr_crops(spark, sf)).filter("jersey_number IS NOT NULL")
    readings = best.select("video_id", "frame_idx", "track_id", "jersey_number")
    return ident.attach_ocr(table(spark, sf, "tracks"), readings).select(
        "video_id", "frame_idx", "track_id", "seq", "jersey_number"
    )


@query("spatial_weight", f"SELECT seq, round({SPATIAL}, 6) AS weight FROM {M}")
def _(spark, sf):
    d = table(spark, sf, "measurements")
    return d.select("seq", F.round(spatial_weight(F.col("center_x")), 6).alias("weight"))


@query(
    "recent_measurements",
    f"SELECT {', '.join(TRACK)}, seq, CAST(age AS BIGINT) AS age, round(age_weight, 6) AS age_weight FROM {RECENT}",
)
def _(spark, sf):
    d = ident.recent_measurements(table(spark, sf, "measurements"))
    return d.select(*TRACK, "seq", *big("age"), *r6("age_weight"))


@query(
    "jersey_scores",
    f"SELECT {', '.join(TRACK)}, jersey_number, {sql_r6('score', 'probability')}, measurement_count FROM {SCORES}",
)
def _(spark, sf):
    return ident.jersey_scores(table(spark, sf, "measurements")).select(
        *TRACK, "jersey_number", *r6("score", "probability"), "measurement_count"
    )


@query(
    "top_jerseys",
    f"""SELECT video_id, track_id, jersey_number, rank, round(probability, 6) AS probability FROM
    (SELECT *, row_number() OVER (PARTITION BY video_id, track_id ORDER BY probability DESC, jersey_number) AS rank FROM {SCORES}) WHERE rank <= 3""",
)
def _(spark, sf):
    top = ident.top_jerseys(ident.jersey_scores(table(spark, sf, "measurements")))
    return top.select(*TRACK, "jersey_number", *big("rank"), *r6("probability"))


@query(
    "jersey_table",
    f"""SELECT video_id, track_id, best_jersey, round(best_probability, 6) AS best_probability,
    CASE WHEN best_probability >= 0.7 THEN 'high' WHEN best_probability >= 0.4 THEN 'medium' ELSE 'low' END AS band,
    CASE WHEN second_probability > 0.1 THEN second_jersey END AS second_jersey,
    CASE WHEN second_probability > 0.1 THEN round(second_probability, 6) END AS second_probability FROM {TABLE} ORDER BY track_id""",
)
def _(spark, sf):
    out = ident.jersey_table(ident.jersey_scores(table(spark, sf, "measurements")))
    return out.select(
        *TRACK, "best_jersey", *r6("best_probability"), "band", "second_jersey",
        *r6("second_probability"),
    ).orderBy("track_id")


@query(
    "primary_jersey",
    f"""SELECT m.video_id, m.track_id, m.seq, CASE WHEN t.best_probability > 0.08 THEN t.best_jersey ELSE m.jersey_number END AS primary_jersey
    FROM {M} m LEFT JOIN {TABLE} t USING (video_id, track_id)""",
)
def _(spark, sf):
    m = table(spark, sf, "measurements")
    best = ident.jersey_table(ident.jersey_scores(m)).select(
        *TRACK, F.col("best_jersey").alias("tracked_jersey"),
        F.col("best_probability").alias("tracked_probability"),
    )
    d = m.withColumnRenamed("jersey_number", "frame_jersey").join(best, TRACK, "left")
    return ident.primary_jersey(d, 0.08).select(*TRACK, "seq", "primary_jersey")


@query(
    "jersey_stats",
    f"""SELECT CAST(count(*) AS BIGINT) AS total_tracks, CAST(sum(held) AS BIGINT) AS total_measurements, CAST(sum(n) AS BIGINT) AS total_probabilities,
    round(sum(held) / greatest(1, count(*)), 6) AS avg_measurements_per_track, round(sum(n) / greatest(1, count(*)), 6) AS avg_probabilities_per_track
    FROM (SELECT video_id, track_id, least(count(*), 30) AS held FROM {M} GROUP BY 1, 2)
    JOIN (SELECT video_id, track_id, count(*) AS n FROM {SCORES} GROUP BY 1, 2) USING (video_id, track_id)""",
)
def _(spark, sf):
    m = table(spark, sf, "measurements")
    return ident.jersey_stats(m, ident.jersey_scores(m)).select(
        *big("total_tracks", "total_measurements", "total_probabilities"),
        *r6("avg_measurements_per_track", "avg_probabilities_per_track"),
    )


# The fold as a recursion over a track's readings; ``state`` lists the live numbers.
FUSED = f"""WITH RECURSIVE m AS (SELECT video_id, track_id, frame_idx, jersey_number, confidence * ({SPATIAL}) AS w,
  row_number() OVER (PARTITION BY video_id, track_id ORDER BY frame_idx, seq) AS i FROM {M}),
s AS (SELECT a.video_id, a.track_id, a.i, a.frame_idx, b.jersey_number AS num, count(*) AS cnt,
  sum(b.w * (0.5::DOUBLE + 0.5::DOUBLE * (b.i - greatest(1, a.i - 29)) / greatest(1, least(a.i, 30) - 1))) AS score
  FROM m a JOIN m b ON a.video_id = b.video_id AND a.track_id = b.track_id AND b.i BETWEEN a.i - 29 AND a.i GROUP BY ALL),
t AS (SELECT video_id, track_id, i, frame_idx, list({{'num': num, 'share': score / total, 'cnt': cnt}}) AS shares, list(num) AS nums
  FROM (SELECT *, sum(score) OVER (PARTITION BY video_id, track_id, i) AS total FROM s) GROUP BY 1, 2, 3, 4),
f AS (SELECT video_id, track_id, i, list_transform(shares, lambda x: {{'num': x.num, 'p': x.share, 'seen': frame_idx, 'cnt': x.cnt}}) AS state FROM t WHERE i = 1
  UNION ALL SELECT g.video_id, g.track_id, g.i, list_transform(g.merged, lambda x: {{'num': x.num, 'p': x.p / list_sum(list_transform(g.merged, lambda y: y.p)), 'seen': x.seen, 'cnt': x.cnt}})
  FROM (SELECT t.video_id, t.track_id, t.i, list_concat(
    list_transform(t.shares, lambda x: {{'num': x.num, 'p': coalesce(list_filter(f.state, lambda o: o.num = x.num)[1].p * 0.9::DOUBLE + x.share * 0.1::DOUBLE, x.share), 'seen': t.frame_idx, 'cnt': x.cnt}}),
    list_filter(list_transform(list_filter(f.state, lambda o: NOT list_contains(t.nums, o.num)),
      lambda o: {{'num': o.num, 'p': o.p * pow(0.95::DOUBLE, t.frame_idx - o.seen), 'seen': o.seen, 'cnt': o.cnt}}), lambda o: o.p >= 0.1 OR o.seen = t.frame_idx)) AS merged
    FROM f JOIN t ON t.video_id = f.video_id AND t.track_id = f.track_id AND t.i = f.i + 1) g)
SELECT video_id, track_id, u.num AS jersey_number, round(u.p, 6) AS probability, u.seen AS last_seen_frame, u.cnt AS measurement_count FROM
(SELECT video_id, track_id, unnest(state) AS u FROM (SELECT *, row_number() OVER (PARTITION BY video_id, track_id ORDER BY i DESC) AS last FROM f) WHERE last = 1)"""


@query("fuse_jerseys", FUSED)
def _(spark, sf):
    return ident.fuse_jerseys(table(spark, sf, "measurements")).select(
        *TRACK, "jersey_number", *r6("probability"), "last_seen_frame", "measurement_count"
    )
