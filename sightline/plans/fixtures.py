"""Sports-tracking record tables as views over the generic test tables.

Each view is plain SQL that runs unchanged in Spark and in DuckDB. ``{name}``
stands for a test table. Frames, videos and runs are cut from row keys by
division, so their number grows with the data and their size does not.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DETECTIONS = """
SELECT video_id, frame_idx,
       CAST(row_number() OVER (PARTITION BY video_id, frame_idx ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax) - 1 AS BIGINT) AS det_idx,
       CAST(l_partkey * 37 % 1800 AS INT) AS x1, CAST(l_suppkey * 53 % 900 AS INT) AS y1,
       CAST(l_partkey * 37 % 1800 + 20 + 2 * l_quantity AS INT) AS x2,
       CAST(l_suppkey * 53 % 900 + 40 + 3 * l_quantity AS INT) AS y2,
       round(0.3E0 + 7 * l_discount, 4) AS confidence,
       CASE WHEN l_linenumber = 7 THEN 0 ELSE 1 END AS class_id,
       CASE WHEN l_linenumber = 7 THEN 'disc' ELSE 'player' END AS class_name,
       CASE WHEN l_linenumber = 7 THEN 'disc_model' ELSE 'player_model' END AS model_type
FROM (SELECT *, l_orderkey % 8 AS video_id, CAST(floor(l_orderkey / 256.0E0) AS BIGINT) AS frame_idx
      FROM {lineitem}) t
"""

TRACKS = """
SELECT user_id % 4 AS video_id, CAST(floor(event_id / 15.0E0) AS BIGINT) AS frame_idx,
       event_id AS seq, user_id AS track_id,
       CAST((user_id * 97 + event_id * 3) % 1800 AS INT) AS x1,
       CAST((user_id * 61 + event_id) % 900 AS INT) AS y1,
       CAST((user_id * 97 + event_id * 3) % 1800 + 40 AS INT) AS x2,
       CAST((user_id * 61 + event_id) % 900 + 90 AS INT) AS y2,
       CASE WHEN user_id % 11 = 0 THEN 'disc' ELSE 'player' END AS class_name,
       CAST(30 + event_id % 70 AS DOUBLE) / 100 AS confidence
FROM {events}
"""

MEASUREMENTS = """
SELECT user_id % 4 AS video_id, user_id AS track_id,
       CAST(floor(event_id / 15.0E0) AS BIGINT) AS frame_idx, event_id AS seq, ts,
       regexp_extract(props, '[0-9]+', 0) AS jersey_number,
       CAST(30 + event_id % 70 AS DOUBLE) / 100 AS confidence,
       CAST(event_id * 7 % 101 AS DOUBLE) / 100 AS center_x
FROM {events}
"""

# One text per row; a crop (event) holds one to three of them. Spark builds the
# same texts as arrays inside each crop's row (``ocr_crops``).
OCR_TEXTS = """
SELECT e.user_id % 4 AS video_id, CAST(floor(e.event_id / 15.0E0) AS BIGINT) AS frame_idx,
       e.user_id AS track_id, e.event_id AS crop_id,
       CAST(40 + e.event_id % 60 AS INT) AS crop_width, p.pos AS pos,
       CASE (e.event_id + p.pos) % 5 WHEN 0 THEN concat('#', CAST((e.event_id + p.pos) % 130 AS VARCHAR(9)), 'a')
            WHEN 1 THEN 'abc' WHEN 2 THEN concat('0', CAST(e.user_id % 10 AS VARCHAR(9)))
            ELSE CAST((e.event_id * 3 + p.pos) % 120 AS VARCHAR(9)) END AS text,
       CAST((e.event_id * 13 + p.pos * 29) % 100 AS DOUBLE) / 100 AS conf,
       CAST((e.event_id * 5 + p.pos * 11) % 50 AS DOUBLE) AS left_x,
       CAST((e.event_id * 5 + p.pos * 11) % 50 + 6 + e.event_id % 9 AS DOUBLE) AS right_x,
       CAST((e.event_id * 3 + p.pos * 5) % 20 AS DOUBLE) AS top_y,
       CAST((e.event_id * 3 + p.pos * 5) % 20 + 8 + e.event_id % 5 AS DOUBLE) AS bottom_y
FROM {events} e, (SELECT 0 AS pos UNION ALL SELECT 1 UNION ALL SELECT 2) p WHERE p.pos <= e.event_id % 3
"""

CONTOUR_POINTS = """
SELECT video_id, frame_idx, contour_id, pt_idx,
       CAST(CASE pt_idx % 4 WHEN 0 THEN along WHEN 1 THEN along WHEN 2 THEN 100 + noise ELSE 900 + noise END AS DOUBLE) AS x,
       CAST(CASE pt_idx % 4 WHEN 0 THEN 100 + noise WHEN 1 THEN 800 + noise ELSE along END AS DOUBLE) AS y
FROM (SELECT CAST(floor(l_orderkey / 600.0E0) AS BIGINT) AS video_id,
             CAST(floor(l_orderkey / 75.0E0) AS BIGINT) % 8 AS frame_idx,
             CAST(l_linenumber % 2 AS INT) AS contour_id,
             l_orderkey % 75 * 4 + CAST(floor(l_linenumber / 2.0E0) AS BIGINT) AS pt_idx,
             min(l_partkey) * 13 % 1000 AS along, min(l_suppkey) % 7 - 3 AS noise
      FROM {lineitem} GROUP BY 1, 2, 3, 4) t
"""

# Video v has the 400 lines of parts 400 v … 400 v + 399 and the 20 candidates of suppliers 20 v ….
FIELD_LINES = """
SELECT CAST(floor(p_partkey / 400.0E0) AS BIGINT) AS video_id, p_partkey % 50 AS frame_idx,
       p_partkey AS line_idx,
       CAST(p_partkey * 31 % 1920 AS DOUBLE) AS x1, CAST(p_partkey * 17 % 1080 AS DOUBLE) AS y1,
       CAST((p_partkey * 31 + p_size * 40) % 1920 AS DOUBLE) AS x2,
       CAST((p_partkey * 17 + p_size * 3) % 1080 AS DOUBLE) AS y2,
       CAST(p_size AS DOUBLE) / 50 AS confidence
FROM {part}
"""

HOMOGRAPHIES = """
SELECT CAST(floor(s_suppkey / 20.0E0) AS BIGINT) AS video_id, s_suppkey AS cand_id,
       CAST(floor(s_suppkey / 5.0E0) AS BIGINT) % 4 AS generation,
       CAST(5 + s_suppkey % 11 AS DOUBLE) / 10 AS h00, CAST(s_suppkey % 5 - 2 AS DOUBLE) / 20 AS h01,
       CAST(s_suppkey % 13 * 10 - 60 AS DOUBLE) AS h02,
       CAST(s_suppkey % 3 - 1 AS DOUBLE) / 20 AS h10, CAST(5 + s_suppkey % 17 AS DOUBLE) / 10 AS h11,
       CAST(s_suppkey % 19 * 10 - 90 AS DOUBLE) AS h12,
       CAST(s_suppkey % 4 - 2 AS DOUBLE) / 10000 AS h20, CAST(s_suppkey % 6 - 3 AS DOUBLE) / 10000 AS h21
FROM {supplier}
"""

# A registry of calibrations saved over time, one per order, for one video in 250 orders.
REGISTRY = """
SELECT CAST(floor(o_orderkey / 250.0E0) AS BIGINT) AS video_id,
       o_orderkey * 7 % 500 AS frame_index, o_orderdate AS created_at, o_orderkey AS save_id,
       CAST(5 + o_orderkey % 11 AS DOUBLE) / 10 AS h00, CAST(o_orderkey % 5 - 2 AS DOUBLE) / 20 AS h01,
       CAST(o_orderkey % 13 * 10 - 60 AS DOUBLE) AS h02,
       CAST(o_orderkey % 3 - 1 AS DOUBLE) / 20 AS h10, CAST(5 + o_orderkey % 17 AS DOUBLE) / 10 AS h11,
       CAST(o_orderkey % 19 * 10 - 90 AS DOUBLE) AS h12,
       CAST(o_orderkey % 4 - 2 AS DOUBLE) / 10000 AS h20, CAST(o_orderkey % 6 - 3 AS DOUBLE) / 10000 AS h21
FROM {orders}
"""

MASK_RUNS = """
SELECT CAST(floor(l_orderkey / 600.0E0) AS BIGINT) AS video_id,
       CAST(floor(l_orderkey / 150.0E0) AS BIGINT) % 4 AS frame_idx,
       CAST(l_linenumber % 2 AS INT) AS class_id, CAST(l_suppkey % 100 AS INT) AS y,
       CAST(l_partkey % 500 AS INT) AS x_start, CAST(l_partkey % 500 + l_quantity AS INT) AS x_end
FROM {lineitem}
"""

STAGE_TIMINGS = """
SELECT event_id AS seq, user_id % 4 AS video_id, CAST(floor(event_id / 15.0E0) AS BIGINT) AS frame_idx,
       CASE event_type WHEN 'view' THEN 'Inference' WHEN 'signup' THEN 'Player ID - EasyOCR'
            WHEN 'error' THEN 'Line Extraction' WHEN 'click' THEN 'Homography Calculation'
            ELSE 'Cache - Lookup' END AS process_name,
       value AS duration_ms, ts
FROM {events}
"""

MODEL_TIMINGS = """
SELECT event_id AS seq, user_id % 4 AS video_id, CAST(floor(event_id / 15.0E0) AS BIGINT) AS frame_idx,
       CASE WHEN event_id % 3 = 0 THEN 'disc' ELSE 'player' END AS model,
       CASE event_id % 4 WHEN 0 THEN 'preprocessing' WHEN 1 THEN 'postprocessing' ELSE 'inference' END AS phase,
       value AS duration_ms
FROM {events}
"""

# Runs of up to 80 epochs; both metrics are fractions without rounding.
TRAINING_METRICS = """
SELECT CAST(floor(o_orderkey / 80.0E0) AS BIGINT) AS run_id, o_orderkey % 80 + 1 AS epoch,
       CAST(o_orderkey * 7919 % 1000 AS DOUBLE) / 1000 AS map50,
       CAST(o_orderkey * 104729 % 1000 AS DOUBLE) / 500 AS box_loss
FROM {orders}
"""

# Runs of 200 log lines: preparation, start, then ten epochs of epoch and batch lines.
TRAINING_LOG = """
SELECT CAST(floor(o_orderkey / 200.0E0) AS BIGINT) AS run_id, o_orderkey % 200 AS line_no, ts,
       CASE WHEN n < 6 THEN concat('Scanning labels... ', CAST(n * 7 AS VARCHAR(9)), '/100 images')
            WHEN n = 6 THEN 'Starting training for 10 epochs...'
            WHEN n < 10 THEN concat('Model summary: ', CAST(o_custkey AS VARCHAR(9)), ' layers')
            WHEN (n - 10) % 19 = 0 THEN concat(CAST(e AS VARCHAR(9)), '/10      4.96G   ', CAST(o_custkey % 97 AS VARCHAR(9)))
            WHEN (n - 10) % 19 = 7 THEN 'saving checkpoint'
            ELSE concat(CAST(b * 5 AS VARCHAR(9)), '%|###   | ', CAST(b AS VARCHAR(9)), '/20 [00:30<00:15, 1.67it/s]') END AS line
FROM (SELECT *, o_orderkey % 200 AS n,
             CAST(floor((o_orderkey % 200 - 10) / 19.0E0) AS BIGINT) + 1 AS e,
             (o_orderkey % 200 - 10) % 19 + 1 AS b,
             TIMESTAMP '2024-01-01 00:00:00' + (o_orderkey % 200) * INTERVAL '2' SECOND AS ts
      FROM {orders}) t
"""

VIDEOS = """
SELECT s_suppkey AS video_id, concat('v/', s_name, '.mp4') AS path,
       CASE WHEN s_suppkey % 7 = 0 THEN 0.0E0 WHEN s_suppkey % 7 = 1 THEN 240.0E0
            ELSE CAST(20 + s_suppkey % 41 AS DOUBLE) END AS fps,
       s_suppkey * 977 % 200000 AS frame_count,
       CAST(640 + s_suppkey % 5 * 320 AS INT) AS width, CAST(360 + s_suppkey % 5 * 180 AS INT) AS height
FROM {supplier}
"""

# Document texts stand for frame contents: many are copies of one another.
FRAME_CONTENTS = """
SELECT CAST(doc_id % 8 AS BIGINT) AS video_id, CAST(floor(doc_id / 8.0E0) AS BIGINT) AS frame_idx,
       text, CASE WHEN doc_id % 3 = 0 THEN 'True|False' ELSE 'True|True' END AS settings_key
FROM {documents}
"""

# Eight detections per frame with a 64-number appearance each.
APPEARANCE = """
SELECT vec_id % 8 AS det_idx, CAST(floor(vec_id / 8.0E0) AS BIGINT) AS frame_idx,
       CAST(0 AS BIGINT) AS video_id, embedding
FROM {embeddings}
"""

_TABLE = re.compile(r"\{(\w+)\}")


def for_duckdb(view: str) -> str:
    return "(" + _TABLE.sub(r"\1", view).strip() + ")"


def load(spark: SparkSession, sf_dir: str, view: str) -> DataFrame:
    tables = {
        name: spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in set(_TABLE.findall(view))
    }
    return spark.sql(view, **tables)


def ocr_crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per crop with its ``results`` array, the records of ``OCR_TEXTS``."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    event, user = F.col("event_id"), F.col("user_id")

    def record(pos):
        n = event + pos
        number = ((event * 3 + pos) % 120).cast("string")
        text = (
            F.when(n % 5 == 0, F.concat(F.lit("#"), (n % 130).cast("string"), F.lit("a")))
            .when(n % 5 == 1, "abc")
            .when(n % 5 == 2, F.concat(F.lit("0"), (user % 10).cast("string")))
            .otherwise(number)
        )
        left = ((event * 5 + pos * 11) % 50).cast("double")
        right = left + 6 + event % 9
        top = ((event * 3 + pos * 5) % 20).cast("double")
        bottom = top + 8 + event % 5

        def corner(x, y):
            return F.struct(x.alias("x"), y.alias("y"))

        poly = F.array(corner(left, top), corner(right, top), corner(right, bottom),
                       corner(left, bottom))
        conf = ((event * 13 + pos * 29) % 100).cast("double") / 100
        return F.struct(poly.alias("poly"), text.alias("text"), conf.alias("conf"))

    return e.select(
        (user % 4).alias("video_id"), F.floor(event / 15).cast("bigint").alias("frame_idx"),
        user.alias("track_id"), event.alias("crop_id"),
        (40 + event % 60).cast("int").alias("crop_width"),
        F.transform(F.sequence(F.lit(0), (event % 3).cast("int")), record).alias("results"),
    )
