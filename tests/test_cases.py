"""Hand-worked cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sightline.functions import labels, projective
from sightline.operators import calibration, detections, field, identity, lines, telemetry, training
from sightline.operators.ordered import index_rows
from sightline.settings import JERSEY, JerseyDefaults


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_canvas(spark):
    assert projective.canvas_of(1920, 1080) == (1115, 3345)
    w, h = projective.canvas(F.lit(1920), F.lit(1080))
    assert (one(spark, w), one(spark, h)) == (1115, 3345)
    w, h = projective.canvas(F.lit(1920), F.lit(1080), 1.8, 1 / 3)
    assert one(spark, w) > one(spark, h)


@pytest.mark.parametrize("x,expected", [(0.5, 1.3), (0.9, 2 / 3), (0.0, 0.5), (0.4, 1.15)])
def test_spatial_weight(spark, x, expected):
    assert one(spark, labels.spatial_weight(F.lit(x))) == pytest.approx(expected, abs=1e-9)


@pytest.mark.parametrize("text,expected", [("#7a", "7"), ("100", None), ("", None), ("07", "07")])
def test_clean_jersey(spark, text, expected):
    assert one(spark, labels.clean_jersey(F.lit(text))) == expected


@pytest.mark.parametrize(
    "seconds,expected", [(60, "60s"), (61, "1m 1s"), (3600, "60m 0s"), (3601, "1h 0m")]
)
def test_elapsed(spark, seconds, expected):
    assert one(spark, labels.format_elapsed(F.lit(float(seconds)))) == expected


def test_age_weight(spark):
    df = spark.createDataFrame(
        [(1, 1, i, i, "7", 0.9, 0.5) for i in range(3)],
        "video_id long, track_id long, frame_idx long, seq long, jersey_number string, "
        "confidence double, center_x double",
    )
    got = [r["age_weight"] for r in identity.recent_measurements(df).orderBy("seq").collect()]
    assert got == [0.5, 0.75, 1.0]


@pytest.mark.parametrize("share,expected", [(0.375, 0.5), (0.75, 1.0), (1.0, 0.5)])
def test_coverage(spark, share, expected):
    assert one(spark, calibration.coverage_score(F.lit(share))) == pytest.approx(expected)


def test_proportion(spark):
    got = one(spark, calibration.proportion(F.lit(1000), F.lit(3000)))
    assert got == pytest.approx(0.4)


def _identity_candidate(spark):
    return spark.createDataFrame(
        [(1, 1, 1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0)],
        "video_id long, cand_id long, h00 double, h01 double, h02 double, h10 double, "
        "h11 double, h12 double, h20 double, h21 double",
    )


@pytest.mark.parametrize("vertical,horizontal,expected", [(0, 3, 0.0), (2, 2, 1.0), (1, 1, 0.8)])
def test_orientation(spark, vertical, horizontal, expected):
    rows = [(1, 100.0 + i, 100.0, 100.0 + i, 300.0, 0.9) for i in range(vertical)]
    rows += [(1, 100.0, 100.0 + i, 300.0, 100.0 + i, 0.9) for i in range(horizontal)]
    drawn = spark.createDataFrame(
        rows, "video_id long, x1 double, y1 double, x2 double, y2 double, confidence double"
    )
    got = calibration.score_orientation(_identity_candidate(spark), drawn, 1115, 3345).first()
    assert got["orientation"] == pytest.approx(expected)
    assert (got["vertical_lines"], got["horizontal_lines"]) == (vertical, horizontal)


def test_coverage_with_luma(spark):
    cells = [(1, i, j, 50.0 if i < 8 else 5.0) for i in range(16) for j in range(9)]
    luma = spark.createDataFrame(cells, "video_id long, cell_x int, cell_y int, luma double")
    cand = _identity_candidate(spark)
    plain = calibration.score_coverage(cand, (1920, 1080), (1115, 3345)).first()
    lit = calibration.score_coverage(cand, (1920, 1080), (1115, 3345), luma=luma).first()
    assert 0 < lit["covered"] < plain["covered"]


def test_coverage_is_the_clipped_area(spark):
    rng = np.random.default_rng(5)
    scale = np.array([1.0, 0.3, 400.0, 0.3, 1.0, 400.0, 1e-3, 1e-3])
    matrices = (np.array([1.0, 0, 0, 0, 1.0, 0, 0, 0]) + rng.normal(size=(40, 8)) * scale).tolist()
    matrices += [[1.0, 2.0, 0.0, 2.0, 4.0, 0.0, 0.0, 0.0], [1.0, 0.0, 5e4, 0.0, 1.0, 0.0, 0.0, 0.0], [None] * 8]
    found = spark.createDataFrame(
        [(i, *m) for i, m in enumerate(matrices)], "cand_id int, " + ", ".join(f"{c} double" for c in projective.H_COLUMNS)
    )
    scored = calibration.score_coverage(found, (1920, 1080), (1115, 3345), keys=["cand_id"])
    share = {r["cand_id"]: r["covered"] for r in scored.collect()}
    x, y = np.meshgrid((np.arange(600) + 0.5) * 1115 / 600, (np.arange(1200) + 0.5) * 3345 / 1200)
    for i, m in enumerate(matrices[:40]):
        back = np.linalg.inv(np.array([*m, 1.0]).reshape(3, 3))
        fx, fy, w = np.tensordot(back, np.stack([x, y, np.ones_like(x)]), 1)
        inside = (fx / w >= 0) & (fx / w < 1920) & (fy / w >= 0) & (fy / w < 1080)
        assert share[i] == pytest.approx(inside.mean(), abs=3e-3)
    assert [share[i] for i in (40, 41, 42)] == [0.0, 0.0, 0.0]
    assert "Exchange" not in scored._jdf.queryExecution().toString()


@pytest.mark.parametrize("inliers,expected", [(30, 0.95), (10, 0.4), (0, 0.3)])
def test_line_confidence(spark, inliers, expected):
    found = spark.createDataFrame([(1, 1, inliers)], "video_id long, frame_idx long, inliers long")
    sizes = spark.createDataFrame([(1, 1, 100)], "video_id long, frame_idx long, points long")
    got = lines.line_confidence(found, sizes).first()
    assert got["confidence"] == pytest.approx(expected)


def _square(spark, side=100.0):
    corners = [(0.0, 0.0), (side, 0.0), (side, side), (0.0, side)]
    return spark.createDataFrame(
        [(1, 1, 0, i, x, y) for i, (x, y) in enumerate(corners)],
        "video_id long, frame_idx long, contour_id int, pt_idx int, x double, y double",
    )


def test_square(spark):
    got = field.contour_measures(_square(spark)).first()
    assert (got["points"], got["area"], got["perimeter"]) == (4, 10000.0, 400.0)


def test_densify_counts(spark):
    # Edges of 50 with at most 20 between points: two more on each of four edges.
    dense = field.densify_contours(_square(spark, 50.0))
    assert dense.count() == 12
    # The minimum distance thins added points without touching the corners.
    assert field.densify_contours(_square(spark, 50.0), 20.0, 30.0).filter("sub_idx = 0").count() == 4


def test_mask_rectangle(spark):
    rows = [(1, 1, 0, y, 192, 1728) for y in range(648)]
    runs = spark.createDataFrame(
        rows, "video_id long, frame_idx long, class_id int, y int, x_start int, x_end int"
    )
    assert field.mask_area(runs).first()["area"] == 995328


def test_islands_sql_counts_equal_runs_once():
    """Runs that occur several times leave the SQL of merged runs as it is."""
    import duckdb

    from sightline.plans import field_queries

    con = duckdb.connect()
    for times in (1, 4):
        con.execute(
            f"""CREATE OR REPLACE TABLE lineitem AS SELECT 0::BIGINT AS l_orderkey, i % 20 AS l_linenumber, i * 7919 % 480 AS l_partkey,
            i % 100 AS l_suppkey, 1.0::DOUBLE + i * 31 % 3 AS l_quantity FROM range(20000) t(i), range({times}) r(k)"""
        )
        found = con.execute(f"SELECT count(*), sum(x_end - x_start) FROM {field_queries.ISLANDS}").fetchone()
        assert found == (2400, 4800)


def test_identity_projection(spark):
    tracks = spark.createDataFrame(
        [(1, 0, 0, 5, 10.0, 20.0, 30.0, 60.0)],
        "video_id long, frame_idx long, seq long, track_id long, x1 double, y1 double, "
        "x2 double, y2 double",
    )
    got = calibration.project_to_field(tracks, _identity_candidate(spark), 1115, 3345).first()
    assert (got["field_x"], got["field_y"]) == (20, 60)
    none = calibration.project_to_field(tracks, _identity_candidate(spark), 10, 10)
    assert none.count() == 0


def _log(spark, *texts):
    rows = [("r", i, i * 10, t) for i, t in enumerate(texts)]
    d = spark.createDataFrame(rows, "run_id string, line_no long, s long, line string")
    return d.withColumn("ts", F.timestamp_seconds("s")).drop("s")


def test_log_epoch(spark):
    got = training.parse_training_log(_log(spark, "5/100      4.96G")).first()
    assert (got["epoch"], got["total_epochs"], got["percent"], got["phase"]) == (5, 100, 5, "training")


BATCH = "50%|███| 25/50 [00:30<00:15, 1.67it/s]"


def test_log_batch(spark):
    d = _log(spark, "Epoch 1/10", BATCH)
    got = training.parse_training_log(d).orderBy("line_no").collect()[1]
    assert (got["batch"], got["batches"], got["its_per_sec"], got["percent"]) == (25, 50, 1.67, 5)
    hidden = training.parse_training_log(d, parity=True).orderBy("line_no").collect()[1]
    assert hidden["batch"] is None and hidden["epoch"] == 1


def test_log_phases(spark):
    d = _log(
        spark, "scanning labels 3/90 ", "hello", "4/90 images found", "optimizer: x 1/50 ",
        "2/50 loading", "3/50  1.2G", "7/50 train: found",
    )
    rows = training.parse_training_log(d).orderBy("line_no").collect()
    assert [r["phase"] for r in rows] == [
        "preparing", "unknown", "preparing", "starting", "training", "training", "training",
    ]
    assert [r["epoch"] for r in rows] == [0, 0, 0, 0, 2, 3, 7]


def test_stage_names(spark):
    names = ["Homography Qt Display", "Homography Other", "Cache - Store", "Player ID - Preprocessing",
             "Player ID - Filtering", "Mask Unification", "Inference", "Player ID"]
    d = spark.createDataFrame([(n,) for n in names], "process_name string")
    got = [(r["category"], r["sub"]) for r in telemetry.categorize_stage(d).collect()]
    assert got == [
        ("Homography", "Display"), ("Homography", None), ("Cache", "Store"),
        ("Player Identification", "Preprocessing"),
        ("Player Identification", "Jersey Number Filtering"),
        ("Field Segmentation", "Mask Unification"), ("Inference", None),
        ("Player Identification", None),
    ]


@pytest.mark.parametrize("numbers", [("8", "9"), ("9", "8")])
def test_equal_shares_tie_whatever_the_order_of_addition(spark, numbers):
    even = JerseyDefaults(center_bonus=0.0, weight_old=1.0)
    weights = [(numbers[0], c) for c in (0.1, 0.2, 0.3)] + [(numbers[1], c) for c in (0.3, 0.2, 0.1)]
    rows = [(1, 1, i, i, n, c, 0.5) for i, (n, c) in enumerate(weights)]
    d = spark.createDataFrame(
        rows, "video_id long, track_id long, frame_idx long, seq long, jersey_number string, confidence double, center_x double"
    ).coalesce(1)
    best = identity.jersey_table(identity.jersey_scores(d, settings=even)).first()
    assert (best["best_jersey"], best["best_probability"], best["second_jersey"]) == ("8", 0.5, "9")


def test_fusion_by_hand():
    state = identity.JerseyFusion(JERSEY)
    state.take([0], ["7"], [0.5])
    assert state.live["7"] == (1.0, 0, 1)
    state.take([1], ["8"], [0.5])
    # Weights .5 × .5 and .5 × 1: shares 1/3 and 2/3; "7" is smoothed, "8" enters as it is.
    seven, eight = 0.9 + 0.1 / 3, 2 / 3
    assert state.live["7"][0] == pytest.approx(seven / (seven + eight))
    assert math.isclose(sum(p for p, _, _ in state.live.values()), 1.0)


def test_fusion_does_not_depend_on_blocks():
    rng = np.random.default_rng(4)
    frames = np.sort(rng.integers(0, 400, 300))
    numbers = [str(n) for n in rng.integers(0, 5, 300)]
    weights = np.where(rng.random(300) < 0.2, 0.0, rng.random(300))
    whole, single = identity.JerseyFusion(JERSEY), identity.JerseyFusion(JERSEY)
    whole.take(frames, numbers, weights)
    for k in range(300):
        single.take(frames[k : k + 1], numbers[k : k + 1], weights[k : k + 1])
    assert whole.window == single.window and whole.live.keys() == single.live.keys()
    for n, (p, seen, count) in whole.live.items():
        assert (pytest.approx(p), seen, count) == single.live[n]


def test_simple_ids_flag_collisions(spark):
    d = spark.range(1200).select(
        F.lit(1).alias("video_id"), F.lit(2).alias("frame_idx"), F.col("id").alias("det_idx")
    )
    got = detections.simple_track_ids(d)
    assert got.filter("id_collides").count() == 200
    assert got.agg(F.max("track_id")).first()[0] == 3199
    assert index_rows(d, ["video_id"], ["det_idx"], chunk=F.col("det_idx") % 1).count() == 1200
