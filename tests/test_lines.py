"""Lines from whole contours."""

import __spark_entry__ as entry
from pyspark.sql import functions as F

from sightline.operators import lines as lin
from sightline.plans.catalog import FRAME, table

COLUMNS = ("video_id", "frame_idx", "line_idx", "trial", "inliers", "x1", "y1", "x2", "y2", "points", "confidence", "band")


def _rows(lines):
    rounded = [F.round(c, 6).alias(c) if c in ("x1", "y1", "x2", "y2", "confidence") else c for c in COLUMNS]
    return sorted(map(tuple, lines.select(*rounded).collect()))


def test_lines_are_extracted_from_whole_contours(spark):
    """The query has the operator's own margin and spacing; a wide margin left it a band of 20 rows."""
    got = entry.queries()["extract_field_lines"](spark, entry.SMOKE_DIR)
    own = lin.extract_field_lines(table(spark, entry.SMOKE_DIR, "contour_points"), *FRAME)
    assert _rows(got) == _rows(own)


def test_added_points_are_the_same_in_place_and_over_blocks(spark):
    """Also of a frame wholly at the border, of points that come twice, and of added points too close to keep."""
    shapes = {
        0: [(300, 200), (1500, 220), (1500, 220), (1480, 900), (310, 890)],
        1: [(0, 0), (1919, 3), (1919, 1079), (2, 1078)],  # its edges lie within the margin
        2: [(100.5, 100), (1817.3, 133), (955, 1000.25)],
    }
    rows = [(1, f, 0, i, float(x), float(y)) for f, ring in shapes.items() for i, (x, y) in enumerate(ring)]
    points = spark.createDataFrame(rows, "video_id long, frame_idx long, contour_id int, pt_idx long, x double, y double")
    whole = _rows(lin.extract_field_lines(points, *FRAME, 2.0, 3.0))
    assert whole == _rows(lin.extract_field_lines(points, *FRAME, 2.0, 3.0, group_limit=0))
    assert {r[1] for r in whole} == {0, 1, 2}
