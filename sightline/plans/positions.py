"""Who is where on the field, and which number are they wearing?"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.calibration import latest_homography, project_to_field
from ..operators.detections import without_discs
from ..operators.identity import attach_player_ids, jersey_scores, jersey_table


def who_is_where(
    tracks: DataFrame, measurements: DataFrame, registry: DataFrame, width: int, height: int
) -> DataFrame:
    """Field position and number of every player in every frame.

    The readings shrink to one row per track before they meet the tracks, and
    the registry to one row per video, so each join adds a small side.
    """
    numbers = jersey_table(jersey_scores(measurements)).withColumnRenamed(
        "best_jersey", "jersey_number"
    )
    placed = project_to_field(without_discs(tracks), latest_homography(registry), width, height)
    return attach_player_ids(placed, numbers).select(
        "video_id", "frame_idx", "seq", "track_id", "field_x", "field_y", "jersey_number", "label"
    )
