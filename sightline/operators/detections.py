"""Per-detection projections, filters and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import boxes
from ..functions.labels import class_name_of, model_type_of
from ..settings import CROP, DETECTION
from .ordered import index_rows

BOX = ("x1", "y1", "x2", "y2")


def by_model(values: dict, default=None, model: Column | None = None) -> Column:
    """Look a per-model parameter up as an expression."""
    model = F.col("model_type") if model is None else model
    out = F.lit(default)
    for name, value in values.items():
        out = F.when(model == name, F.lit(value)).otherwise(out)
    return out


def filter_confidence(df: DataFrame, thresholds: dict = DETECTION.thresholds) -> DataFrame:
    """Keep detections at or above the threshold of their model, 0.5 for a model not named.

    The lowest threshold is a condition of its own, which reaches the scan by itself.
    """
    model, confidence, other = F.col("model_type"), F.col("confidence"), 0.5
    kept = (model.isNull() | ~model.isin(*thresholds)) & (confidence >= other)
    for name, least in thresholds.items():
        kept = kept | ((model == name) & (confidence >= least))
    return df.filter(confidence >= min(other, *thresholds.values())).filter(kept)


def tag_detections(df: DataFrame, class_name: str) -> DataFrame:
    """Stamp one model's raw output with class and model; cut coordinates to whole pixels."""
    name = F.lit(class_name)
    return df.withColumns(
        {c: F.col(c).cast("int") for c in BOX}
        | {"class_name": name, "model_type": model_type_of(name)}
    )


def name_classes(df: DataFrame) -> DataFrame:
    """Derive class name and model from the class id, for id-only records."""
    name = class_name_of(F.col("class_id"))
    return df.withColumns({"class_name": name, "model_type": model_type_of(name)})


def union_detections(players: DataFrame, discs: DataFrame) -> DataFrame:
    """All detections of both models; ``source_order`` puts players first within a frame."""
    return players.withColumn("source_order", F.lit(0)).unionByName(
        discs.withColumn("source_order", F.lit(1))
    )


def to_tlwh(df: DataFrame) -> DataFrame:
    b = boxes.box()
    return df.withColumns(
        {
            "width": b[2] - b[0],
            "height": b[3] - b[1],
            "area": boxes.area(b),
            "center_x": (b[0] + b[2]) / 2,
            "center_y": (b[1] + b[3]) / 2,
        }
    )


def validate_detections(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split raw records ``(bbox array<string>, confidence, class_id string)``.

    Returns ``(valid, quarantine)``; the second carries the ``reason``.
    """
    values = {c: F.get("bbox", F.lit(i)).try_cast("double") for i, c in enumerate(BOX)}
    values["conf"] = F.col("confidence").try_cast("double")
    values["cls"] = F.col("class_id").try_cast("int")
    castable = F.lit(True)
    for name in values:
        castable = castable & F.col(name).isNotNull()
    checked = df.withColumns(values).withColumn(
        "reason",
        F.when(F.col("bbox").isNull(), "missing bbox")
        .when(F.size("bbox") != 4, "bbox length")
        .when(~castable, "not a number"),
    )
    valid = checked.filter(F.col("reason").isNull()).drop("reason", "bbox")
    valid = valid.withColumns({"confidence": F.col("conf"), "class_id": F.col("cls")})
    quarantine = checked.filter(F.col("reason").isNotNull())
    return valid.drop("conf", "cls"), quarantine.drop(*values)


def foot_point(df: DataFrame) -> DataFrame:
    """Bottom centre of the box in whole pixels."""
    return df.withColumns(
        {
            "foot_x": ((F.col("x1") + F.col("x2")) / 2).cast("int"),
            "foot_y": F.col("y2").cast("int"),
        }
    )


def clamp_bbox(df: DataFrame, width, height) -> DataFrame:
    """Move the box into the frame, at least one pixel wide and high."""
    w = width if isinstance(width, Column) else F.lit(width)
    h = height if isinstance(height, Column) else F.lit(height)
    x1, y1, x2, y2 = boxes.box()
    nx1, ny1 = boxes.clamp(x1, 0, w - 1), boxes.clamp(y1, 0, h - 1)
    return df.withColumns(
        {
            "x1": nx1,
            "y1": ny1,
            "x2": F.greatest(nx1 + 1, F.least(x2, w)),
            "y2": F.greatest(ny1 + 1, F.least(y2, h)),
        }
    )


def player_only(df: DataFrame) -> DataFrame:
    """Rows whose class names a player or a person."""
    name = F.lower("class_name")
    return df.filter(name.contains("player") | name.contains("person"))


def without_discs(df: DataFrame) -> DataFrame:
    return df.filter(F.lower("class_name") != "disc")


def jersey_crop(df: DataFrame, width, height, fraction: float = CROP.top_fraction) -> DataFrame:
    """Top part of each box, cut to the frame; empty windows are dropped."""
    x1, y1, x2, y2 = boxes.box()
    bottom = y1 + ((y2 - y1) * F.lit(fraction)).cast("int")
    crop = {
        "crop_x1": F.greatest(F.lit(0), x1),
        "crop_y1": F.greatest(F.lit(0), y1),
        "crop_x2": F.least(F.lit(width), x2),
        "crop_y2": F.least(F.lit(height), bottom),
    }
    out = df.withColumns(crop)
    return out.filter(
        (F.col("crop_x2") > F.col("crop_x1")) & (F.col("crop_y2") > F.col("crop_y1"))
    )


def min_crop_filter(
    df: DataFrame, min_width: int = CROP.min_width, min_height: int = CROP.min_height
) -> DataFrame:
    """Mark crops too small to read with a ``skipped_reason``."""
    w = F.col("crop_x2") - F.col("crop_x1")
    h = F.col("crop_y2") - F.col("crop_y1")
    return df.withColumns(
        {
            "crop_width": w,
            "crop_height": h,
            "skipped_reason": F.when((w < min_width) | (h < min_height), "crop_too_small"),
        }
    )


def unletterbox_boxes(
    df: DataFrame, frame_width: Column, frame_height: Column, target: int = 640
) -> DataFrame:
    """Boxes in square model input → frame coordinates, clamped to the frame."""
    side = F.greatest(frame_width, frame_height)
    scale = F.lit(float(target)) / side
    pad_x = F.floor((side - frame_width) / 2)
    pad_y = F.floor((side - frame_height) / 2)
    limits = {"x1": (pad_x, frame_width), "y1": (pad_y, frame_height),
              "x2": (pad_x, frame_width), "y2": (pad_y, frame_height)}
    return df.withColumns(
        {c: boxes.clamp(F.col(c) / scale - pad, 0, top) for c, (pad, top) in limits.items()}
    )


def letterbox_boxes(
    df: DataFrame, frame_width: Column, frame_height: Column, target: int = 640
) -> DataFrame:
    """Frame coordinates → square model input; the forward mapping."""
    side = F.greatest(frame_width, frame_height)
    scale = F.lit(float(target)) / side
    pad_x = F.floor((side - frame_width) / 2)
    pad_y = F.floor((side - frame_height) / 2)
    return df.withColumns(
        {"x1": (F.col("x1") + pad_x) * scale, "y1": (F.col("y1") + pad_y) * scale,
         "x2": (F.col("x2") + pad_x) * scale, "y2": (F.col("y2") + pad_y) * scale}
    )


def sample_frames(df: DataFrame, n: int) -> DataFrame:
    return df.filter(F.col("frame_idx") % n == 0)


def detection_counts(df: DataFrame) -> DataFrame:
    """Detections per frame: total and by model."""
    def of(model):
        return F.count(F.when(F.col("model_type") == model, 1))

    return df.groupBy("video_id", "frame_idx").agg(
        F.count("*").alias("detections"),
        of("player_model").alias("players"),
        of("disc_model").alias("discs"),
    )


def simple_track_ids(df: DataFrame, order=("det_idx",)) -> DataFrame:
    """Fallback ids ``frame_idx * 1000 + index``; ``id_collides`` marks index 1000 and up."""
    out = index_rows(df, ["video_id", "frame_idx"], list(order), "index")
    return out.withColumns(
        {
            "track_id": F.col("frame_idx") * 1000 + F.col("index"),
            "id_collides": F.col("index") >= 1000,
        }
    )
