"""Column expressions that classify, clean or format values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..settings import CLASS_NAMES, JERSEY, JERSEY_MAX, JERSEY_MIN, UNKNOWN


def class_name_of(class_id: Column) -> Column:
    out = F.lit("unknown")
    for number, name in CLASS_NAMES.items():
        out = F.when(class_id == number, name).otherwise(out)
    return out


def model_type_of(class_name: Column) -> Column:
    return F.when(class_name == "player", "player_model").otherwise("disc_model")


def digits_of(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def clean_jersey(text: Column) -> Column:
    """The digits of ``text`` if they form a shirt number, else null; leading zeros stay."""
    digits = F.nullif(digits_of(text), F.lit(""))
    return F.when(digits.try_cast("bigint").between(JERSEY_MIN, JERSEY_MAX), digits)


def spatial_weight(
    center_x: Column,
    center_width: float = JERSEY.center_width,
    center_bonus: float = JERSEY.center_bonus,
) -> Column:
    """Weight of a reading by its horizontal place in the box: bonus inside, decay outside."""
    half = center_width / 2
    off = F.abs(center_x - F.lit(0.5))
    inside = F.lit(1.0) + F.lit(center_bonus) * (F.lit(1.0) - off / F.lit(half))
    outside = F.lit(1.0) - (off - F.lit(half)) / F.lit(0.5 - half) * F.lit(0.5)
    return F.when(off <= F.lit(half), inside).otherwise(F.greatest(F.lit(0.5), outside))


def line_band(confidence: Column) -> Column:
    return (
        F.when(confidence > 0.8, "excellent")
        .when(confidence > 0.6, "good")
        .when(confidence > 0.4, "fair")
        .otherwise("low")
    )


def jersey_band(probability: Column) -> Column:
    return (
        F.when(probability >= 0.7, "high").when(probability >= 0.4, "medium").otherwise("low")
    )


def track_label(track_id: Column, jersey: Column) -> Column:
    known = jersey.isNotNull() & (jersey != UNKNOWN)
    return F.when(known, F.concat(F.lit("#"), jersey)).otherwise(
        F.concat(track_id.cast("string"), F.lit(":?"))
    )


def _whole(value: Column) -> Column:
    return F.floor(value).cast("bigint").cast("string")


def format_elapsed(seconds: Column) -> Column:
    hours = F.concat(_whole(seconds / 3600), F.lit("h "), _whole(seconds % 3600 / 60), F.lit("m"))
    minutes = F.concat(_whole(seconds / 60), F.lit("m "), _whole(seconds % 60), F.lit("s"))
    return (
        F.when(seconds > 3600, hours)
        .when(seconds > 60, minutes)
        .when(seconds.isNotNull(), F.concat(_whole(seconds), F.lit("s")))
    )


def format_clock(seconds: Column) -> Column:
    """``MM:SS`` (minutes run past 99), or ``Unknown`` without a length."""
    def two(c):
        return F.when(c < 10, F.concat(F.lit("0"), c.cast("string"))).otherwise(c.cast("string"))

    minutes = F.floor(seconds / 60).cast("bigint")
    rest = F.floor(seconds % 60).cast("bigint")
    return F.when(seconds.isNull(), UNKNOWN).otherwise(
        F.concat(two(minutes), F.lit(":"), two(rest))
    )


def stage_category(name: Column) -> tuple[Column, Column]:
    """``(category, sub)`` of a stage name; ``sub`` is null for a stage of its own."""
    n = F.trim(name)
    cut = F.instr(n, " - ")
    tail = F.when(cut > 0, F.trim(F.substring(n, cut + 3, F.length(n))))
    low = F.lower(tail)
    ocr_sub = (
        F.when(low == "easyocr", "Optical Character Recognition")
        .when(low.contains("preprocess"), "Preprocessing")
        .when(low.contains("filter"), "Jersey Number Filtering")
        .otherwise(tail)
    )
    in_field = n.isin("Line Extraction", "Mask Unification")
    category = (
        F.when(n.startswith("Cache"), "Cache")
        .when(n.startswith("Player ID"), "Player Identification")
        .when(n.startswith("Homography"), "Homography")
        .when(in_field, "Field Segmentation")
        .otherwise(n)
    )
    sub = (
        F.when(n.startswith("Cache"), tail)
        .when(n.startswith("Player ID"), ocr_sub)
        .when(
            n.startswith("Homography"),
            F.when(n.contains("Calculation"), "Calculation").when(
                n.contains("Display"), "Display"
            ),
        )
        .when(in_field, n)
    )
    return category, sub
