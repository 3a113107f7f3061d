"""Catalogues of video files and image datasets: file listings, no content read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import format_clock
from ..settings import DEFAULT_FPS, IMAGE_EXTENSIONS, MAX_FPS, MIN_FPS, VIDEO_EXTENSIONS


def _files(spark: SparkSession, paths, recursive: bool) -> DataFrame:
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", str(recursive).lower())
        .load(list(paths))
        .select("path", "length", "modificationTime")
        .withColumn("ext", F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)))
    )


def video_catalog(spark: SparkSession, dirs) -> DataFrame:
    """Video files directly inside ``dirs``, by path."""
    files = _files(spark, dirs, recursive=False)
    return files.filter(F.col("ext").isin(*VIDEO_EXTENSIONS)).orderBy("path")


def normalize_videos(df: DataFrame) -> DataFrame:
    """Play rate within bounds, and the length in seconds and as ``MM:SS``."""
    bad = F.col("fps").isNull() | ~F.col("fps").between(MIN_FPS, MAX_FPS)
    seconds = F.when(F.col("fps") > 0, F.col("frame_count") / F.col("fps"))
    return df.withColumns(
        {
            "play_fps": F.when(bad, F.lit(DEFAULT_FPS)).otherwise(F.col("fps")),
            "duration_seconds": F.coalesce(seconds, F.lit(0.0)),
            "duration": format_clock(seconds),
        }
    )


def dataset_inventory(spark: SparkSession, root: str) -> DataFrame:
    """Images per split of a dataset laid out as ``<split>/images/<file>``."""
    files = _files(spark, [root], recursive=True)
    split = F.regexp_extract("path", r"/(train|valid|test)/images/[^/]+$", 1)
    return (
        files.withColumn("split", split)
        .filter((F.col("split") != "") & F.col("ext").isin(*IMAGE_EXTENSIONS))
        .groupBy("split")
        .agg(F.count("*").alias("images"))
    )


def dataset_classes(spark: SparkSession, path: str) -> DataFrame:
    """Class names from a dataset description with a ``names:`` list, inline or one per line."""
    text = spark.read.text(path, wholetext=True)
    block = F.regexp_extract("value", r"(?m)^names:[ \t]*(\[[^\]]*\]|(?:\r?\n[ \t]*-[^\r\n]*)+)", 1)
    items = F.filter(
        F.transform(F.split(block, r"[\[\],\n]"), lambda s: F.regexp_replace(
            F.trim(s), r"^-\s*|^['\"]|['\"]$", "")),
        lambda s: F.length(s) > 0,
    )
    return text.select(F.posexplode(items).alias("class_id", "class_name")).withColumn(
        "class_name", F.regexp_replace("class_name", r"^['\"]", "")
    )
