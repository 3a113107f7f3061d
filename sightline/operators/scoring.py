"""Plug-in points for models: the user's function scores batches, Spark does the rest."""

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from ..schemas import POINT
from .detections import filter_confidence, tag_detections
from .suppression import nms

# Numbers per detection in a model's output.
RECORD = 6


def score_frames(
    frames: DataFrame, make_predict_fn: Callable, inputs, class_name: str,
    batch_size: int = 32, input_tensor_shapes=None,
) -> DataFrame:
    """Run a detector over frames: ``(video_id, frame_idx, inputs…)`` → detections.

    ``make_predict_fn`` loads the model once per worker and returns a function
    from arrays of ``inputs`` to one row per frame with six numbers per box slot:
    x1, y1, x2, y2, confidence, class id. Unused slots hold NaN.
    """
    predict = predict_batch_udf(
        make_predict_fn, return_type=ArrayType(FloatType()), batch_size=batch_size,
        input_tensor_shapes=input_tensor_shapes,
    )
    flat = frames.select("video_id", "frame_idx", predict(*inputs).alias("flat"))
    slots = F.sequence(F.lit(0), F.floor(F.size("flat") / RECORD).cast("int") - 1)
    index = F.filter(slots, lambda i: ~F.isnan(F.get("flat", i * RECORD + 4)))
    rows = flat.filter(F.size("flat") >= RECORD).select(
        "video_id", "frame_idx", "flat", F.explode(index).alias("i")
    )

    def part(k):
        return F.get("flat", F.col("i") * RECORD + k)

    raw = rows.select(
        "video_id", "frame_idx", F.col("i").cast("bigint").alias("det_idx"),
        part(0).alias("x1"), part(1).alias("y1"), part(2).alias("x2"), part(3).alias("y2"),
        part(4).cast("double").alias("confidence"), part(5).cast("int").alias("class_id"),
    )
    return tag_detections(raw, class_name)


def detect(
    frames: DataFrame, players: Callable, discs: Callable, inputs, **options
) -> DataFrame:
    """Both detectors over the frames, then thresholds and suppression."""
    both = score_frames(frames, players, inputs, "player", **options).unionByName(
        score_frames(frames, discs, inputs, "disc", **options)
    )
    return nms(filter_confidence(both))


def score_crops(
    crops: DataFrame, make_predict_fn: Callable, inputs, batch_size: int = 16
) -> DataFrame:
    """Run a text reader over crops; adds ``results``, one record per text found.

    ``make_predict_fn`` loads the reader once per task and returns a function
    from lists of ``inputs`` to one JSON list per crop,
    ``[{"poly": [{"x", "y"}…], "text", "conf"}…]``.
    """

    @F.pandas_udf("string")
    def read(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        predict = make_predict_fn()
        for batch in batches:
            columns = batch if isinstance(batch, tuple) else (batch,)
            texts: list[str] = []
            for at in range(0, len(columns[0]), batch_size):
                texts += predict(*[c.iloc[at:at + batch_size].tolist() for c in columns])
            yield pd.Series(texts)

    schema = f"array<struct<poly: array<{POINT}>, text: string, conf: double>>"
    return crops.withColumn("results", F.from_json(read(*inputs), schema))
