"""Jersey numbers: cleaning OCR output and fusing noisy readings per track."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.labels import (
    clean_jersey,
    digits_of,
    jersey_band,
    spatial_weight,
    track_label,
)
from ..settings import CROP, JERSEY, UNKNOWN, JerseyDefaults
from .ordered import newest
from .support import spread

TRACK = ("video_id", "track_id")


def filter_ocr(df: DataFrame, min_confidence: float = JERSEY.min_ocr_confidence) -> DataFrame:
    """Keep, inside each ``results`` array, the texts read with enough confidence."""
    return df.withColumn(
        "results", F.filter("results", lambda r: r["conf"] >= F.lit(min_confidence))
    )


def with_clean_jersey(df: DataFrame, text: str = "text") -> DataFrame:
    return df.withColumn("jersey_number", clean_jersey(F.col(text)))


def _mean(array: Column) -> Column:
    total = F.aggregate(array, F.lit(0.0), lambda acc, v: acc + v)
    return F.when(F.size(array) > 0, total / F.size(array))


def ocr_center_x(df: DataFrame, scale: float = 1.0) -> DataFrame:
    """Mean horizontal place of the texts in the crop, 0 (left) to 1; 0.5 without any.

    ``scale`` is the factor by which the crop was enlarged before reading; 1
    divides by the unscaled width as it stands.
    """
    polys = F.filter("results", lambda r: F.size(r["poly"]) >= 4)
    width = F.nullif(F.col("crop_width") * F.lit(float(scale)), F.lit(0.0))
    centers = F.transform(
        polys, lambda r: _mean(F.transform(r["poly"], lambda p: p["x"])) / width
    )
    mean = _mean(centers)
    return df.withColumn(
        "center_x",
        F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), mean)), F.lit(0.5)),
    )


def ocr_box_to_frame(df: DataFrame, fraction: float = CROP.top_fraction) -> DataFrame:
    """Box of a text in the processed crop → frame pixels inside the jersey area.

    Needs the text's ``poly``, the track box ``x1…y2`` and the sizes
    ``crop_width/height`` (before) and ``final_width/height`` (after processing).
    """
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    xs = F.transform("poly", lambda p: p["x"])
    ys = F.transform("poly", lambda p: p["y"])
    jersey_h = ((y2 - y1) * F.lit(fraction)).cast("int")
    step_x = F.col("crop_width") / F.col("final_width")
    step_y = F.col("crop_height") / F.col("final_height")
    fit_x = (x2 - x1) / F.col("crop_width")
    fit_y = jersey_h / F.col("crop_height")

    def back(value, step, fit, origin):
        return origin + (value.cast("int") * step * fit).cast("int")

    left, right = back(F.array_min(xs), step_x, fit_x, x1), back(F.array_max(xs), step_x, fit_x, x1)
    top, bottom = back(F.array_min(ys), step_y, fit_y, y1), back(F.array_max(ys), step_y, fit_y, y1)
    right = F.greatest(right, left + 3)
    bottom = F.greatest(bottom, top + 3)
    left = F.greatest(x1, F.least(left, x2 - 3))
    top = F.greatest(y1, F.least(top, y1 + jersey_h - 3))
    usable = (
        (F.size("poly") == 4)
        & (F.col("final_width") > 0) & (F.col("final_height") > 0)
        & (F.col("crop_width") > 0) & (F.col("crop_height") > 0)
    )
    out = {
        "text_x1": left,
        "text_y1": top,
        "text_x2": F.greatest(left + 3, F.least(right, x2)),
        "text_y2": F.greatest(top + 3, F.least(bottom, y1 + jersey_h)),
    }
    return df.filter(usable).withColumns(out)


def best_ocr(df: DataFrame, min_confidence: float = JERSEY.min_ocr_confidence) -> DataFrame:
    """Per crop, the most confident text with digits; the first wins a tie.

    The winner is chosen before it is checked as a shirt number, so a crop whose
    best text is out of range has no number even if a weaker text would fit.
    """
    def digits(r):
        return digits_of(r["text"])

    usable = F.filter(
        "results",
        lambda r: (r["conf"] >= F.lit(min_confidence))
        & (F.length(digits(r)) > 0) & (r["conf"] > 0),
    )
    ranked = F.transform(
        usable,
        lambda r, i: F.struct(r["conf"].alias("conf"), (-i).alias("order"), digits(r).alias("text")),
    )
    out = df.withColumn("__best", F.array_max(ranked)).withColumn(
        "jersey_number", clean_jersey(F.col("__best.text"))
    )
    return out.withColumns(
        {
            "best_text": F.when(F.col("jersey_number").isNotNull(), F.col("__best.text")),
            "confidence": F.when(
                F.col("jersey_number").isNotNull(), F.col("__best.conf")
            ).otherwise(0.0),
        }
    ).drop("__best")


def attach_player_ids(tracks: DataFrame, ids: DataFrame, keys=TRACK) -> DataFrame:
    """Put each track's number beside its rows; a missing one shows as unknown."""
    out = tracks.join(ids.select(*keys, "jersey_number"), list(keys), "left")
    label = track_label(F.col("track_id"), F.col("jersey_number"))
    return out.withColumns(
        {"label": label, "jersey_number": F.coalesce("jersey_number", F.lit(UNKNOWN))}
    )


def attach_ocr(crops: DataFrame, readings: DataFrame) -> DataFrame:
    """Bring OCR results back to their crops by key (video, frame, track)."""
    return crops.join(readings, ["video_id", "frame_idx", "track_id"], "left")


def recent_measurements(
    df: DataFrame, n: int = JERSEY.window, keys=TRACK, order=("frame_idx", "seq"),
    settings: JerseyDefaults = JERSEY,
) -> DataFrame:
    """The newest ``n`` readings per track with their ``age_weight`` (oldest .5 → newest 1)."""
    held = F.count("*").over(W.partitionBy(*keys))
    factor = (held - F.col("age")) / F.greatest(F.lit(1), held - 1)
    span = settings.weight_recent - settings.weight_old
    return newest(df, keys, order, n).withColumn(
        "age_weight", F.lit(settings.weight_old) + F.lit(span) * factor
    )


def jersey_scores(
    df: DataFrame, n: int = JERSEY.window, keys=TRACK, order=("frame_idx", "seq"),
    settings: JerseyDefaults = JERSEY,
) -> DataFrame:
    """Weighted score and share of each number over a track's newest readings.

    Shares are rounded to 12 places: equal ones are equal in whatever order the weights were added.
    """
    readings = recent_measurements(
        df.filter(F.col("jersey_number").isNotNull()), n, keys, order, settings
    )
    weight = (
        F.col("confidence")
        * spatial_weight(F.col("center_x"), settings.center_width, settings.center_bonus)
        * F.col("age_weight")
    )
    scores = readings.groupBy(*keys, "jersey_number").agg(
        F.sum(weight).alias("score"), F.count("*").alias("measurement_count")
    )
    total = F.sum("score").over(W.partitionBy(*keys))
    return scores.withColumn(
        "probability", F.when(total > 0, F.round(F.col("score") / total, 12)).otherwise(0.0)
    )


def top_jerseys(probabilities: DataFrame, k: int = 3, keys=TRACK) -> DataFrame:
    """The ``k`` most probable numbers per track with their ``rank``."""
    w = W.partitionBy(*keys).orderBy(F.col("probability").desc(), "jersey_number")
    return probabilities.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def jersey_table(probabilities: DataFrame, keys=TRACK, show_above: float = 0.1) -> DataFrame:
    """One row per track: best number with its band, and the second if it is likely enough."""
    top = top_jerseys(probabilities, 2, keys)

    def at(rank, column):
        return F.max(F.when(F.col("rank") == rank, F.col(column)))

    out = top.groupBy(*keys).agg(
        at(1, "jersey_number").alias("best_jersey"),
        at(1, "probability").alias("best_probability"),
        at(2, "jersey_number").alias("second_jersey"),
        at(2, "probability").alias("second_probability"),
    )
    shown = F.col("second_probability") > show_above
    return out.withColumns(
        {
            "band": jersey_band(F.col("best_probability")),
            "second_jersey": F.when(shown, F.col("second_jersey")),
            "second_probability": F.when(shown, F.col("second_probability")),
        }
    )


def primary_jersey(
    df: DataFrame, threshold: float = JERSEY.primary_probability
) -> DataFrame:
    """The tracked number where it is likely, else the number read in this frame."""
    return df.withColumn(
        "primary_jersey",
        F.when(
            F.col("tracked_jersey").isNotNull() & (F.col("tracked_probability") > threshold),
            F.col("tracked_jersey"),
        ).otherwise(F.col("frame_jersey")),
    )


def jersey_stats(
    measurements: DataFrame, probabilities: DataFrame, n: int = JERSEY.window, keys=TRACK
) -> DataFrame:
    """One row: tracks, readings held, probability entries and their averages per track."""
    held = measurements.groupBy(*keys).agg(F.least(F.count("*"), F.lit(n)).alias("held"))
    counted = held.select(F.lit(1).alias("track"), "held", F.lit(0).alias("entry")).unionByName(
        probabilities.select(F.lit(0).alias("track"), F.lit(0).cast("bigint").alias("held"),
                             F.lit(1).alias("entry"))
    )
    totals = counted.agg(
        *[
            F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(name)
            for c, name in (("track", "total_tracks"), ("held", "total_measurements"),
                            ("entry", "total_probabilities"))
        ]
    )
    per_track = F.greatest(F.lit(1), F.col("total_tracks"))
    return totals.withColumns(
        {
            "avg_measurements_per_track": F.col("total_measurements") / per_track,
            "avg_probabilities_per_track": F.col("total_probabilities") / per_track,
        }
    )


class JerseyFusion:
    """Running fusion of one track's readings: those of the window and the live numbers.

    ``window`` lists the newest readings (number, weight), oldest first; ``live`` maps a number to
    its probability, the frame it was last in the window, and its readings there at that time.
    """

    BLOCK = 512  # readings taken at once

    def __init__(self, settings: JerseyDefaults = JERSEY, window=(), live=None):
        self.settings, self.window, self.live = settings, list(window), dict(live or {})

    def take(self, frames, numbers, weights) -> None:
        """Take readings in order; a weight is confidence × spatial weight."""
        for k in range(0, len(frames), self.BLOCK):
            at = slice(k, k + self.BLOCK)
            self._block(np.asarray(frames[at], np.int64), list(numbers[at]), np.asarray(weights[at], float))

    def _block(self, frames: np.ndarray, numbers: list[str], weights: np.ndarray) -> None:
        s = self.settings
        held = self.window[len(self.window) - s.window + 1 :] if len(self.window) >= s.window else self.window
        names = list(dict.fromkeys([*self.live, *(n for n, _ in held), *numbers]))
        place = {n: k for k, n in enumerate(names)}
        codes = np.array([place[n] for n in (*(n for n, _ in held), *numbers)])
        shares, counts = self._shares(codes, np.r_[[w for _, w in held], weights], len(held), len(names))
        self.window = [*held, *zip(numbers, weights.tolist())][-s.window :]

        start = [self.live.get(n, (0.0, 0, 0)) for n in names]
        p, seen, count = (np.array(x, t) for x, t in zip(zip(*start), (float, np.int64, np.int64)))
        alive = np.array([n in self.live for n in names])
        for frame, share, times in zip(frames, shares, counts):
            fresh = (times > 0) & ~np.isnan(share)
            p = np.where(fresh, np.where(alive, p + s.smoothing * (share - p), share), p)
            seen, count, alive = np.where(fresh, frame, seen), np.where(fresh, times, count), alive | fresh
            gone = frame - seen
            p = p * np.where(alive & (gone > 0), s.decay**gone, 1.0)
            alive &= (gone <= 0) | (p >= s.min_probability)
            p = np.where(alive, p, 0.0)
            p = p / (p.sum() or 1.0)
        kept = np.flatnonzero(alive)
        self.live = {names[k]: (float(p[k]), int(seen[k]), int(count[k])) for k in kept}

    def _shares(self, codes: np.ndarray, weights: np.ndarray, held: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Each number's share of the weight, and its readings, in the window that ends at each
        reading after the first ``held``. Weights rise evenly from the oldest to the newest; a
        window without weight has no shares (NaN)."""
        s = self.settings
        rows = np.arange(len(codes) - held)
        size = np.minimum(held + rows + 1, s.window)
        score, count = np.zeros((len(rows), n)), np.zeros((len(rows), n), np.int64)
        for back in range(s.window):
            r = rows[size > back]
            at = held + r - back
            rise = (size[r] - 1 - back) / np.maximum(1, size[r] - 1)
            score[r, codes[at]] += weights[at] * (s.weight_old + (s.weight_recent - s.weight_old) * rise)
            count[r, codes[at]] += 1
        total = score.sum(1, keepdims=True)
        return np.divide(score, total, out=np.full_like(score, np.nan), where=total > 0), count


def _weighted(df: DataFrame, settings: JerseyDefaults) -> DataFrame:
    weight = F.col("confidence") * spatial_weight(
        F.col("center_x"), settings.center_width, settings.center_bonus
    )
    return df.filter(F.col("jersey_number").isNotNull()).withColumn("weight", weight)


FUSED = (
    "video_id BIGINT, track_id BIGINT, jersey_number STRING, probability DOUBLE, "
    "last_seen_frame BIGINT, measurement_count BIGINT"
)


def fuse_jerseys(df: DataFrame, settings: JerseyDefaults = JERSEY) -> DataFrame:
    """Sequential fusion of each track's readings, in (frame, seq) order.

    Every reading smooths, decays, prunes and renormalises the probabilities, so
    the fold itself cannot be reordered. A track streams through in Arrow batches: shares of the
    window are worked out for a block of readings at once, and only the short recurrence over
    them goes step by step. What is held is 30 readings and the live numbers.
    """

    def fold(key: tuple, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = JerseyFusion(settings)
        for pdf in batches:
            state.take(pdf["frame_idx"].to_numpy(), pdf["jersey_number"].tolist(), pdf["weight"].to_numpy())
        yield pd.DataFrame(
            [(*key, n, *entry) for n, entry in state.live.items()],
            columns=[
                "video_id", "track_id", "jersey_number", "probability",
                "last_seen_frame", "measurement_count",
            ],
        )

    # Sorting first satisfies the grouping's own ordering, so batches arrive in frame order.
    readings = _weighted(df, settings).select(
        "video_id", "track_id", "frame_idx", "seq", "jersey_number", "weight"
    )
    ordered = spread(readings, "video_id", "track_id").sortWithinPartitions(
        "video_id", "track_id", "frame_idx", "seq"
    )
    return ordered.groupBy("video_id", "track_id").applyInPandas(fold, FUSED)
