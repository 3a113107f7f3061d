"""Calibrations (plane homographies): choice, projection and scoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import projective as pj
from ..settings import CALIBRATION, SEARCH, CalibrationDefaults
from .detections import foot_point
from .ordered import carry_forward, running_max
from .support import salted_join, spread

CANDIDATE = ("video_id", "cand_id")


def normalize_payload(df: DataFrame) -> DataFrame:
    """Flat ``h00…h21`` from records that hold them nested, flat, or partly missing.

    A missing parameter takes the identity's value.
    """
    identity = {"h00": 1.0, "h11": 1.0}

    def value(c):
        found = []
        if "homography_parameters" in df.columns:
            inner = df.schema["homography_parameters"].dataType.fieldNames()
            if c.upper() in inner:
                found.append(F.col(f"homography_parameters.{c.upper()}"))
        if c in [name.lower() for name in df.columns]:
            found.append(F.col(c))
        return F.coalesce(*[v.cast("double") for v in found], F.lit(identity.get(c, 0.0)))

    upper = [c.upper() for c in pj.H_COLUMNS]
    out = df.withColumns({f"__{c}": value(c) for c in pj.H_COLUMNS})
    drop = [c for c in df.columns if c.upper() in upper or c == "homography_parameters"]
    return out.drop(*drop).withColumnsRenamed({f"__{c}": c for c in pj.H_COLUMNS})


def latest_homography(
    registry: DataFrame, videos: DataFrame | None = None, default: dict | None = None
) -> DataFrame:
    """Newest calibration per video; with ``videos``, those without one get ``default``."""
    payload = F.struct("created_at", "frame_index", *pj.H_COLUMNS)
    newest = registry.groupBy("video_id").agg(F.max(payload).alias("n")).select(
        "video_id", "n.*"
    )
    if videos is None:
        return newest
    out = videos.select("video_id").distinct().join(newest, "video_id", "left")
    values = default or {"h00": 1.0, "h11": 1.0}
    missing = F.col("created_at").isNull()
    return out.withColumns(
        {c: F.when(missing, F.lit(float(values.get(c, 0.0)))).otherwise(F.col(c))
         for c in pj.H_COLUMNS}
    ).withColumn("is_default", missing)


def homography_asof(
    frames: DataFrame, registry: DataFrame, default: dict | None = None, chunk: Column | None = None
) -> DataFrame:
    """The newest calibration at or before each frame of its video, else the default.

    Of two calibrations on one frame, the later ``created_at`` counts.
    """
    values = default or {"h00": 1.0, "h11": 1.0}
    payload = [c for c in frames.columns if c not in ("video_id", "frame_idx")]
    rows = frames.select(
        "video_id", "frame_idx", F.lit(1).alias("__kind"),
        F.lit(None).cast("timestamp").alias("__at"),
        F.lit(None).cast(_h_struct()).alias("h"),
        F.struct(*payload, F.lit(True).alias("__row")).alias("__payload"),
    )
    marks = registry.select(
        "video_id", F.col("frame_index").alias("frame_idx"), F.lit(0).alias("__kind"),
        F.col("created_at").cast("timestamp").alias("__at"),
        F.struct(*pj.H_COLUMNS).alias("h"),
        F.lit(None).cast(rows.schema["__payload"].dataType).alias("__payload"),
    )
    both = rows.unionByName(marks)
    d = carry_forward(both, ["video_id"], ["frame_idx", "__kind", "__at"], ["h"], "asof_", chunk)
    d = d.filter(F.col("__kind") == 1)
    found = F.col("asof_h").isNotNull()
    return d.select(
        "video_id", "frame_idx", *[F.col(f"__payload.{c}").alias(c) for c in payload],
        *[F.when(found, F.col(f"asof_h.{c}")).otherwise(float(values.get(c, 0.0))).alias(c)
          for c in pj.H_COLUMNS],
        (~found).alias("is_default"),
    )


def _h_struct() -> str:
    return "struct<" + ",".join(f"{c}:double" for c in pj.H_COLUMNS) + ">"


def project_to_field(
    tracks: DataFrame, homographies: DataFrame, width: int, height: int
) -> DataFrame:
    """Foot of each track row in canvas pixels; rows that fall outside are dropped."""
    h = homographies.select("video_id", *pj.H_COLUMNS)
    d = foot_point(tracks).join(h, "video_id")
    # The projection uses the unrounded bottom centre of the whole-pixel box.
    x = (F.col("x1").cast("int") + F.col("x2").cast("int")) / 2
    px, py = pj.project(pj.matrix(), x, F.col("y2").cast("int"))
    d = d.withColumns({"field_x": px.cast("int"), "field_y": py.cast("int")})
    return d.filter(
        pj.within(F.col("field_x"), F.col("field_y"), width, height)
    ).drop(*pj.H_COLUMNS)


def project_lines(lines: DataFrame, homographies: DataFrame, on=("video_id",)) -> DataFrame:
    """Both ends of each line through the calibration; a line with an end at infinity is dropped."""
    d = lines.join(homographies.select(*on, *pj.H_COLUMNS), list(on))
    h = pj.matrix()
    ax, ay = pj.project(h, F.col("x1"), F.col("y1"))
    bx, by = pj.project(h, F.col("x2"), F.col("y2"))
    out = {"field_x1": ax, "field_y1": ay, "field_x2": bx, "field_y2": by}
    out = {c: v.cast("int") for c, v in out.items()}
    return d.withColumns(out).filter(
        F.col("field_x1").isNotNull() & F.col("field_x2").isNotNull()
    ).drop(*pj.H_COLUMNS)


def project_contours(points: DataFrame, homographies: DataFrame, on=("video_id",)) -> DataFrame:
    d = points.join(homographies.select(*on, *pj.H_COLUMNS), list(on))
    px, py = pj.project(pj.matrix(), F.col("x"), F.col("y"))
    return d.withColumns({"field_x": px.cast("int"), "field_y": py.cast("int")}).drop(
        *pj.H_COLUMNS
    )


def canvas_size(
    df: DataFrame, buffer_factor: float = CALIBRATION.buffer_factor,
    aspect_ratio: float = CALIBRATION.aspect_ratio,
) -> DataFrame:
    w, h = pj.canvas(F.col("width"), F.col("height"), buffer_factor, aspect_ratio)
    return df.withColumns({"canvas_width": w.cast("bigint"), "canvas_height": h.cast("bigint")})


# Candidate scoring -----------------------------------------------------------------------


def candidate_lines(
    candidates: DataFrame, lines: DataFrame, keys=CANDIDATE, salts: int = 8
) -> DataFrame:
    """Each candidate with each line of its own video, ends projected."""
    facts = lines.select(
        "video_id", *[F.col(c).alias(f"l_{c}") for c in ("x1", "y1", "x2", "y2")],
        F.col("confidence").alias("l_confidence"),
    )
    small = candidates.select(*keys, *pj.H_COLUMNS)
    d = salted_join(facts, small, ["video_id"], salts=salts)
    h = pj.matrix()
    ax, ay = pj.project(h, F.col("l_x1"), F.col("l_y1"))
    bx, by = pj.project(h, F.col("l_x2"), F.col("l_y2"))
    return d.select(
        *keys, "l_confidence", ax.alias("ax"), ay.alias("ay"), bx.alias("bx"), by.alias("by")
    )


def _line_terms(width: int, height: int, s: CalibrationDefaults) -> dict[str, Column]:
    ax, ay, bx, by = (F.col(c) for c in ("ax", "ay", "bx", "by"))
    known = ax.isNotNull() & bx.isNotNull()
    start_in, end_in = pj.within(ax, ay, width, height), pj.within(bx, by, width, height)
    dx, dy = bx - ax, by - ay
    length = F.sqrt(dx * dx + dy * dy)
    turn = F.abs(F.degrees(F.atan2(dy, dx)))

    off_vertical = F.least(F.abs(F.lit(90.0) - turn), F.abs(F.lit(270.0) - turn))
    off_horizontal = F.least(turn, F.abs(F.lit(180.0) - turn))
    off = F.least(off_vertical, off_horizontal)
    aligned = F.greatest(F.lit(0.0), F.lit(1.0) - off / F.lit(s.align_tolerance))
    counted = known & start_in & end_in & (length >= s.align_min_length)
    weight = F.when(counted, F.col("l_confidence") * length / F.lit(100.0)).otherwise(0.0)

    outside = (
        (F.least(ax, bx) > width) | (F.greatest(ax, bx) < 0)
        | (F.least(ay, by) > height) | (F.greatest(ay, by) < 0)
    )
    tilt = F.when(turn > 90, F.lit(180.0) - turn).otherwise(turn)
    judged = known & ~outside & (length >= s.orient_min_length)
    upright = judged & (tilt >= 90 - s.orient_tolerance)
    level = judged & ~upright & (tilt <= s.orient_tolerance)
    return {
        "weighted": F.when(counted, weight * aligned).otherwise(0.0),
        "weight": weight,
        "seen": (known & (start_in | end_in)).cast("int"),
        "vertical": upright.cast("int"),
        "horizontal": level.cast("int"),
    }


def line_scores(
    candidates: DataFrame, lines: DataFrame, width: int, height: int, keys=CANDIDATE,
    settings: CalibrationDefaults = CALIBRATION, salts: int = 8,
) -> DataFrame:
    """Alignment, visibility and orientation scores of each candidate, in one pass."""
    d = candidate_lines(candidates, lines, keys, salts)
    terms = _line_terms(width, height, settings)
    d = d.select(*keys, *[F.coalesce(v, F.lit(0)).alias(k) for k, v in terms.items()])
    sums = d.groupBy(*keys).agg(
        F.count("*").alias("lines"), *[F.sum(k).alias(k) for k in terms]
    )
    v, h = F.col("vertical"), F.col("horizontal")

    def bonus(n):
        return F.least(n * F.lit(0.1), F.lit(0.2))

    balance = F.when((v > 0) & (h > 0), F.lit(0.6) + bonus(v) + bonus(h)).otherwise(
        F.lit(-settings.missing_orientation_penalty)
    )
    return sums.select(
        *keys, "lines",
        F.when(F.col("weight") > 0, F.col("weighted") / F.col("weight")).otherwise(0.0)
        .alias("alignment"),
        (F.col("seen") / F.col("lines")).alias("visibility"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), balance)).alias("orientation"),
        v.cast("bigint").alias("vertical_lines"), h.cast("bigint").alias("horizontal_lines"),
    )


def score_alignment(candidates, lines, width, height, keys=CANDIDATE) -> DataFrame:
    return line_scores(candidates, lines, width, height, keys).select(*keys, "lines", "alignment")


def score_visibility(candidates, lines, width, height, keys=CANDIDATE) -> DataFrame:
    return line_scores(candidates, lines, width, height, keys).select(*keys, "lines", "visibility")


def score_orientation(candidates, lines, width, height, keys=CANDIDATE) -> DataFrame:
    return line_scores(candidates, lines, width, height, keys).select(
        *keys, "vertical_lines", "horizontal_lines", "orientation"
    )


def proportion(width: Column, height: Column, s: CalibrationDefaults = CALIBRATION) -> Column:
    off = F.abs(height / width - F.lit(s.expected_ratio))
    return F.greatest(F.lit(0.0), F.lit(1.0) - off / F.lit(s.ratio_tolerance))


def score_proportion(df: DataFrame, width: Column, height: Column) -> DataFrame:
    """How near the canvas is to the shape of a field."""
    return df.withColumn("proportion", proportion(width, height))


def distortion(h: dict[str, Column], s: CalibrationDefaults = CALIBRATION) -> Column:
    perspective = F.sqrt(h["h20"] * h["h20"] + h["h21"] * h["h21"])
    sx = F.sqrt(h["h00"] * h["h00"] + h["h01"] * h["h01"])
    sy = F.sqrt(h["h10"] * h["h10"] + h["h11"] * h["h11"])
    return (
        F.when(F.abs(pj.determinant(h)) < 1e-10, 0.0)
        .when(perspective > s.max_perspective, 0.0)
        .when(~sx.between(0.1, 10.0) | ~sy.between(0.1, 10.0), 0.5)
        .otherwise(1.0)
    )


def score_distortion(candidates: DataFrame) -> DataFrame:
    return candidates.withColumn("distortion", distortion(pj.matrix()))


def coverage_score(share: Column, s: CalibrationDefaults = CALIBRATION) -> Column:
    best = F.lit(s.optimal_coverage)
    over = (share - best) / F.lit(1.0 - s.optimal_coverage)
    return F.when(share <= best, share / best).otherwise(F.lit(1.0) - over * F.lit(0.5))


def score_coverage(
    candidates: DataFrame, frame: tuple[int, int], canvas: tuple[int, int],
    grid: tuple[int, int] = (16, 48), luma: DataFrame | None = None, keys=CANDIDATE,
    luma_cell: int = 120, settings: CalibrationDefaults = CALIBRATION,
) -> DataFrame:
    """How near the lit share of the canvas is to the optimum.

    Without ``luma`` the share is the exact area of the frame's image on the canvas, worked out in
    each row. With ``luma(video_id, cell_x, cell_y, luma)``, the mean brightness of frame cells
    ``luma_cell`` pixels wide, the canvas is sampled at the centres of ``grid`` cells, mapped back
    to the frame, and a sample counts where its cell is brighter than the threshold.
    """
    if luma is None:
        shared = candidates.withColumn("covered", pj.covered_share(pj.matrix(), frame, canvas))
        return shared.withColumn("coverage", coverage_score(F.col("covered"), settings))
    nx, ny = grid
    samples = F.sequence(F.lit(0), F.lit(nx * ny - 1))
    # Candidates are few and their samples many: spread them before sampling.
    d = spread(candidates.select(*keys, *pj.H_COLUMNS), *keys)
    d = d.select(*keys, *pj.H_COLUMNS, F.explode(samples).alias("i"))
    x = (F.col("i") % nx + 0.5) * F.lit(canvas[0] / nx)
    y = (F.floor(F.col("i") / nx) + 0.5) * F.lit(canvas[1] / ny)
    fx, fy = pj.project_back(pj.matrix(), x, y)
    d = d.select(*keys, fx.alias("fx"), fy.alias("fy"))
    d = d.filter(pj.within(F.col("fx"), F.col("fy"), *frame))
    d = d.withColumns(
        {"cell_x": F.floor(F.col("fx") / luma_cell).cast("int"),
         "cell_y": F.floor(F.col("fy") / luma_cell).cast("int")}
    )
    lit_cells = luma.filter(F.col("luma") > settings.luma_threshold).select(
        "video_id", F.col("cell_x").cast("int"), F.col("cell_y").cast("int")
    )
    d = d.join(lit_cells, ["video_id", "cell_x", "cell_y"], "left_semi")
    share = d.groupBy(*keys).agg((F.count("*") / F.lit(float(nx * ny))).alias("covered"))
    return (
        candidates.join(share, list(keys), "left")
        .withColumn("covered", F.coalesce("covered", F.lit(0.0)))
        .withColumn("coverage", coverage_score(F.col("covered"), settings))
    )


def fitness(s: CalibrationDefaults = CALIBRATION) -> Column:
    total = F.lit(0.0)
    for name, weight in s.weights.items():
        total = total + F.lit(weight) * F.col(name)
    return total


def score_candidates(
    candidates: DataFrame, lines: DataFrame, frame: tuple[int, int] = (1920, 1080),
    keys=CANDIDATE, settings: CalibrationDefaults = CALIBRATION, salts: int = 8,
) -> DataFrame:
    """All six scores and their weighted sum; a video without lines scores 0 on the line ones."""
    canvas = pj.canvas_of(*frame)
    own = score_coverage(score_distortion(candidates), frame, canvas, settings=settings)
    own = score_proportion(own, F.lit(canvas[0]), F.lit(canvas[1]))
    by_line = line_scores(candidates, lines, *canvas, keys, settings, salts).select(
        *keys, "alignment", "visibility", "orientation"
    )
    d = own.join(by_line, list(keys), "left")
    d = d.withColumns(
        {c: F.coalesce(c, F.lit(0.0)) for c in ("alignment", "visibility", "orientation")}
    )
    return d.withColumn("fitness", fitness(settings))


def population_stats(scored: DataFrame, keys=("video_id", "generation")) -> DataFrame:
    f = F.col("fitness")
    return scored.groupBy(*keys).agg(
        F.max(f).alias("best_fitness"), F.min(f).alias("worst_fitness"),
        F.avg(f).alias("average_fitness"), F.stddev_pop(f).alias("fitness_std"),
    )


def best_so_far(
    scored: DataFrame, goal: float = SEARCH.fitness_goal,
    max_generations: int = SEARCH.max_generations, keys=("video_id",),
) -> DataFrame:
    """Best fitness up to each generation, and whether the search would stop there."""
    keys = list(keys)
    per_generation = scored.groupBy(*keys, "generation").agg(F.max("fitness").alias("fitness"))
    d = running_max(per_generation, keys, ["generation"], "fitness", "best_fitness")
    return d.withColumn(
        "converged", (F.col("best_fitness") >= goal) | (F.col("generation") >= max_generations)
    )


def rank_candidates(
    scored: DataFrame, elites: int = SEARCH.elites, keys=("video_id",), top: int | None = None
) -> DataFrame:
    """Rank by fitness within each video (ties to the lower id); mark the elites."""
    w = W.partitionBy(*keys).orderBy(F.col("fitness").desc(), "cand_id")
    d = scored.withColumn("rank", F.row_number().over(w))
    if top is not None:
        d = d.filter(F.col("rank") <= top)
    return d.withColumn("elite", F.col("rank") <= elites)
