"""Queries over calibrations: choice, projection, scoring, search."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from ..functions.projective import H_COLUMNS
from ..operators import calibration as cal
from ..operators.search import search_homographies
from ..settings import SEARCH
from .catalog import CANVAS, FRAME, big, query, r6, raw, sql_big, sql_project, sql_r6, table, view
from .identity_queries import PLACED, REGISTRY_NEWEST

H = view("homographies")
L = view("field_lines")
R = view("registry")
CAND = ["video_id", "cand_id"]
HS = ", ".join(H_COLUMNS)


@query(
    "normalize_payload",
    """SELECT event_id, CASE event_id % 3 WHEN 0 THEN value WHEN 1 THEN value + 1 ELSE 1.0 END AS h00,
    CASE event_id % 3 WHEN 2 THEN 0.0 ELSE value / 2 END AS h02 FROM events""",
)
def _(spark, sf):
    n, v = F.col("event_id") % 3, F.col("value")
    nested = F.when(n == 0, F.struct(v.alias("H00"), (v / 2).alias("H02")))
    d = raw(spark, sf, "events").select(
        "event_id", nested.alias("homography_parameters"),
        F.when(n == 1, v + 1).alias("h00"), F.when(n == 1, v / 2).alias("h02"),
    )
    return cal.normalize_payload(d).select("event_id", "h00", "h02")


@query("latest_homography", f"SELECT video_id, frame_index, created_at, {HS} FROM {REGISTRY_NEWEST}")
def _(spark, sf):
    return cal.latest_homography(table(spark, sf, "registry")).select(
        "video_id", "frame_index", "created_at", *H_COLUMNS
    )


@query(
    "latest_homography_default",
    f"""SELECT v.video_id, r.created_at IS NULL AS is_default, coalesce(r.h00, 1) AS h00, coalesce(r.h01, 0) AS h01, coalesce(r.h02, 0) AS h02
    FROM {view('videos')} v LEFT JOIN {REGISTRY_NEWEST} r USING (video_id)""",
)
def _(spark, sf):
    d = cal.latest_homography(table(spark, sf, "registry"), table(spark, sf, "videos"))
    return d.select("video_id", "is_default", "h00", "h01", "h02")


@query(
    "homography_asof",
    f"""WITH r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY video_id, frame_index ORDER BY created_at DESC) AS n FROM {R}) WHERE n = 1)
    SELECT t.video_id, t.frame_idx, t.seq, r.video_id IS NULL AS is_default, coalesce(r.h00, 1) AS h00, coalesce(r.h01, 0) AS h01,
    coalesce(r.h12, 0) AS h12 FROM {view('tracks')} t ASOF LEFT JOIN r ON t.video_id = r.video_id AND t.frame_idx >= r.frame_index""",
)
def _(spark, sf):
    frames = table(spark, sf, "tracks").select("video_id", "frame_idx", "seq")
    return cal.homography_asof(frames, table(spark, sf, "registry")).select(
        "video_id", "frame_idx", "seq", "is_default", "h00", "h01", "h12"
    )


@query("project_to_field", f"SELECT video_id, seq, track_id, {sql_big('field_x', 'field_y')} FROM {PLACED}")
def _(spark, sf):
    d = cal.project_to_field(
        table(spark, sf, "tracks"), cal.latest_homography(table(spark, sf, "registry")), *CANVAS
    )
    return d.select("video_id", "seq", "track_id", *big("field_x", "field_y"))


ENDS = ("field_x1", "field_y1", "field_x2", "field_y2")


@query(
    "project_lines",
    f"""SELECT line_idx, {', '.join(f'CAST(trunc({s}) AS BIGINT) AS {d}' for s, d in zip(('a_x', 'a_y', 'b_x', 'b_y'), ENDS))} FROM
    (SELECT l.line_idx, {sql_project('l.x1', 'l.y1', out='a')}, {sql_project('l.x2', 'l.y2', out='b')}
    FROM {L} l JOIN {REGISTRY_NEWEST} h USING (video_id)) WHERE a_x IS NOT NULL AND b_x IS NOT NULL""",
)
def _(spark, sf):
    d = cal.project_lines(
        table(spark, sf, "field_lines"), cal.latest_homography(table(spark, sf, "registry"))
    )
    return d.select("line_idx", *big(*ENDS))


@query(
    "project_contours",
    f"""SELECT video_id, frame_idx, CAST(contour_id AS BIGINT) AS contour_id, pt_idx, CAST(trunc(p_x) AS BIGINT) AS field_x, CAST(trunc(p_y) AS BIGINT) AS field_y
    FROM (SELECT c.*, {sql_project('c.x', 'c.y')} FROM {view('contour_points')} c JOIN {REGISTRY_NEWEST} h USING (video_id))""",
)
def _(spark, sf):
    d = cal.project_contours(
        table(spark, sf, "contour_points"), cal.latest_homography(table(spark, sf, "registry"))
    )
    return d.select("video_id", "frame_idx", *big("contour_id"), "pt_idx", *big("field_x", "field_y"))


@query(
    "canvas_size",
    f"""SELECT video_id, CAST(canvas_width AS BIGINT) AS canvas_width, CAST(floor(canvas_width * 3.0::DOUBLE) AS BIGINT) AS canvas_height
    FROM (SELECT video_id, floor(sqrt(floor(width * height * 1.8::DOUBLE) / 3.0::DOUBLE)) AS canvas_width FROM {view('videos')})""",
)
def _(spark, sf):
    return cal.canvas_size(table(spark, sf, "videos")).select(
        "video_id", "canvas_width", "canvas_height"
    )


W, HT = CANVAS
PAIRS = f"""(SELECT h.video_id, h.cand_id, l.confidence, {sql_project('l.x1', 'l.y1', out='a')}, {sql_project('l.x2', 'l.y2', out='b')}
FROM {H} h JOIN {L} l USING (video_id))"""
TERMS = f"""(SELECT *, a_x >= 0 AND a_x < {W} AND a_y >= 0 AND a_y < {HT} AS a_in, b_x >= 0 AND b_x < {W} AND b_y >= 0 AND b_y < {HT} AS b_in,
sqrt((b_x - a_x) * (b_x - a_x) + (b_y - a_y) * (b_y - a_y)) AS len, abs(degrees(atan2(b_y - a_y, b_x - a_x))) AS turn FROM {PAIRS})"""
ALIGN = f"""(SELECT video_id, cand_id, count(*) AS lines, coalesce(sum(CASE WHEN a_in AND b_in AND len >= 10 THEN confidence * len / 100 *
CASE WHEN least(abs(90 - turn), abs(270 - turn)) <= least(turn, abs(180 - turn)) THEN greatest(0, 1 - least(abs(90 - turn), abs(270 - turn)) / 5.0::DOUBLE)
ELSE greatest(0, 1 - least(turn, abs(180 - turn)) / 5.0::DOUBLE) END END)
/ nullif(sum(CASE WHEN a_in AND b_in AND len >= 10 THEN confidence * len / 100 END), 0), 0) AS alignment,
count(*) FILTER (a_in OR b_in) / count(*) AS visibility,
count(*) FILTER (ok AND tilt >= 75) AS vertical_lines, count(*) FILTER (ok AND tilt < 75 AND tilt <= 15) AS horizontal_lines
FROM (SELECT *, CASE WHEN turn > 90 THEN 180 - turn ELSE turn END AS tilt, a_x IS NOT NULL AND b_x IS NOT NULL AND len >= 20 AND NOT
(least(a_x, b_x) > {W} OR greatest(a_x, b_x) < 0 OR least(a_y, b_y) > {HT} OR greatest(a_y, b_y) < 0) AS ok FROM {TERMS}) GROUP BY 1, 2)"""
LINE_SCORES = f"""(SELECT *, CASE WHEN vertical_lines > 0 AND horizontal_lines > 0 THEN least(1, 0.6::DOUBLE + least(vertical_lines * 0.1::DOUBLE, 0.2::DOUBLE)
+ least(horizontal_lines * 0.1::DOUBLE, 0.2::DOUBLE)) ELSE 0 END AS orientation FROM {ALIGN})"""


def _candidates(spark, sf):
    return table(spark, sf, "homographies"), table(spark, sf, "field_lines")


@query(
    "candidate_lines",
    f"SELECT video_id, cand_id, {', '.join(f'round({s}, 6) AS {d}' for s, d in zip(('a_x', 'a_y', 'b_x', 'b_y'), ('ax', 'ay', 'bx', 'by')))} FROM {PAIRS}",
)
def _(spark, sf):
    return cal.candidate_lines(*_candidates(spark, sf)).select(*CAND, *r6("ax", "ay", "bx", "by"))


@query("score_alignment", f"SELECT video_id, cand_id, lines, round(alignment, 6) AS alignment FROM {LINE_SCORES}")
def _(spark, sf):
    return cal.score_alignment(*_candidates(spark, sf), *CANVAS).select(*CAND, "lines", *r6("alignment"))


@query("score_visibility", f"SELECT video_id, cand_id, lines, round(visibility, 6) AS visibility FROM {LINE_SCORES}")
def _(spark, sf):
    return cal.score_visibility(*_candidates(spark, sf), *CANVAS).select(*CAND, "lines", *r6("visibility"))


@query(
    "score_orientation",
    f"SELECT video_id, cand_id, vertical_lines, horizontal_lines, round(orientation, 6) AS orientation FROM {LINE_SCORES}",
)
def _(spark, sf):
    return cal.score_orientation(*_candidates(spark, sf), *CANVAS).select(
        *CAND, "vertical_lines", "horizontal_lines", *r6("orientation")
    )


@query(
    "score_proportion",
    f"SELECT video_id, round(greatest(0, 1 - abs(height * 4.8::DOUBLE / width - 2.7::DOUBLE) / 0.5::DOUBLE), 6) AS proportion FROM {view('videos')}",
)
def _(spark, sf):
    d = cal.score_proportion(table(spark, sf, "videos"), F.col("width"), F.col("height") * 4.8)
    return d.select("video_id", *r6("proportion"))


DISTORTION = """CASE WHEN abs(h00 * (h11 - h12 * h21) - h01 * (h10 - h12 * h20) + h02 * (h10 * h21 - h11 * h20)) < 1e-10 THEN 0.0::DOUBLE
WHEN sqrt(h20 * h20 + h21 * h21) > 0.2 THEN 0.0::DOUBLE
WHEN sqrt(h00 * h00 + h01 * h01) NOT BETWEEN 0.1 AND 10 OR sqrt(h10 * h10 + h11 * h11) NOT BETWEEN 0.1 AND 10 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END"""


@query(
    "score_distortion",
    f"SELECT video_id, cand_id, {DISTORTION} AS distortion FROM (SELECT video_id, cand_id, h00 * (cand_id % 13) AS h00, h01, h02, h10, h11, h12, h20 * (1 + cand_id % 7 * 300) AS h20, h21 FROM {H})",
)
def _(spark, sf):
    n = F.col("cand_id")
    d = table(spark, sf, "homographies").withColumns(
        {"h00": F.col("h00") * (n % 13), "h20": F.col("h20") * (1 + n % 7 * 300)}
    )
    return cal.score_distortion(d).select(*CAND, "distortion")


BACK_X = ("h11 - h12 * h21", "h02 * h21 - h01", "h01 * h12 - h02 * h11")
BACK_Y = ("h12 * h20 - h10", "h00 - h02 * h20", "h02 * h10 - h00 * h12")
BACK_W = ("h10 * h21 - h11 * h20", "h01 * h20 - h00 * h21", "h00 * h11 - h01 * h10")
BORDERS = (BACK_X, [f"{FRAME[0]} * ({w}) - ({p})" for p, w in zip(BACK_X, BACK_W)],
           BACK_Y, [f"{FRAME[1]} * ({w}) - ({p})" for p, w in zip(BACK_Y, BACK_W)])
# The frame and the canvas as half-planes a x + b y + c >= 0, once for either side of the horizon.
PLANES = f"""(SELECT video_id, cand_id, side, unnest(range(8)) AS n, unnest([{', '.join(f'side * ({b[0]})' for b in BORDERS)}, 1, -1, 0, 0]) AS a,
unnest([{', '.join(f'side * ({b[1]})' for b in BORDERS)}, 0, 0, 1, -1]) AS b,
unnest([{', '.join(f'side * ({b[2]})' for b in BORDERS)}, 0, {W}, 0, {HT}]) AS c FROM {H}, (VALUES (1.0::DOUBLE), (-1.0::DOUBLE)) s(side))"""
# The area by strips between the heights where two borders cross: a strip's width is linear in y.
COVERED = f"""(WITH h AS MATERIALIZED (SELECT * FROM {PLANES}),
ys AS (SELECT DISTINCT p.video_id, p.cand_id, p.side, (q.a * p.c - p.a * q.c) / (p.a * q.b - q.a * p.b) AS y
FROM h p JOIN h q ON p.video_id = q.video_id AND p.cand_id = q.cand_id AND p.side = q.side AND p.n < q.n WHERE p.a * q.b - q.a * p.b <> 0),
strips AS (SELECT *, lead(y) OVER (PARTITION BY video_id, cand_id, side ORDER BY y) AS top FROM ys WHERE y BETWEEN 0 AND {HT}),
widths AS (SELECT s.video_id, s.cand_id, s.side, s.y, s.top, min(CASE WHEN a < 0 THEN -(b * (y + top) / 2 + c) / a END) - max(CASE WHEN a > 0 THEN -(b * (y + top) / 2 + c) / a END) AS width,
bool_or(a = 0 AND b * (y + top) / 2 + c < 0) AS outside
FROM strips s JOIN h USING (video_id, cand_id, side) WHERE top IS NOT NULL GROUP BY ALL)
SELECT video_id, cand_id, sum(CASE WHEN outside THEN 0 ELSE greatest(width, 0) * (top - y) END) / {W * HT}.0::DOUBLE AS covered FROM widths GROUP BY 1, 2)"""
SHARE_SCORE = "CASE WHEN covered <= 0.75::DOUBLE THEN covered / 0.75::DOUBLE ELSE 1 - (covered - 0.75::DOUBLE) / 0.25::DOUBLE * 0.5::DOUBLE END"
COVERAGE = f"(SELECT *, {SHARE_SCORE} AS coverage FROM {COVERED})"


@query("score_coverage", f"SELECT video_id, cand_id, {sql_r6('covered', 'coverage')} FROM {COVERAGE}")
def _(spark, sf):
    d = cal.score_coverage(table(spark, sf, "homographies"), FRAME, CANVAS)
    return d.select(*CAND, *r6("covered", "coverage"))


# Brightness of frame cells: what field lines start in a cell, at most 50 each.
LUMA = f"""(SELECT video_id, CAST(floor(x1 / 120) AS INT) AS cell_x, CAST(floor(y1 / 120) AS INT) AS cell_y, max(confidence * 50) AS luma FROM {L} GROUP BY 1, 2, 3)"""
BACK = {n: f"(({a}) * cx + ({b}) * cy + ({c}))" for n, (a, b, c) in zip("xyw", (BACK_X, BACK_Y, BACK_W))}
LIT = f"""(SELECT h.video_id, cand_id, count(luma) / 768.0::DOUBLE AS covered FROM
(SELECT *, {BACK['x']} / nullif({BACK['w']}, 0) AS fx, {BACK['y']} / nullif({BACK['w']}, 0) AS fy FROM
(SELECT *, (i % 16 + 0.5::DOUBLE) * ({W} / 16.0::DOUBLE) AS cx, (i // 16 + 0.5::DOUBLE) * ({HT} / 48.0::DOUBLE) AS cy FROM {H}, range(0, 768) t(i))) h
LEFT JOIN {LUMA} c ON c.video_id = h.video_id AND luma > 10 AND fx >= 0 AND fx < {FRAME[0]} AND fy >= 0 AND fy < {FRAME[1]}
AND cell_x = floor(fx / 120) AND cell_y = floor(fy / 120) GROUP BY 1, 2)"""


@query(
    "score_coverage_lit",
    f"SELECT video_id, cand_id, round(covered, 6) AS covered, round({SHARE_SCORE}, 6) AS coverage FROM {LIT}",
)
def _(spark, sf):
    candidates, lines = _candidates(spark, sf)
    cells = [F.floor(F.col(c) / 120).cast("int").alias(f"cell_{c[0]}") for c in ("x1", "y1")]
    luma = lines.groupBy("video_id", *cells).agg(F.max(F.col("confidence") * 50).alias("luma"))
    return cal.score_coverage(candidates, FRAME, CANVAS, luma=luma).select(*CAND, *r6("covered", "coverage"))


SCORED = f"""(SELECT video_id, cand_id, generation, 0.35::DOUBLE * alignment + 0.2::DOUBLE * coverage + 0.15::DOUBLE * visibility
+ 0.1::DOUBLE * greatest(0, 1 - abs({HT} / {W}.0::DOUBLE - 2.7::DOUBLE) / 0.5::DOUBLE) + 0.05::DOUBLE * distortion + 0.15::DOUBLE * orientation AS fitness
FROM (SELECT video_id, cand_id, generation, {DISTORTION} AS distortion FROM {H}) JOIN {COVERAGE} USING (video_id, cand_id) JOIN {LINE_SCORES} USING (video_id, cand_id))"""


def _scored(spark, sf):
    return cal.score_candidates(*_candidates(spark, sf), FRAME)


@query("score_candidates", f"SELECT video_id, cand_id, round(fitness, 6) AS fitness FROM {SCORED}")
def _(spark, sf):
    return _scored(spark, sf).select(*CAND, *r6("fitness"))


STATS = ("best_fitness", "worst_fitness", "average_fitness", "fitness_std")


@query(
    "population_stats",
    f"""SELECT video_id, generation, round(max(fitness), 6) AS best_fitness, round(min(fitness), 6) AS worst_fitness,
    round(avg(fitness), 6) AS average_fitness, round(stddev_pop(fitness), 6) AS fitness_std FROM {SCORED} GROUP BY 1, 2""",
)
def _(spark, sf):
    return cal.population_stats(_scored(spark, sf)).select("video_id", "generation", *r6(*STATS))


@query(
    "best_so_far",
    f"""SELECT video_id, generation, round(best, 6) AS best_fitness, best >= 0.6 OR generation >= 3 AS converged FROM
    (SELECT video_id, generation, max(max(fitness)) OVER (PARTITION BY video_id ORDER BY generation) AS best FROM {SCORED} GROUP BY 1, 2)""",
)
def _(spark, sf):
    return cal.best_so_far(_scored(spark, sf), 0.6, 3).select(
        "video_id", "generation", *r6("best_fitness"), "converged"
    )


@query(
    "rank_candidates",
    f"""SELECT video_id, cand_id, rank, rank <= 2 AS elite FROM
    (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY fitness DESC, cand_id) AS rank FROM {SCORED})""",
)
def _(spark, sf):
    return cal.rank_candidates(_scored(spark, sf)).select(*CAND, *big("rank"), "elite")


@query(
    "fittest_candidates",
    f"SELECT video_id, cand_id, round(fitness, 6) AS fitness FROM {SCORED} ORDER BY fitness DESC, cand_id LIMIT 10",
)
def _(spark, sf):
    # A top-k report over all videos.
    best = _scored(spark, sf).orderBy(F.col("fitness").desc(), "cand_id").limit(10)
    return best.select(*CAND, *r6("fitness"))


@query("search_homographies")
def _(spark, sf):
    seeds = table(spark, sf, "homographies").groupBy("video_id").agg(
        F.min_by(F.struct(*H_COLUMNS), "cand_id").alias("h")
    ).select("video_id", "h.*")
    # A goal that some videos reach early and others not within five generations.
    goal = replace(SEARCH, fitness_goal=0.58)
    out = search_homographies(seeds, table(spark, sf, "field_lines"), generations=5, settings=goal)
    return out.select(*CAND, "generation", *r6("fitness"))
