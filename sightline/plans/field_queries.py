"""Queries over masks, contours and fitted lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import field as fld
from ..operators import lines as lin
from ..operators.ordered import neighbour_rows
from ..settings import FIELD
from ..sources.records import explode_contours
from .catalog import FRAME, big, query, r6, raw, sql_r6, table, view

C = view("contour_points")
L = view("field_lines")
KEY = ["video_id", "frame_idx"]
CONTOUR = [*KEY, "contour_id"]
S_CONTOUR = "video_id, frame_idx, CAST(contour_id AS BIGINT) AS contour_id"

# Runs that occur twice count once: of two equal ones only the first would begin an island, and the
# second window may take them the other way round.
ISLANDS = f"""(SELECT video_id, frame_idx, y, min(x_start) AS x_start, max(x_end) AS x_end FROM
(SELECT *, sum(fresh) OVER (PARTITION BY video_id, frame_idx, y ORDER BY x_start, x_end ROWS UNBOUNDED PRECEDING) AS island FROM
(SELECT *, CASE WHEN x_start <= max(x_end) OVER (PARTITION BY video_id, frame_idx, y ORDER BY x_start, x_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
THEN 0 ELSE 1 END AS fresh FROM (SELECT DISTINCT video_id, frame_idx, y, x_start, x_end FROM {view('mask_runs')}))) GROUP BY video_id, frame_idx, y, island)"""


@query(
    "union_masks",
    f"SELECT video_id, frame_idx, CAST(y AS BIGINT) AS y, CAST(x_start AS BIGINT) AS x_start, CAST(x_end AS BIGINT) AS x_end FROM {ISLANDS}",
)
def _(spark, sf):
    return fld.union_masks(table(spark, sf, "mask_runs")).select(*KEY, *big("y", "x_start", "x_end"))


@query(
    "mask_area",
    f"SELECT video_id, frame_idx, CAST(sum(x_end - x_start) AS BIGINT) AS area FROM {ISLANDS} GROUP BY 1, 2",
)
def _(spark, sf):
    return fld.mask_area(table(spark, sf, "mask_runs"))


# Stated pixel by pixel, unlike the merge of runs it checks.
@query(
    "class_shares",
    f"""SELECT *, round(area / sum(area) OVER (PARTITION BY video_id, frame_idx), 6) AS share FROM
    (SELECT video_id, frame_idx, class_id, CAST(count(*) AS BIGINT) AS area FROM
    (SELECT DISTINCT video_id, frame_idx, CAST(class_id AS BIGINT) AS class_id, y, unnest(range(x_start, x_end)) AS x FROM {view('mask_runs')}) GROUP BY 1, 2, 3)""",
)
def _(spark, sf):
    return fld.class_shares(table(spark, sf, "mask_runs")).select(
        *KEY, *big("class_id"), "area", *r6("share")
    )


NEXT = f"""(SELECT *, coalesce(lead(x) OVER w, first_value(x) OVER w) AS nx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS ny
FROM {C} WINDOW w AS (PARTITION BY video_id, frame_idx, contour_id ORDER BY pt_idx))"""

MEASURES = f"""(SELECT video_id, frame_idx, CAST(contour_id AS BIGINT) AS contour_id, count(*) AS points, abs(sum(x * ny - nx * y)) / 2 AS area,
sum(sqrt((nx - x) * (nx - x) + (ny - y) * (ny - y))) AS perimeter FROM {NEXT} GROUP BY 1, 2, 3)"""


@query("next_point", f"SELECT {S_CONTOUR}, pt_idx, nx AS next_x, ny AS next_y FROM {NEXT}")
def _(spark, sf):
    d = neighbour_rows(
        table(spark, sf, "contour_points"), CONTOUR, ["pt_idx"], ["x", "y"], "next_", 1, True
    )
    return d.select(*KEY, *big("contour_id"), "pt_idx", "next_x", "next_y")


@query(
    "explode_contours",
    "SELECT vec_id, i AS pt_idx, CAST(embedding[2 * i + 1] AS DOUBLE) AS x, CAST(embedding[2 * i + 2] AS DOUBLE) AS y FROM embeddings, range(0, 32) t(i)",
)
def _(spark, sf):
    def point(i):
        at = F.get("embedding", i * 2).cast("double"), F.get("embedding", i * 2 + 1).cast("double")
        return F.struct(at[0].alias("x"), at[1].alias("y"))

    d = raw(spark, sf, "embeddings").select(
        "vec_id", F.transform(F.sequence(F.lit(0), F.lit(31)), point).alias("points")
    )
    return explode_contours(d).select("vec_id", *big("pt_idx"), "x", "y")


@query(
    "contour_measures",
    f"SELECT video_id, frame_idx, contour_id, points, {sql_r6('area', 'perimeter')} FROM {MEASURES}",
)
def _(spark, sf):
    return fld.contour_measures(table(spark, sf, "contour_points")).select(
        *KEY, *big("contour_id"), "points", *r6("area", "perimeter")
    )


@query(
    "largest_contour",
    f"""SELECT video_id, frame_idx, contour_id, points, {sql_r6('area', 'perimeter')} FROM (SELECT *,
    row_number() OVER (PARTITION BY video_id, frame_idx ORDER BY area DESC, contour_id) AS n FROM {MEASURES}) WHERE n = 1 AND area >= 5000""",
)
def _(spark, sf):
    best = fld.largest_contour(fld.contour_measures(table(spark, sf, "contour_points")))
    return best.select(*KEY, *big("contour_id"), "points", *r6("area", "perimeter"))


K3 = "video_id, frame_idx, contour_id"


def _sweep(start: str) -> str:
    """The point farthest from each contour's ``start`` (t, x, y), the first one round the ring on a tie."""
    return f"""SELECT {K3}, p, px, py, n, eps, t, x, y, d FROM (SELECT r.*, s.t AS p, s.x AS px, s.y AS py, (r.t - s.t + r.n) % r.n AS o,
(r.x - s.x) * (r.x - s.x) + (r.y - s.y) * (r.y - s.y) AS d FROM ring r JOIN {start} s USING ({K3}))
QUALIFY row_number() OVER (PARTITION BY {K3} ORDER BY d DESC, o) = 1"""


CROSS = "((r.y - ay) * (bx - ax) - (r.x - ax) * (by_ - ay))"
SIMPLIFIED = f"""WITH RECURSIVE ring AS MATERIALIZED (SELECT c.*, m.perimeter * 0.001::DOUBLE AS eps,
row_number() OVER (PARTITION BY {K3} ORDER BY pt_idx) - 1 AS t, count(*) OVER (PARTITION BY {K3}) AS n
FROM {C} c JOIN {MEASURES} m USING ({K3})),
s1 AS MATERIALIZED ({_sweep('(SELECT * FROM ring WHERE t = 0)')}), s2 AS MATERIALIZED ({_sweep('s1')}), s3 AS MATERIALIZED ({_sweep('s2')}),
turned AS MATERIALIZED (SELECT r.*, (r.t - s3.p + s3.n) % s3.n AS u FROM ring r JOIN s3 USING ({K3})),
seg AS (SELECT {K3}, eps, CASE side WHEN 0 THEN 0 ELSE (t - p + n) % n END AS lo, CASE side WHEN 0 THEN (t - p + n) % n ELSE n END AS hi,
CASE side WHEN 0 THEN px ELSE x END AS ax, CASE side WHEN 0 THEN py ELSE y END AS ay, CASE side WHEN 0 THEN x ELSE px END AS bx, CASE side WHEN 0 THEN y ELSE py END AS by_
FROM s3, (VALUES (0), (1)) h(side) WHERE d > eps * eps
UNION ALL SELECT {K3}, eps, CASE side WHEN 0 THEN lo ELSE u END, CASE side WHEN 0 THEN u ELSE hi END,
CASE side WHEN 0 THEN ax ELSE x END, CASE side WHEN 0 THEN ay ELSE y END, CASE side WHEN 0 THEN x ELSE bx END, CASE side WHEN 0 THEN y ELSE by_ END
FROM (SELECT g.*, r.u, r.x, r.y, {CROSS} * {CROSS} AS away FROM seg g JOIN turned r USING ({K3}) WHERE r.u > g.lo AND r.u < g.hi
QUALIFY row_number() OVER (PARTITION BY {K3}, lo ORDER BY {CROSS} * {CROSS} DESC, r.u) = 1), (VALUES (0), (1)) h(side)
WHERE away > eps * eps * ((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay)))
SELECT video_id, frame_idx, CAST(contour_id AS BIGINT) AS contour_id, pt_idx, x, y FROM turned WHERE u = 0
UNION SELECT video_id, frame_idx, CAST(contour_id AS BIGINT), pt_idx, x, y FROM turned JOIN (SELECT DISTINCT {K3}, lo AS u FROM seg) USING ({K3}, u)"""


@query("simplify_contours", SIMPLIFIED)
def _(spark, sf):
    kept = fld.simplify_contours(table(spark, sf, "contour_points"), 0.001)
    return kept.select(*KEY, *big("contour_id"), "pt_idx", "x", "y")


def sql_dense(most: float) -> str:
    """Contours with no edge longer than ``most``."""
    return f"""(SELECT video_id, frame_idx, CAST(contour_id AS BIGINT) AS contour_id, pt_idx, k AS sub_idx,
x + k / (extra + 1.0::DOUBLE) * (nx - x) AS x, y + k / (extra + 1.0::DOUBLE) * (ny - y) AS y FROM
(SELECT *, unnest(range(0, extra + 1)) AS k FROM (SELECT *, CASE WHEN d > {most} THEN CAST(ceil(d / {most}) AS BIGINT) - 1 ELSE 0 END AS extra FROM
(SELECT *, sqrt((nx - x) * (nx - x) + (ny - y) * (ny - y)) AS d FROM {NEXT}))))"""


@query(
    "densify_contours",
    f"SELECT video_id, frame_idx, contour_id, pt_idx, sub_idx, {sql_r6('x', 'y')} FROM {sql_dense(200)}",
)
def _(spark, sf):
    return fld.densify_contours(table(spark, sf, "contour_points"), 200.0).select(
        *KEY, *big("contour_id"), "pt_idx", "sub_idx", *r6("x", "y")
    )


@query(
    "split_edge_points_inner",
    f"SELECT {S_CONTOUR}, pt_idx, x, y FROM {C} WHERE x >= 105 AND x <= 1815 AND y >= 105 AND y <= 975",
)
def _(spark, sf):
    inner, _edge = fld.split_edge_points(table(spark, sf, "contour_points"), *FRAME, 105)
    return inner.select(*KEY, *big("contour_id"), "pt_idx", "x", "y")


@query(
    "split_edge_points_edge",
    f"SELECT {S_CONTOUR}, pt_idx, x, y FROM {C} WHERE NOT (x >= 105 AND x <= 1815 AND y >= 105 AND y <= 975)",
)
def _(spark, sf):
    _inner, edge = fld.split_edge_points(table(spark, sf, "contour_points"), *FRAME, 105)
    return edge.select(*KEY, *big("contour_id"), "pt_idx", "x", "y")


def point_rows(spark, sf):
    """Contour points of both contours of a frame under one id."""
    point_id = F.col("pt_idx") * 2 + F.col("contour_id")
    return table(spark, sf, "contour_points").select(*KEY, point_id.alias("point_id"), "x", "y")


def _ticket(factors: tuple[int, int], seed: int) -> str:
    h = f"((point_id % {lin.PRIME} * {factors[0]} + (trial + {seed}) * {factors[1]}) % {lin.PRIME})"
    return f"(({h} * {h}) % {lin.PRIME} % {1 << 22} * {1 << 40} + point_id)"


P = f"(SELECT video_id, frame_idx, pt_idx * 2 + contour_id AS point_id, x, y FROM {C})"
KEYS2 = "video_id, frame_idx"
FAR = "(la * x + lb * y + lc) * (la * x + lb * y + lc) > 25"


def sql_picks(points: str, seed: int = 0) -> str:
    one, two = _ticket(lin.FIRST, seed), _ticket(lin.SECOND, seed)
    return f"""(SELECT {KEYS2}, trial, id_a, CASE WHEN id_b = id_a THEN id_c ELSE id_b END AS id_b FROM
(SELECT {KEYS2}, trial, arg_min(point_id, {one}) AS id_a, arg_min(point_id, {two}) AS id_b,
arg_max(point_id, {two}) AS id_c FROM {points}, range(0, 20) t(trial) GROUP BY 1, 2, 3)
WHERE id_a <> CASE WHEN id_b = id_a THEN id_c ELSE id_b END)"""


def sql_trials(points: str, seed: int = 0, drawn: str | None = None) -> str:
    """Line of each trial, from ``drawn``: the picks with their first points as ``a``, joined here if not given."""
    ends = f"{drawn} k" if drawn else f"""{sql_picks(points, seed)} k
JOIN {points} a ON a.video_id = k.video_id AND a.frame_idx = k.frame_idx AND a.point_id = k.id_a"""
    return f"""(SELECT {KEYS2}, trial, la, lb, -(la * ax + lb * ay) AS lc FROM (SELECT k.video_id, k.frame_idx, k.trial,
-(b.y - a.y) / sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)) AS la,
(b.x - a.x) / sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)) AS lb, a.x AS ax, a.y AS ay FROM {ends}
JOIN {points} b ON b.video_id = k.video_id AND b.frame_idx = k.frame_idx AND b.point_id = k.id_b WHERE a.x <> b.x OR a.y <> b.y))"""


def sql_best(points: str, seed: int = 0, trials: str | None = None) -> str:
    """Best trial line per frame over ``points``, as ``n = 1``."""
    return f"""(SELECT *, CASE WHEN abs(lb) <= 1e-6 THEN -lc / la ELSE x_min END AS x1, CASE WHEN abs(lb) <= 1e-6 THEN y_min ELSE -(la * x_min + lc) / lb END AS y1,
CASE WHEN abs(lb) <= 1e-6 THEN -lc / la ELSE x_max END AS x2, CASE WHEN abs(lb) <= 1e-6 THEN y_max ELSE -(la * x_max + lc) / lb END AS y2,
row_number() OVER (PARTITION BY {KEYS2} ORDER BY inliers DESC, trial) AS n FROM
(SELECT {KEYS2}, trial, la, lb, lc, count(*) AS inliers, min(x) AS x_min, max(x) AS x_max, min(y) AS y_min, max(y) AS y_max
FROM {trials or sql_trials(points, seed)} JOIN {points} USING ({KEYS2}) WHERE NOT ({FAR}) GROUP BY ALL))"""


def sql_all_rounds(rounds: int = 4, points: str = P, by_steps: bool = False) -> str:
    """Four rounds, each on the points that the lines before leave over.

    ``by_steps`` states the joins of a round as tables of their own: in one expression DuckDB may join
    all points of a frame with each other before it looks at the ids picked.
    """
    steps = [f"p0 AS MATERIALIZED (SELECT * FROM {points})"]
    for n in range(rounds):
        trials = None
        if by_steps:
            first = "a.video_id = k.video_id AND a.frame_idx = k.frame_idx AND a.point_id = k.id_a"
            steps.append(f"d{n} AS MATERIALIZED (SELECT k.*, a FROM {sql_picks(f'p{n}', n * 20)} k JOIN p{n} a ON {first})")
            steps.append(f"t{n} AS MATERIALIZED {sql_trials(f'p{n}', drawn=f'd{n}')}")
            trials = f"t{n}"
        steps.append(f"b{n} AS MATERIALIZED (SELECT * FROM {sql_best(f'p{n}', n * 20, trials)} WHERE n = 1)")
        steps.append(
            f"p{n + 1} AS MATERIALIZED (SELECT p.* FROM p{n} p JOIN b{n} USING ({KEYS2}) WHERE {FAR})"
        )
    columns = f"{KEYS2}, trial, inliers, {sql_r6('x1', 'y1', 'x2', 'y2')}"
    found = " UNION ALL ".join(
        f"SELECT CAST({n} AS BIGINT) AS line_idx, {columns} FROM b{n}" for n in range(rounds)
    )
    return f"WITH {', '.join(steps)} {found}"


@query("ransac_picks", f"SELECT video_id, frame_idx, trial, id_a, id_b FROM {sql_picks(P)}")
def _(spark, sf):
    return lin.ransac_picks(point_rows(spark, sf), 20)


@query(
    "fit_first_line",
    f"SELECT video_id, frame_idx, trial, inliers, {sql_r6('x1', 'y1', 'x2', 'y2')} FROM {sql_best(P)} WHERE n = 1",
)
def _(spark, sf):
    return lin.fit_lines_ransac(point_rows(spark, sf), num_lines=1, min_points=2).select(
        *KEY, "trial", "inliers", *r6("x1", "y1", "x2", "y2")
    )


@query("fit_lines_ransac", sql_all_rounds())
def _(spark, sf):
    return lin.fit_lines_ransac(point_rows(spark, sf)).select(
        *KEY, "line_idx", "trial", "inliers", *r6("x1", "y1", "x2", "y2")
    )


# With the operator's own margin and spacing: added points lie 10 to 20 apart, beyond its least distance.
MARGIN = FIELD.edge_margin
LARGEST = f"""(SELECT video_id, frame_idx, contour_id, points FROM (SELECT *,
row_number() OVER (PARTITION BY video_id, frame_idx ORDER BY area DESC, contour_id) AS n FROM {MEASURES}) WHERE n = 1 AND area >= 5000)"""
KEPT = f"""(SELECT video_id, frame_idx, pt_idx * {lin.SUB} + sub_idx AS point_id, x, y FROM
(SELECT *, bool_or(inside) OVER (PARTITION BY video_id, frame_idx) AS any_inside FROM
(SELECT d.*, x >= {MARGIN} AND x <= {FRAME[0] - MARGIN} AND y >= {MARGIN} AND y <= {FRAME[1] - MARGIN} AS inside
FROM {sql_dense(FIELD.max_point_distance)} d JOIN {LARGEST} USING (video_id, frame_idx, contour_id))) WHERE inside OR NOT any_inside)"""


@query(
    "extract_field_lines",
    f"""SELECT f.*, l.points, round(least(0.95, f.inliers / greatest(1, l.points // 4)), 6) AS confidence,
    CASE WHEN least(0.95, f.inliers / greatest(1, l.points // 4)) > 0.8 THEN 'excellent' WHEN least(0.95, f.inliers / greatest(1, l.points // 4)) > 0.6 THEN 'good'
    WHEN least(0.95, f.inliers / greatest(1, l.points // 4)) > 0.4 THEN 'fair' ELSE 'low' END AS band
    FROM ({sql_all_rounds(4, KEPT, by_steps=True)}) f JOIN {LARGEST} l USING (video_id, frame_idx)""",
)
def _(spark, sf):
    lines = lin.extract_field_lines(table(spark, sf, "contour_points"), *FRAME, min_points=2)
    return lines.select(
        *KEY, "line_idx", "trial", "inliers", *r6("x1", "y1", "x2", "y2"), "points", *r6("confidence"), "band"
    )


@query(
    "line_confidence",
    f"""SELECT video_id, frame_idx, line_idx, inliers, points, round(least(0.95, inliers / greatest(1, points // 4)), 6) AS confidence,
    round(inliers / points, 6) AS inlier_ratio FROM ({sql_all_rounds()})
    JOIN (SELECT video_id, frame_idx, count(*) AS points FROM {P} GROUP BY 1, 2) USING (video_id, frame_idx)""",
)
def _(spark, sf):
    points = point_rows(spark, sf)
    sizes = points.groupBy(*KEY).agg(F.count("*").alias("points"))
    return lin.line_confidence(lin.fit_lines_ransac(points), sizes).select(
        *KEY, "line_idx", "inliers", "points", *r6("confidence", "inlier_ratio")
    )


@query(
    "line_summary",
    f"""SELECT video_id, frame_idx, count(*) AS lines, count(*) FILTER (confidence > 0.8) AS excellent,
    count(*) FILTER (confidence > 0.6 AND confidence <= 0.8) AS good, round(avg(confidence), 6) AS mean_confidence FROM {L} GROUP BY 1, 2""",
)
def _(spark, sf):
    return lin.line_summary(table(spark, sf, "field_lines")).select(
        *KEY, "lines", "excellent", "good", *r6("mean_confidence")
    )


@query(
    "line_band",
    f"""SELECT line_idx, CASE WHEN confidence > 0.8 THEN 'excellent' WHEN confidence > 0.6 THEN 'good'
    WHEN confidence > 0.4 THEN 'fair' ELSE 'low' END AS band FROM {L}""",
)
def _(spark, sf):
    return lin.with_line_band(table(spark, sf, "field_lines")).select("line_idx", "band")
