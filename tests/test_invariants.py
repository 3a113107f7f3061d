"""Operators against brute force, against their other path, and under other partitionings."""

from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sightline.functions import registered
from sightline.operators import field, lines, ordered, support, suppression, tracking
from sightline.operators.search import next_generation, search_homographies
from sightline.plans.catalog import table
from sightline.settings import SEARCH, TrackDefaults

SF_DIR = "/root/testdata/sf0.001"


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=str)


@pytest.fixture(scope="module")
def readings(spark):
    d = table(spark, SF_DIR, "tracks").select("video_id", "frame_idx", "seq", "x1")
    return d.withColumn("gap", F.when(F.col("seq") % 3 == 0, F.col("x1"))).cache()


@pytest.mark.parametrize("size", [1, 7, 4096])
def test_chunked_scans_equal_plain_windows(spark, readings, size):
    keys, order = ["video_id"], ["frame_idx", "seq"]
    chunk = F.floor(F.col("frame_idx") / size).cast("bigint")
    w = W.partitionBy("video_id").orderBy("frame_idx", "seq")
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    plain = readings.withColumns(
        {
            "pos": F.row_number().over(w) - 1,
            "prev_x1": F.lag("x1").over(w),
            "next_x1": F.coalesce(F.lead("x1").over(w), F.first("x1").over(w)),
            "last_gap": F.last("gap", ignorenulls=True).over(upto),
            "total": F.sum("x1").over(upto),
            "top": F.max("x1").over(upto),
            "mean": F.avg("x1").over(w.rowsBetween(-4, 0)),
        }
    )
    d = ordered.index_rows(readings, keys, order, "pos", chunk)
    d = ordered.neighbour_rows(d, keys, order, ["x1"], "prev_", -1, False, chunk)
    d = ordered.neighbour_rows(d, keys, order, ["x1"], "next_", 1, True, chunk)
    d = ordered.carry_forward(d, keys, order, ["gap"], "last_", chunk)
    d = ordered.running_sum(d, keys, order, "x1", "total", chunk)
    d = ordered.running_max(d, keys, order, "x1", "top", chunk)
    d = ordered.rolling(d, keys, order, 5, {"mean": F.avg("x1")}, chunk, block=16)
    columns = ["seq", "pos", "prev_x1", "next_x1", "last_gap", "total", "top", "mean"]
    assert rows(d, *columns) == rows(plain, *columns)


def test_newest_drops_rows_before_the_shuffle(spark, readings):
    plan = ordered.newest(readings, ["video_id"], ["frame_idx", "seq"], 10)
    text = plan._sc._jvm.PythonSQLUtils.explainString(plan._jdf.queryExecution(), "simple")
    assert text.count("WindowGroupLimit") == 2


def _iou(a, b):
    w = max(0, min(a[2], b[2]) - max(a[0], b[0]))
    h = max(0, min(a[3], b[3]) - max(a[1], b[1]))
    i = w * h
    return i / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - i)


def _crowd(n, seed):
    rng = np.random.default_rng(seed)
    x, y = rng.integers(0, 300, n), rng.integers(0, 300, n)
    return [
        (1, 1, "player_model", i, int(a), int(b), int(a + rng.integers(20, 90)),
         int(b + rng.integers(20, 90)), float(rng.integers(1, 20)) / 20)
        for i, (a, b) in enumerate(zip(x, y))
    ]


BOXES = (
    "video_id long, frame_idx long, model_type string, det_idx long, x1 int, y1 int, x2 int, "
    "y2 int, confidence double"
)


def test_nms_paths_equal_brute_force(spark):
    data = _crowd(250, 3) + [(1, 1, "player_model", 900 + i, 5, 5, 60, 60, 0.5) for i in range(40)]
    data.append((1, 1, "player_model", 999, 7, 7, 7, 7, 0.99))  # a box without area
    kept = []
    for b in sorted(data, key=lambda r: (-r[8], r[3])):
        flat = b[4] == b[6]
        if flat or all(k[4] == k[6] or _iou(k[4:8], b[4:8]) <= 0.45 for k in kept):
            kept.append(b)
    df = spark.createDataFrame(data, BOXES).repartition(4)
    fold = suppression.nms(df, max_det=None)
    rounds = suppression.nms(df, max_det=None, fold_limit=10)
    want = sorted(b[3] for b in kept)
    assert sorted(r["det_idx"] for r in fold.collect()) == want
    assert sorted(r["det_idx"] for r in rounds.collect()) == want
    capped = suppression.nms(df, max_det={"player_model": 7}, fold_limit=10)
    first = sorted(kept, key=lambda r: (-r[8], r[3]))[:7]
    assert sorted(r["det_idx"] for r in capped.collect()) == sorted(b[3] for b in first)


@pytest.mark.parametrize("iou", [0.45, 1.0])
def test_nms_paths_agree_on_odd_boxes(spark, iou):
    data = _crowd(60, 4) + [(1, 1, "player_model", 900 + i, 5, 5, 60, 60, 0.5) for i in range(4)]
    data += [(1, 1, "player_model", 910, None, 5, 60, 60, 0.9), (1, 1, "player_model", 911, 5, 5, 5, 60, 0.9)]
    data += [(1, 1, "player_model", 912 + i, 300, 300, 400, 400, None) for i in range(2)]
    df = spark.createDataFrame(data, BOXES)
    fold, rounds = (sorted(r["det_idx"] for r in suppression.nms(df, iou, fold_limit=n).collect()) for n in (1024, 5))
    assert fold == rounds and {910, 911, 912} <= set(fold)
    assert (len(fold) == len(data)) == (iou == 1)


@pytest.mark.parametrize("cell", [16, 1000])
def test_iou_pairs_in_any_grid(spark, cell):
    data = _crowd(120, 5)
    want = sorted(
        (a[3], b[3]) for a in data for b in data if a[3] < b[3] and _iou(a[4:8], b[4:8]) > 0.3
    )
    got = suppression.iou_pairs(spark.createDataFrame(data, BOXES), 0.3, cell=cell)
    assert sorted((r["det_idx_a"], r["det_idx_b"]) for r in got.collect()) == want


def _outline(spark, n=700):
    t = np.linspace(0, 2 * np.pi, n, endpoint=False)
    rng = np.random.default_rng(1)
    x, y = 500 + 300 * np.cos(t) + rng.normal(0, 2, n), 400 + 200 * np.sin(t) + rng.normal(0, 2, n)
    return spark.createDataFrame(
        [(1, 1, 0, i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))],
        "video_id long, frame_idx long, contour_id int, pt_idx int, x double, y double",
    )


def test_simplify_paths_agree_and_hold_the_tolerance(spark):
    points = _outline(spark)
    whole = field.simplify_contours(points, 0.005)
    rounds = field.simplify_contours(points, 0.005, group_limit=10)
    assert rows(whole, "pt_idx") == rows(rounds, "pt_idx")
    eps = 0.005 * field.contour_measures(points).first()["perimeter"]
    kept = whole.orderBy("pt_idx").toPandas()
    assert 8 < len(kept) < 100
    every = points.orderBy("pt_idx").toPandas()
    at = kept["pt_idx"].tolist()
    for lo, hi in zip(at, at[1:] + [at[0] + len(every)]):
        a, b = every.iloc[lo % len(every)], every.iloc[hi % len(every)]
        for i in range(lo + 1, hi):
            p = every.iloc[i % len(every)]
            d = abs((p.y - a.y) * (b.x - a.x) - (p.x - a.x) * (b.y - a.y))
            assert d / np.hypot(b.x - a.x, b.y - a.y) <= eps + 1e-9


def test_line_fit_paths_agree(spark):
    points = table(spark, SF_DIR, "contour_points").select(
        "video_id", "frame_idx", (F.col("pt_idx") * 2 + F.col("contour_id")).alias("point_id"), "x", "y"
    )
    columns = ["video_id", "frame_idx", "line_idx", "trial", "inliers", "x1", "y1", "x2", "y2"]
    whole = lines.fit_lines_ransac(points)
    rounds = lines.fit_lines_ransac(points, group_limit=10, block_size=64)
    assert rows(whole, *columns) == rows(rounds, *columns)
    # A line's inliers are the points it is the first to come near.
    labelled = lines.assign_points(points, whole).filter("line_idx IS NOT NULL")
    counts = labelled.groupBy("video_id", "frame_idx", "line_idx").agg(F.count("*").alias("inliers"))
    names = ["video_id", "frame_idx", "line_idx", "inliers"]
    assert rows(counts, *names) == rows(whole, *names)


TRACKED = "video_id long, frame_idx long, det_idx long, x1 double, y1 double, x2 double, y2 double, class_name string, confidence double"


def _walkers(frames=120, people=6):
    out = []
    for f in range(frames):
        for p in range(people):
            if (f + 13 * p) % 50 in (7, 8):  # now and then unseen for two frames
                continue
            x, y = 100.0 * p + 1.5 * f, 50.0 * p + (f % 7)
            out.append((1, f, len(out), x, y, x + 40, y + 90, "player", 0.9))
    return out


def test_tracker_follows_and_stitches(spark):
    df = spark.createDataFrame(_walkers(), TRACKED).repartition(4)
    whole = tracking.track_objects(df).toPandas()
    cut = tracking.track_objects(df, segment_frames=30, overlap=12).toPandas()
    for got in (whole, cut):
        assert len(got) == df.count()
        assert not got.duplicated(["frame_idx", "track_id"]).any()
        assert got["track_id"].nunique() == 6
    pairs = whole.merge(cut, on="det_idx")[["track_id_x", "track_id_y"]].drop_duplicates()
    assert len(pairs) == 6


def _crossing(seed, videos=2, frames=160, looks=False):
    """People who cross, vanish and come back, in videos with a gap."""
    rng = np.random.default_rng(seed)
    out = []
    for v in range(videos):
        at, step = rng.uniform(0, 250, (8, 2)), rng.normal(0, 4, (8, 2))
        faces = np.eye(8)
        for f in range(-20, frames):
            at = at + step + rng.normal(0, 1.5, at.shape)
            if 70 <= f < 78:
                continue
            for p in np.flatnonzero(rng.random(8) < 0.85):
                x, y = (float(round(a)) for a in at[p])
                row = (v, f, len(out), x, y, x + 40, y + 60, "ball" if p == 0 else "player", 0.9)
                out.append((*row, (faces[p] + rng.normal(0, 0.15, 8)).tolist()) if looks else row)
    return out


def _one_pass(rows, s):
    """The tracker as its description states it, a frame at a time."""
    out, by_video = {}, {}
    for r in sorted(rows, key=lambda r: r[:3]):
        by_video.setdefault(r[0], {}).setdefault(r[1], []).append(r)

    def iou(a, b):
        w, h = (max(0.0, min(a[k + 2], b[k + 2]) - max(a[k], b[k])) for k in (0, 1))
        size = lambda z: (z[2] - z[0]) * (z[3] - z[1])
        return w * h / (size(a) + size(b) - w * h)

    for frames in by_video.values():
        live, born = [], 0
        for f, dets in sorted(frames.items()):
            live = [t for t in live if f - t["last"] - 1 <= (s.max_age if t["hits"] >= s.n_init else 0)]
            pairs = sorted(
                (1 - iou(t["box"], d[3:7]), i, j) for i, t in enumerate(live) for j, d in enumerate(dets) if t["class"] == d[7]
            )
            owner = {}
            for cost, i, j in pairs:
                if cost <= s.max_iou_distance and j not in owner and live[i] not in owner.values():
                    owner[j] = live[i]
            seen = []
            for j, d in enumerate(dets):
                t = owner.get(j)
                if t is None:
                    born += 1
                    t = {"id": born, "hits": 0, "class": d[7]}
                t |= {"box": d[3:7], "last": f, "hits": t["hits"] + 1}
                seen.append(t)
                out[d[:3]] = (t["id"], t["hits"] >= s.n_init)
            live = [t for t in live if t["last"] != f and t["hits"] >= s.n_init] + seen
    return out


def test_tracks_do_not_depend_on_segments(spark):
    rows, s = _crossing(1), TrackDefaults(max_age=9, n_init=3)
    want = _one_pass(rows, s)
    df = spark.createDataFrame(rows, TRACKED).repartition(3)
    for frames, overlap in ((10**6, 0), (40, 20), (25, 0), (7, 3)):
        got = tracking.track_objects(df, s, segment_frames=frames, overlap=overlap).collect()
        assert {(r.video_id, r.frame_idx, r.det_idx): (r.track_id, r.confirmed) for r in got} == want, (frames, overlap)
        assert len(got) == len(rows)


def test_tracks_by_looks_do_not_depend_on_segments(spark):
    df = spark.createDataFrame(_crossing(2, 1, 90, True), TRACKED + ", embedding array<double>")
    one = tracking.track_objects(df, segment_frames=10**6)
    assert one.select("track_id").distinct().count() < one.count() / 20
    for frames, overlap in ((30, 10), (11, 2)):
        cut = tracking.track_objects(df, segment_frames=frames, overlap=overlap)
        assert sorted(map(tuple, cut.collect())) == sorted(map(tuple, one.collect()))
    assert tracking.track_objects(df.limit(0)).count() == 0


def test_tracker_life_cycle():
    s = TrackDefaults(max_age=3, n_init=3)
    box = np.array([[0.0, 0.0, 10.0, 10.0]])
    state = tracking.TrackSet(s)
    ids = [state.step(f, box, ["player"], [None])[0]["track_id"] for f in (0, 1, 2, 5, 10)]
    # Three hits confirm; frame 5 is within the age, frame 10 is not.
    assert ids == [1, 1, 1, 1, 2]
    by_frames_seen = tracking.TrackSet(s, "processed")
    ids = [by_frames_seen.step(f, box, ["player"], [None])[0]["track_id"] for f in (0, 1, 2, 90)]
    assert ids == [1, 1, 1, 1]
    assert tracking.TrackSet(s).step(0, box, ["disc"], [None])[0]["class_name"] == "disc"


def test_tracker_uses_appearance():
    s = TrackDefaults(n_init=1)
    state = tracking.TrackSet(s)
    red, blue = np.array([1.0, 0.0]), np.array([0.0, 1.0])
    near, far = [0.0, 0.0, 10.0, 10.0], [500.0, 0.0, 510.0, 10.0]
    first = [t["track_id"] for t in state.step(0, np.array([near, far]), ["player"] * 2, [red, blue])]
    # They swap places: appearance wins over overlap.
    then = [t["track_id"] for t in state.step(1, np.array([near, far]), ["player"] * 2, [blue, red])]
    assert then == first[::-1]


def test_search_stops_per_video(spark):
    seeds = table(spark, SF_DIR, "homographies").filter("cand_id = 0").drop("generation")
    seeds = seeds.crossJoin(spark.range(3).withColumnRenamed("id", "k"))
    seeds = seeds.withColumns({"video_id": F.col("video_id") * 3 + F.col("k"), "h02": F.col("h02") + F.col("k") * 40}).drop("k", "cand_id")
    drawn = table(spark, SF_DIR, "field_lines").crossJoin(spark.range(3).withColumnRenamed("id", "k"))
    drawn = drawn.withColumn("video_id", F.col("video_id") * 3 + F.col("k")).drop("k")
    columns = ["video_id", "generation", "cand_id", F.round("fitness", 9)]
    history = rows(search_homographies(seeds, drawn, 3, keep_history=True, settings=replace(SEARCH, fitness_goal=9.0)), *columns)
    best = {}
    for video, generation, _, fitness in history:
        best[video, generation] = max(fitness, best.get((video, generation), 0.0))
    goal = sorted(best[v, 3] for v in {v for v, _ in best})[-1] - 1e-6
    ends = {v: min([g for g in range(4) if best[v, g] >= goal] or [3]) for v, _ in best}
    assert len(ends) > 1
    stops = replace(SEARCH, fitness_goal=goal)
    assert rows(search_homographies(seeds, drawn, 3, settings=stops), *columns) == [r for r in history if r[1] == ends[r[0]]]
    whole = search_homographies(seeds, drawn, 3, settings=stops, keep_history=True)
    assert rows(whole, *columns) == [r for r in history if r[1] <= ends[r[0]]]


def test_search_never_falls_and_reruns_agree(spark):
    seeds = table(spark, SF_DIR, "homographies").filter("cand_id = 0").drop("cand_id", "generation")
    drawn = table(spark, SF_DIR, "field_lines")
    history = search_homographies(seeds, drawn, 2, seed=4, keep_history=True)
    best = history.groupBy("generation").agg(F.max("fitness")).orderBy("generation").collect()
    values = [r[1] for r in best]
    assert values == sorted(values) and len(values) == 3
    columns = ["generation", "cand_id", "h00", "h21", "fitness"]
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    again = search_homographies(seeds, drawn, 2, seed=4, keep_history=True)
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    key = [F.round(c, 9) if c not in ("generation", "cand_id") else F.col(c) for c in columns]
    assert rows(history, *key) == rows(again, *key)
    bred = next_generation(history.filter("generation = 0"), 1, 4)
    assert bred.count() == 20
    assert bred.filter("h00 NOT BETWEEN -100 AND 100 OR h21 NOT BETWEEN -0.2 AND 0.2").count() == 0


@pytest.mark.parametrize("partitions", ["1", "13"])
def test_results_do_not_depend_on_partitions(spark, partitions):
    import __spark_entry__ as entry

    def run(name):
        return rows(entry.queries()[name](spark, SF_DIR), "*")

    names = ("nms", "track_segments", "fuse_jerseys", "fit_lines_ransac")
    want = {n: run(n) for n in names}
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        assert {n: run(n) for n in names} == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_whole_frames_joins_split_batches():
    pdf = pd.DataFrame({"frame_idx": [1, 1, 2, 2, 2, 5], "v": range(6)})
    pieces = [pdf.iloc[:1], pdf.iloc[1:4], pdf.iloc[4:]]
    got = [r["v"].tolist() for r in tracking.whole_frames(iter(pieces))]
    assert got == [[0, 1], [2, 3, 4], [5]]


def test_small_groups_share_calls(spark):
    """Groups of one partition come many to a call, whole and in order, over the borders of batches."""
    d = spark.range(1000).select(F.when(F.col("id") % 100 < 99, F.col("id") % 100).alias("k"), F.col("id").alias("v"))

    def fn(pdf, starts):
        groups = [pdf.iloc[a:b] for a, b in zip(starts[:-1], starts[1:])]
        return pd.DataFrame([(g["k"].iloc[0], len(g), g["v"].is_monotonic_increasing, len(groups)) for g in groups], columns=list("knos"))

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        got = support.map_groups(d.repartition(7), ["k"], ["v"], fn, "k double, n long, o boolean, s long").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == 100 and len({r.k for r in got}) == 100
    assert all(r.n == 10 and r.o for r in got) and max(r.s for r in got) > 3


def test_contours_in_one_batch_are_simplified_each_on_its_own():
    """Of many contours at once as of each alone; flat, single and repeated points too."""
    rng = np.random.default_rng(3)
    shapes = [rng.integers(0, 50, (n, 2)).astype(float) for n in (1, 2, 3, 40, 150, 150)] + [np.ones((5, 2))]
    starts = np.r_[0, np.cumsum([len(s) for s in shapes])]
    x, y = np.concatenate(shapes).T
    together = field._simplify(x, y, starts, 0.002)
    alone = [field._simplify(*s.T, np.array([0, len(s)]), 0.002) for s in shapes]
    assert together.tolist() == np.concatenate(alone).tolist()
    assert together[starts[-2] :].sum() == 1 and together[0] and 100 < together.sum() < len(x)


def test_sql_tracker_takes_many_frames_at_once(monkeypatch):
    """As of one pass over the rows, with few calls however many frames there are."""
    rng = np.random.default_rng(5)
    low = rng.integers(0, 300, (600, 2)).astype(float)
    d = pd.DataFrame({"video_id": 1, "frame_idx": np.arange(600) // 6, "det_idx": np.arange(600) % 6, "x1": low[:, 0], "y1": low[:, 1],
                      "x2": low[:, 0] + 150, "y2": low[:, 1] + 150, "class_name": np.where(np.arange(600) % 3, "player", "disc"), "confidence": 0.5})
    expected = tracking.track_rows(tracking.TrackSet(), d)[tracking.COLUMNS].astype(object).values.tolist()
    calls = []
    monkeypatch.setattr(registered, "track_rows", lambda state, rows: calls.append(len(rows)) or tracking.track_rows(state, rows))
    monkeypatch.setattr(registered._TrackObjects, "BLOCK", 100)
    function, got = registered._TrackObjects(), []
    for row in d.to_dict("records"):
        got += function.eval(Row(**row))
    got += function.terminate()
    assert [list(r) for r in got] == expected
    assert len(calls) < 10 and sum(calls) == 600 and all(n % 6 == 0 for n in calls)


def test_mask_tasks_hold_bounded_rows(spark, monkeypatch):
    """More runs make more tasks, not larger ones; the result is the same."""
    runs = spark.range(3000).selectExpr(
        "id % 3 AS video_id", "id % 2 AS frame_idx", "CAST(id % 2 AS INT) AS class_id", "CAST(id % 40 AS INT) AS y",
        "CAST(id * 7 % 50 AS INT) AS x_start", "CAST(id * 7 % 50 + id % 9 AS INT) AS x_end",
    )
    columns = ["video_id", "frame_idx", "y", "x_start", "x_end"]
    whole = rows(field.union_masks(runs), *columns)
    monkeypatch.setattr(field, "TASK_RUNS", 100)
    parts = field.union_masks(runs)
    assert parts.rdd.getNumPartitions() >= 26 and rows(parts, *columns) == whole
    pixels = {(r.video_id, r.frame_idx, r.y, x) for r in runs.collect() for x in range(r.x_start, r.x_end)}
    assert sum(end - start for *_, start, end in whole) == len(pixels)


def test_nms_fold_leaves_boxes_apart_alone(spark):
    """Boxes that do not meet are told by their borders: their areas, too large to multiply here, are not taken."""
    far = 100_000
    data = [(1, 1, "player_model", i, far * i, 0, far * i + 60_000, 60_000, 0.5) for i in range(4)]
    kept = suppression.nms(spark.createDataFrame(data, BOXES)).collect()
    assert sorted(r["det_idx"] for r in kept) == [0, 1, 2, 3]


def test_links_equal_brute_force_and_move_a_box_once(spark):
    data = [(*b[:1], frame, *b[2:]) for frame in (-65, -64, -1, 0, 1, 62, 63, 64, 65, 67) for b in _crowd(25, frame + 70)]
    links = suppression.link_candidates(spark.createDataFrame([*data, (1, None, *data[0][2:])], BOXES))
    plan = links._sc._jvm.PythonSQLUtils.explainString(links._jdf.queryExecution(), "simple")
    assert plan.count("Exchange hashpartitioning") == 3  # cells, and each end of the pairs
    want = []
    for frame in {b[1] for b in data}:
        pairs = [(_iou(a[4:8], b[4:8]), a[3], b[3]) for a in data if a[1] == frame for b in data if b[1] == frame + 1]
        pairs = [p for p in pairs if p[0] > 0.3]
        for p in pairs:
            rivals = [q for q in pairs if p[1] == q[1] or p[2] == q[2]]
            if all((-p[0], p[2]) <= (-q[0], q[2]) for q in rivals if q[1] == p[1]) and all(
                (-p[0], p[1]) <= (-q[0], q[1]) for q in rivals if q[2] == p[2]
            ):
                want.append((frame, p[1], p[2], round(p[0], 6)))
    assert len(want) > 30
    assert rows(links.withColumn("iou", F.round("iou", 6)), "frame_idx", "det_idx", "next_det_idx", "iou") == sorted(want, key=str)
