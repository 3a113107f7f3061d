"""Queries over stage timings, frame reuse and training runs."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import frames as frm
from ..operators import telemetry as tel
from ..operators import training as trn
from ..operators.support import shared_folder
from ..sources import runs
from .catalog import big, query, r6, raw, sql_big, sql_r6, table, view

S = view("stage_timings")

CATEGORY = """CASE WHEN process_name LIKE 'Cache%' THEN 'Cache' WHEN process_name LIKE 'Player ID%' THEN 'Player Identification'
WHEN process_name LIKE 'Homography%' THEN 'Homography' WHEN process_name IN ('Line Extraction', 'Mask Unification') THEN 'Field Segmentation' ELSE process_name END"""
SUB = """CASE WHEN process_name = 'Player ID - EasyOCR' THEN 'Optical Character Recognition'
WHEN process_name = 'Homography Calculation' THEN 'Calculation' WHEN process_name LIKE '% - %' THEN split_part(process_name, ' - ', 2)
WHEN process_name IN ('Line Extraction', 'Mask Unification') THEN process_name END"""
CATEGORIZED = f"(SELECT *, {CATEGORY} AS category, {SUB} AS sub FROM {S})"
STATS = f"""(SELECT video_id, category, sub, count(*) AS samples, max(CASE WHEN age = 1 THEN duration_ms END) AS last_ms, avg(duration_ms) AS avg_ms,
max(duration_ms) AS max_ms FROM (SELECT *, row_number() OVER (PARTITION BY video_id, category, sub ORDER BY seq DESC) AS age FROM {CATEGORIZED})
WHERE age <= 120 GROUP BY 1, 2, 3)"""
MS = ("last_ms", "avg_ms", "max_ms")


@query("categorize_stage", f"SELECT seq, category, coalesce(sub, '') AS sub FROM {CATEGORIZED}")
def _(spark, sf):
    d = tel.categorize_stage(table(spark, sf, "stage_timings"))
    return d.select("seq", "category", F.coalesce("sub", F.lit("")).alias("sub"))


@query(
    "stage_stats",
    f"SELECT video_id, category, coalesce(sub, '') AS sub, samples, {sql_r6(*MS)} FROM {STATS}",
)
def _(spark, sf):
    return tel.stage_stats(table(spark, sf, "stage_timings")).select(
        "video_id", "category", F.coalesce("sub", F.lit("")).alias("sub"), "samples", *r6(*MS)
    )


@query(
    "stage_rollup",
    f"""SELECT video_id, category, {', '.join(f"round(CASE WHEN bool_or(sub IS NULL) AND category <> 'Field Segmentation' THEN max(CASE WHEN sub IS NULL THEN {c} END) ELSE sum(CASE WHEN sub IS NOT NULL THEN {c} ELSE 0 END) END, 6) AS {c}" for c in MS)}
    FROM {STATS} GROUP BY 1, 2""",
)
def _(spark, sf):
    d = tel.stage_rollup(tel.stage_stats(table(spark, sf, "stage_timings")))
    return d.select("video_id", "category", *r6(*MS))


@query(
    "stage_latest",
    f"""SELECT video_id, category, coalesce(sub, '') AS sub, max(top) AS newest_frame, CASE WHEN max(frame_idx) = max(top) THEN arg_max(duration_ms, seq) ELSE 0 END AS shown_ms
    FROM (SELECT *, max(frame_idx) OVER (PARTITION BY video_id) AS top FROM {CATEGORIZED}) GROUP BY 1, 2, 3""",
)
def _(spark, sf):
    d = tel.stage_latest(table(spark, sf, "stage_timings"))
    return d.withColumn("sub", F.coalesce("sub", F.lit("")))


BREAKDOWN = ("player_ms", "disc_ms", "inference_ms", "total_ms", "model_ratio", "inference_pct")


@query(
    "inference_breakdown",
    f"""SELECT video_id, {sql_r6(*BREAKDOWN)} FROM (SELECT *, player_ms / disc_ms AS model_ratio, inference_ms / total_ms * 100 AS inference_pct FROM
    (SELECT video_id, sum(CASE WHEN model = 'player' THEN duration_ms ELSE 0 END) AS player_ms, sum(CASE WHEN model = 'disc' THEN duration_ms ELSE 0 END) AS disc_ms,
    sum(CASE WHEN phase = 'inference' THEN duration_ms ELSE 0 END) AS inference_ms, sum(duration_ms) AS total_ms FROM {view('model_timings')} GROUP BY 1))""",
)
def _(spark, sf):
    d = tel.inference_breakdown(table(spark, sf, "model_timings"))
    return d.select("video_id", *r6(*BREAKDOWN))


@query(
    "rolling_fps",
    f"""SELECT video_id, frame_idx, round(CASE WHEN m > 0 THEN 1000 / m ELSE 0 END, 6) AS fps FROM
    (SELECT video_id, frame_idx, avg(t) OVER (PARTITION BY video_id ORDER BY frame_idx ROWS 29 PRECEDING) AS m FROM
    (SELECT video_id, frame_idx, sum(duration_ms) AS t FROM {S} GROUP BY 1, 2))""",
)
def _(spark, sf):
    d = tel.rolling_fps(tel.frame_times(table(spark, sf, "stage_timings")))
    return d.select("video_id", "frame_idx", *r6("fps"))


@query(
    "rolling_stage_stats",
    f"""SELECT video_id, process_name, seq, round(avg(duration_ms) OVER w, 6) AS avg_ms, max(duration_ms) OVER w AS max_ms FROM {S}
    WINDOW w AS (PARTITION BY video_id, process_name ORDER BY seq ROWS 9 PRECEDING)""",
)
def _(spark, sf):
    d = tel.rolling_stage_stats(table(spark, sf, "stage_timings"))
    return d.select("video_id", "process_name", "seq", *r6("avg_ms"), "max_ms")


FC = view("frame_contents")


@query(
    "dedup_frames",
    f"""SELECT content_hash, video_id, frame_idx, copies FROM (SELECT *, md5(text) AS content_hash, count(*) OVER (PARTITION BY text) AS copies,
    row_number() OVER (PARTITION BY text ORDER BY video_id, frame_idx) AS n FROM {FC}) WHERE n = 1""",
)
def _(spark, sf):
    d = frm.content_hash(table(spark, sf, "frame_contents"), "text")
    return frm.dedup_frames(d.select("content_hash", "video_id", "frame_idx"))


@query(
    "unprocessed_frames",
    f"""SELECT video_id, frame_idx, md5(text) AS content_hash, settings_key FROM {FC} f
    WHERE NOT EXISTS (SELECT 1 FROM {FC} g WHERE g.frame_idx <= 40 AND g.text = f.text AND g.settings_key = f.settings_key)""",
)
def _(spark, sf):
    d = frm.content_hash(table(spark, sf, "frame_contents"), "text").drop("text")
    return frm.unprocessed_frames(d, d.filter("frame_idx <= 40")).select(
        "video_id", "frame_idx", "content_hash", "settings_key"
    )


@query(
    "repeat_rate",
    f"""SELECT video_id, count(*) AS requests, count(DISTINCT (text, settings_key)) AS misses, count(*) - count(DISTINCT (text, settings_key)) AS hits,
    round((count(*) - count(DISTINCT (text, settings_key))) / count(*), 6) AS hit_rate FROM {FC} GROUP BY 1""",
)
def _(spark, sf):
    d = frm.content_hash(table(spark, sf, "frame_contents"), "text")
    return frm.repeat_rate(d, by=("video_id",)).select(
        "video_id", "requests", "misses", "hits", *r6("hit_rate")
    )


METRICS = view("training_metrics")
LONG = f"""(SELECT run_id, epoch, 'map50' AS metric, map50 AS value FROM {METRICS} UNION ALL SELECT run_id, epoch, 'box_loss', box_loss FROM {METRICS})"""


def metrics(spark, sf):
    return trn.metrics_long(table(spark, sf, "training_metrics"))


@query("metrics_long", f"SELECT run_id, epoch, metric, value FROM {LONG}")
def _(spark, sf):
    return metrics(spark, sf)


@query(
    "compare_runs",
    f"""SELECT coalesce(a.metric, b.metric) AS metric, coalesce(a.epoch, b.epoch) AS epoch, a.value AS value, b.value AS baseline, round(a.value - b.value, 6) AS delta
    FROM (SELECT metric, epoch, max(value) AS value FROM {LONG} WHERE run_id > 5 GROUP BY 1, 2) a
    FULL JOIN (SELECT metric, epoch, min(value) AS value FROM {LONG} WHERE run_id <= 5 GROUP BY 1, 2) b ON a.metric = b.metric AND a.epoch = b.epoch""",
)
def _(spark, sf):
    # The best value per epoch of the newer runs against the lowest of the first six.
    d = metrics(spark, sf)
    run = d.filter("run_id > 5").groupBy("metric", "epoch").agg(F.max("value").alias("value"))
    base = d.filter("run_id <= 5").groupBy("metric", "epoch").agg(F.min("value").alias("value"))
    return trn.compare_runs(run, base).select(
        "metric", "epoch", "value", "baseline", *r6("delta")
    )


@query(
    "run_summary",
    f"""SELECT run_id, metric, count(*) AS epochs, CASE WHEN metric = 'box_loss' THEN arg_min(epoch, (value, epoch)) ELSE arg_max(epoch, (value, -epoch)) END AS best_epoch,
    CASE WHEN metric = 'box_loss' THEN min(value) ELSE max(value) END AS best_value, max(epoch) AS last_epoch, arg_max(value, epoch) AS last_value,
    max(epoch) - CASE WHEN metric = 'box_loss' THEN arg_min(epoch, (value, epoch)) ELSE arg_max(epoch, (value, -epoch)) END AS epochs_since_best,
    max(epoch) - CASE WHEN metric = 'box_loss' THEN arg_min(epoch, (value, epoch)) ELSE arg_max(epoch, (value, -epoch)) END >= 50 AS stop_due
    FROM {LONG} GROUP BY 1, 2""",
)
def _(spark, sf):
    return trn.run_summary(metrics(spark, sf))


LOG = view("training_log")
# The generated log's own rules: a run opens at line 6, epochs start at line 10 and repeat every 19 lines.
PARSED = f"""(SELECT run_id, line_no, ts, line, CASE WHEN line_no >= 10 THEN 'training' WHEN line_no >= 6 THEN 'starting' ELSE 'preparing' END AS phase,
CASE WHEN line_no >= 10 THEN (line_no - 10) // 19 + 1 ELSE 0 END AS epoch, CAST(10 AS BIGINT) AS total_epochs,
line_no >= 10 AND (line_no - 10) % 19 = 0 AS is_epoch_line,
line_no >= 10 AND (line_no - 10) % 19 NOT IN (0, 7) AS is_batch, (line_no - 10) % 19 + 1 AS b FROM {LOG})"""
PARSED_OUT = f"""(SELECT *, CASE WHEN is_batch THEN b ELSE 0 END AS batch, CASE WHEN is_batch THEN 20 ELSE 0 END AS batches, CASE WHEN is_batch THEN 1.67::DOUBLE ELSE 0 END AS its_per_sec,
CASE WHEN is_epoch_line THEN CAST(floor(epoch / 10.0::DOUBLE * 100) AS BIGINT)
WHEN is_batch THEN CAST(least(100, floor((epoch - 1) / 10.0::DOUBLE * 100 + b * 5 / 100.0::DOUBLE * (1 / 10.0::DOUBLE) * 100)) AS BIGINT) ELSE 0 END AS percent FROM {PARSED})"""


@query(
    "parse_training_log",
    f"""SELECT run_id, line_no, phase, {sql_big('epoch', 'total_epochs', 'batch', 'batches', 'percent')}, is_epoch_line, its_per_sec FROM {PARSED_OUT}""",
)
def _(spark, sf):
    d = trn.parse_training_log(table(spark, sf, "training_log"), 10)
    d = d.fillna(0, ["batch", "batches", "percent", "its_per_sec"])
    return d.select(
        "run_id", "line_no", "phase", *big("epoch", "total_epochs", "batch", "batches", "percent"),
        "is_epoch_line", "its_per_sec",
    )


@query(
    "training_eta",
    f"""SELECT run_id, line_no, elapsed_s, training_s, round(coalesce(CASE WHEN epoch > 0 AND training_s > 0 THEN CASE WHEN epoch < 10 THEN training_s / epoch * (10 - epoch) END
    WHEN epoch > 0 AND its_per_sec > 0 THEN ((batches - batch) + (10 - epoch) * batches) / its_per_sec
    WHEN percent > 5 THEN elapsed_s / percent * (100 - percent) END, -1), 6) AS remaining_s FROM
    (SELECT *, CAST(line_no * 2 AS DOUBLE) AS elapsed_s, CASE WHEN epoch > 0 THEN CAST((line_no - 10) * 2 AS DOUBLE) ELSE 0 END AS training_s FROM {PARSED_OUT})""",
)
def _(spark, sf):
    d = trn.log_eta(trn.parse_training_log(table(spark, sf, "training_log"), 10))
    return d.fillna(-1.0, ["remaining_s"]).select(
        "run_id", "line_no", "elapsed_s", "training_s", *r6("remaining_s")
    )


@query(
    "read_training_log",
    """SELECT 'run=' || CAST(event_id // 1000 AS VARCHAR) AS run_id, CASE WHEN event_id % 5 > 0 THEN event_id ELSE -1 END AS line_no,
    CASE WHEN event_id % 5 > 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') END AS ts,
    CASE WHEN event_id % 5 > 0 THEN event_type || chr(9) || props ELSE event_type || ' alone' END AS line,
    CASE WHEN event_id % 5 > 0 THEN '' ELSE 'no record' END AS reason FROM events""",
)
def _(spark, sf):
    """Records whose text holds a tab, and every fifth line without a number and a time."""
    at = F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    record = F.concat_ws("\t", F.col("event_id").cast("string"), at, "event_type", "props")
    lines = raw(spark, sf, "events").select(
        F.floor(F.col("event_id") / 1000).alias("run"),
        F.when(F.col("event_id") % 5 > 0, record).otherwise(F.concat("event_type", F.lit(" alone"))).alias("value"),
    )
    folder = f"{shared_folder(spark)}/log-{uuid.uuid4().hex}"
    lines.repartition("run").write.partitionBy("run").text(folder)
    good, bad = runs.read_training_log(spark, folder, pattern="*.txt")
    good = good.withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).withColumn("reason", F.lit(""))
    bad = bad.withColumnRenamed("value", "line").withColumn("line_no", F.lit(-1).cast("bigint"))
    return good.unionByName(bad, allowMissingColumns=True)


@query(
    "read_plain_log",
    """SELECT 'run=' || CAST(event_id // 1000 AS VARCHAR) AS run_id, event_type || chr(9) || CAST(event_id AS VARCHAR) AS line,
    row_number() OVER (PARTITION BY event_id // 1000 ORDER BY event_id) - 1 AS line_no FROM events""",
)
def _(spark, sf):
    """A thousand lines a run, written in order."""
    lines = raw(spark, sf, "events").select(
        F.floor(F.col("event_id") / 1000).alias("run"), "event_id",
        F.concat_ws("\t", "event_type", F.col("event_id").cast("string")).alias("value"),
    )
    folder = f"{shared_folder(spark)}/log-{uuid.uuid4().hex}"
    ordered = lines.repartition("run").sortWithinPartitions("run", "event_id")
    ordered.select("run", "value").write.partitionBy("run").text(folder)
    return runs.read_plain_log(spark, folder, pattern="*.txt").select("run_id", "line", "line_no")
