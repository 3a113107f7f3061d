"""Readers and sinks on small files."""

import json

import pytest
from pyspark.sql import functions as F

from sightline.operators import scoring
from sightline.operators.calibration import latest_homography
from sightline.operators.training import parse_training_log
from sightline.plans import source_queries
from sightline.sources import calibrations, media, records, results, runs


def test_video_catalog(spark, tmp_path):
    for name in ("a/2.MP4", "a/1.mov", "a/note.txt", "b/0.webm", "a/deep/9.mp4"):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"x")
    got = media.video_catalog(spark, [str(tmp_path / "a"), str(tmp_path / "b")]).collect()
    assert [r["path"].rsplit("/", 2)[-2:] for r in got] == [["a", "1.mov"], ["a", "2.MP4"], ["b", "0.webm"]]


def test_dataset_inventory(spark, tmp_path):
    for name in ("train/images/a.jpg", "train/images/b.PNG", "train/labels/a.txt", "valid/images/c.jpg"):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"x")
    got = {r["split"]: r["images"] for r in media.dataset_inventory(spark, str(tmp_path)).collect()}
    assert got == {"train": 2, "valid": 1}


@pytest.mark.parametrize("names", ["names: ['disc', \"player\"]", "names:\n- disc\n- player"])
def test_dataset_classes(spark, tmp_path, names):
    (tmp_path / "data.yaml").write_text(f"train: ../train\nnc: 2\n{names}\nroboflow: x\n")
    got = media.dataset_classes(spark, str(tmp_path / "data.yaml")).orderBy("class_id").collect()
    assert [(r["class_id"], r["class_name"]) for r in got] == [(0, "disc"), (1, "player")]


def test_detections_batch_and_stream(spark, tmp_path):
    d = spark.createDataFrame(
        [(1, 0, 0, 1, 2, 3, 4, 0.5, 1, "player", "player_model")],
        "video_id long, frame_idx long, det_idx long, x1 int, y1 int, x2 int, y2 int, "
        "confidence double, class_id int, class_name string, model_type string",
    )
    d.write.parquet(str(tmp_path / "d"))
    assert records.read_detections(spark, str(tmp_path / "d")).collect() == d.collect()
    assert records.read_detections(spark, str(tmp_path / "d"), streaming=True).isStreaming


def test_contours(spark, tmp_path):
    d = spark.sql("SELECT 1L video_id, 2L frame_idx, 0 contour_id, array(struct(1d x, 2d y), struct(3d x, 4d y)) points")
    d.write.parquet(str(tmp_path / "c"))
    got = records.read_contours(spark, str(tmp_path / "c")).orderBy("pt_idx").collect()
    assert [(r["pt_idx"], r["x"], r["y"]) for r in got] == [(0, 1.0, 2.0), (1, 3.0, 4.0)]


def test_ocr_encodings(spark, tmp_path):
    texts = [
        {"bbox": [[0, 0], [4, 0], [4, 2], [0, 2]], "text": "7", "conf": 0.9},
        {"bbox": [1, 2, 5, 6], "text": "8", "conf": 0.8},
    ]
    row = [(1, 0, 3, 40, json.dumps(texts))]
    spark.createDataFrame(
        row, "video_id long, frame_idx long, track_id long, crop_width int, results string"
    ).write.parquet(str(tmp_path / "o"))
    first, second = records.read_ocr(spark, str(tmp_path / "o")).first()["results"]
    assert [tuple(p) for p in first["poly"]] == [(0, 0), (4, 0), (4, 2), (0, 2)]
    assert [tuple(p) for p in second["poly"]] == [(1, 2), (5, 2), (5, 6), (1, 6)]


def _calibration(spark, video, stamp, h02):
    return spark.sql(
        f"SELECT {video}L video_id, 3L frame_index, timestamp'{stamp}' created_at, 1d h00, 0d h01, "
        f"{h02}d h02, 0d h10, 1d h11, 0d h12, 0d h20, 0d h21"
    )


def test_calibration_registry(spark, tmp_path):
    path = str(tmp_path / "registry")
    calibrations.save_homography(_calibration(spark, 1, "2024-01-02", 5), path)
    calibrations.save_homography(_calibration(spark, 1, "2024-01-01", 9), path, "older")
    saved = calibrations.read_homographies(spark, path)
    assert saved.count() == 2
    assert latest_homography(saved).first()["h02"] == 5.0
    videos = spark.createDataFrame([(1,), (2,)], "video_id long")
    got = latest_homography(saved, videos, {"h00": 2.0}).orderBy("video_id").collect()
    assert [(r["h00"], r["is_default"]) for r in got] == [(1.0, False), (2.0, True)]


def test_calibration_json_nested_and_flat(spark, tmp_path):
    nested = {
        "homography_parameters": {"H00": 3.5, "H02": -7.0},
        "metadata": {"video_id": 1, "created_at": "2024-01-01T00:00:00", "frame_index": 20},
    }
    (tmp_path / "n.json").write_text(json.dumps(nested))
    flat = {"video_id": 2, "created_at": "2024-01-01T00:00:00", "frame_index": 1, "H00": 4.5}
    (tmp_path / "f.json").write_text(json.dumps(flat))
    got = calibrations.read_homographies(spark, str(tmp_path), "json").orderBy("video_id").collect()
    assert [(r["video_id"], r["h00"], r["h02"], r["h11"]) for r in got] == [
        (1, 3.5, -7.0, 1.0), (2, 4.5, 0.0, 1.0),
    ]


def test_training_metrics(spark, tmp_path):
    for run, text in (
        ("r1", "epoch, train/box_loss, metrics/mAP50\n1, 0.5, 0.1\n2, 0.4, 0.2\n"),
        ("r2", "epoch,train/box_loss\n1,0.9\n"),
    ):
        (tmp_path / run).mkdir()
        (tmp_path / run / "results.csv").write_text(text)
        (tmp_path / run / "args.csv").write_text("x\n1\n")
    got = runs.read_training_metrics(spark, str(tmp_path)).collect()
    assert sorted((r["run_id"], r["epoch"], r["metric"], r["value"]) for r in got) == [
        ("r1", 1, "metrics/mAP50", 0.1), ("r1", 1, "train/box_loss", 0.5),
        ("r1", 2, "metrics/mAP50", 0.2), ("r1", 2, "train/box_loss", 0.4),
        ("r2", 1, "train/box_loss", 0.9),
    ]


def test_metric_stream(spark, tmp_path):
    run = tmp_path / "in" / "r1"
    run.mkdir(parents=True)
    (run / "1.csv").write_text("epoch,loss\n1,0.5\n")
    (run / "2.csv").write_text("epoch,loss\n2,0.4\n")
    (run / "3.csv").write_text("\nacc, epoch\r\n0.9,3\r\n\r\n")
    stream = runs.stream_training_metrics(spark, str(tmp_path / "in"))
    q = stream.writeStream.format("memory").queryName("metrics").trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.table("metrics").orderBy("epoch").collect()
    assert [(r["run_id"], r["epoch"], r["metric"], r["value"]) for r in got] == [
        ("r1", 1, "loss", 0.5), ("r1", 2, "loss", 0.4), ("r1", 3, "acc", 0.9),
    ]


def test_training_metrics_over_many_blocks(spark, tmp_path):
    for run, names in (("a", "epoch,loss"), ("b", "loss,epoch")):
        (tmp_path / run).mkdir()
        lines = [f"{i},{i}.0" if run == "a" else f"{i}.0,{i}" for i in range(2000)]
        (tmp_path / run / "results.csv").write_text("\n".join(["", names, *lines]) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        got = runs.read_training_metrics(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(got) == 4000 and all(r["metric"] == "loss" and r["value"] == r["epoch"] for r in got)


def test_training_metrics_of_short_and_long_files(spark, tmp_path):
    """Short files, read whole and without a shuffle, have the rows they have line by line."""
    texts = {"bom": "\ufeffepoch,loss\n1,0.5\n", "mac": "epoch,loss\r2,0.5\r\r3,0.25", "dos": "\r\n loss , epoch\r\n0.5,4\r\n", "none": "",
             "long": "epoch,acc\n" + "".join(f"{i},{i}.5\n" for i in range(100))}
    for run, text in texts.items():
        (tmp_path / "a" / run).mkdir(parents=True)
        (tmp_path / "a" / run / "results.csv").write_bytes(text.encode())
    read = [runs.read_training_metrics(spark, str(tmp_path), whole=whole) for whole in (1 << 20, 0, 100)]
    rows = [sorted(map(tuple, d.collect())) for d in read]
    assert len(rows[0]) == 104 and rows[0] == rows[1] == rows[2]
    assert rows[0][:2] == [("a/bom", 1, "loss", 0.5), ("a/dos", 4, "loss", 0.5)]
    plan = read[0]._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Exchange" in read[1]._jdf.queryExecution().executedPlan().toString()
    q = runs.stream_training_metrics(spark, str(tmp_path)).writeStream.format("memory").queryName("short_files")
    q.trigger(availableNow=True).start().awaitTermination()
    assert sorted(map(tuple, spark.table("short_files").collect())) == rows[0]


def test_training_log(spark, tmp_path):
    (tmp_path / "r1").mkdir()
    text = "0\t2024-01-01 00:00:00\tscanning \"x\"\n1\t2024-01-01 00:00:09\t3/50  1.2G\n"
    text += "2\t2024-01-01 00:00:10\tone\ttwo\tthree\n\nno record\nx\t2024-01-01 00:00:11\tno number\n3\tsoon\tno time\n"
    (tmp_path / "r1" / "train.log").write_text(text)
    d, bad = runs.read_training_log(spark, str(tmp_path))
    assert d.filter("line_no = 2").first()["line"] == "one\ttwo\tthree"
    assert sorted((r["reason"], r["value"][:2]) for r in bad.collect()) == [("no number", "x\t"), ("no record", "no"), ("no time", "3\t")]
    got = parse_training_log(d.filter("line_no < 2")).orderBy("line_no").collect()
    assert [(r["run_id"], r["phase"], r["epoch"]) for r in got] == [
        ("r1", "preparing", 0), ("r1", "training", 3),
    ]


def test_plain_log_over_many_blocks(spark, tmp_path):
    for run in ("a/r1", "b/r1"):
        (tmp_path / run).mkdir(parents=True)
        (tmp_path / run / "train.log").write_text("".join(f"{run} {i}\n" for i in range(3000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
    try:
        got = runs.read_plain_log(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(got) == 6000 and all(r["line"] == f"{r['run_id']} {r['line_no']}" for r in got)


def test_results_sink(spark, tmp_path):
    d = spark.range(4).select(
        (F.col("id") % 2).alias("video_id"), F.col("id").alias("frame_idx"),
        F.md5(F.col("id").cast("string")).alias("content_hash"), F.lit("True|False").alias("settings_key"),
    )
    results.write_results(d, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).filter("video_id = 1").count() == 2
    with pytest.raises(ValueError):
        results.write_results(d.drop("content_hash"), str(tmp_path / "out"))
    source = str(tmp_path / "src")
    d.write.parquet(source)
    stream = spark.readStream.schema(d.schema).parquet(source)
    results.stream_results(stream, str(tmp_path / "s"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "s")).count() == 4


def test_results_are_stored_once(spark, tmp_path):
    store = str(tmp_path / "store")
    assert results.read_results(spark, store) is None
    rows = [(1, "a", "x", 1), (1, "a", "x", 2), (1, None, "x", 3), (2, "a", "x", 4), (1, "a", None, 5)]
    d = spark.createDataFrame(rows, "video_id long, content_hash string, settings_key string, batch_known long")
    results.save_results(d.where("batch_known < 3"), store, "first")
    results.save_results(d.where("batch_known < 4"), store, "first")  # again, with more
    results.save_results(d, store, "second")
    results.save_results(d, store, "second")
    got = sorted((r["batch_known"], r["batch"]) for r in results.read_results(spark, store).collect())
    assert got == [(1, "first"), (2, "first"), (3, "first"), (4, "second"), (5, "second")]


def test_detect_with_stub_models(spark):
    from sightline.plans.scoring_queries import stub_detector

    frames = spark.range(6).select(
        F.lit(1).cast("long").alias("video_id"), F.col("id").alias("frame_idx"),
        F.col("id").cast("float").alias("n"),
    )
    got = scoring.detect(frames, stub_detector, stub_detector, ["n"])
    assert got.filter("confidence < 0.3").count() == 0
    assert {r["model_type"] for r in got.collect()} == {"player_model", "disc_model"}


def test_metric_files_are_written_by_many_tasks(spark):
    """Small as the rows are, their files are not all left to one task."""
    folder = source_queries._written_metrics(spark, "/root/testdata/sf0.001")
    files = spark.read.option("recursiveFileLookup", "true").text(folder).select("_metadata.file_name").distinct().collect()
    assert len({r.file_name[:10] for r in files}) > 1


def test_metric_files_start_no_process_each(spark):
    """Spark's writer starts some eight processes for each file; the tasks write their files themselves."""
    def forks():
        with open("/proc/stat") as f:
            return int(next(line for line in f if line.startswith("processes")).split()[1])

    source_queries._written_metrics(spark, "/root/testdata/sf0.001")  # starts the workers
    before = forks()
    folder = source_queries._written_metrics(spark, "/root/testdata/sf0.01")
    made = forks() - before
    files = spark.read.option("recursiveFileLookup", "true").text(folder, wholetext=True)
    assert files.select("_metadata.file_path").distinct().count() == 188 and made < 3 * 188
