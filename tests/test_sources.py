"""Readers and writers on small generated folders, tags, change masks, streams."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from seqlens.functions import scalar
from seqlens.operators import change, joins, review, shape
from seqlens.sources import files
from seqlens.streaming import cameras


def put(path, text="image"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def test_scan_sequences(spark, tmp_path):
    for name in ("wildfire/s1/images/c_2024-01-01T00-00-30.jpg", "wildfire/s1/images/c_2024-01-01T00-00-00.jpg", "fp/s2/images/x.jpg"):
        put(tmp_path / name)
    rows = files.scan_sequences(spark, str(tmp_path), "val").orderBy("sequence_id", "frame_idx").collect()
    assert [(r.sequence_id, r.frame_idx, r.label, r.frame_id) for r in rows] == [("s1", 0, True, "c_2024-01-01T00-00-00"), ("s1", 1, True, "c_2024-01-01T00-00-30"), ("s2", 0, False, "x")]
    assert rows[1].ts == dt.datetime(2024, 1, 1, 0, 0, 30) and rows[2].ts is None and rows[0].split == "val"


def test_scan_export(spark, tmp_path):
    for name in ("smoke/day/s1/images/a.jpg", "unsure/s2/images/a.jpg", "fp/cloud/s3/labels/a.txt"):
        put(tmp_path / "export" / name)
    kept, dropped = files.scan_export(spark, str(tmp_path / "export"))
    assert [(r["class"], r.category, r.sequence_id) for r in kept.collect()] == [("smoke", "day", "s1")]
    assert {(r.sequence_id, r.reason) for r in dropped.collect()} == {("s2", "unsure"), ("s3", "no_images")}


def test_flat_frames_and_labels(spark, tmp_path):
    put(tmp_path / "images/a.jpg"), put(tmp_path / "images/b.jpg")
    put(tmp_path / "labels/a.txt", "0 0.5 0.5 0.1 0.1\nbad line\n1.0 0.4 0.5 0.1 0.1 0.9\n")
    rows = {r.stem: r.boxes for r in files.scan_frames(spark, str(tmp_path)).collect()}
    assert [b.class_id for b in rows["a"]] == [0, 1] and rows["b"] == []


@pytest.mark.parametrize(("mode", "want"), [("strict", [(0, 1.0), (0, 0.7)]), ("truth", [(0, 1.0)]), ("lenient", [(0, 1.0), (0, 1.0), (2, 1.0)])])
def test_label_modes(spark, mode, want):
    lines = spark.createDataFrame([("0 0.5 0.5 0.1 0.1",), ("0 0.5 0.5 0.1 0.1 0.7",), ("2.0 0.5 0.5 0.1 0.1",), ("0 0.5 0.5 0.1",), ("x y z a b",), ("",), (None,)], "line string")
    assert [(r.class_id, r.confidence) for r in files.parse_labels(lines, mode).collect()] == want


def test_detection_cache_round_trip(spark, tmp_path):
    det = {"class_id": 0, "cx": 0.5, "cy": 0.5, "w": 0.1, "h": 0.1, "confidence": 0.9}
    put(tmp_path / "in/s1.json", json.dumps([{"frame_id": "a", "timestamp": "2024-01-01T00:00:00", "detections": [det, det]}, {"frame_id": "b", "timestamp": "2024-01-01T00:00:30", "detections": []}]))
    rows = files.read_detection_cache(spark, str(tmp_path / "in"))
    assert [(r.frame_id, r.det_idx) for r in rows.orderBy("frame_idx", "det_idx").collect()] == [("a", 0), ("a", 1), ("b", None)]
    files.write_detection_cache(rows.withColumn("split", F.lit("val")), str(tmp_path / "out"))
    back = {r.frame_id: len(r.detections) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert back == {"a": 2, "b": 0}


def test_corner_cache(spark, tmp_path):
    put(tmp_path / "s.json", json.dumps([{"filename": "a.jpg", "detections": [[0.1, 0.2, 0.3, 0.6, 0.8]]}, {"filename": "b.jpg", "detections": []}]))
    rows = files.read_corner_cache(spark, str(tmp_path)).orderBy("frame_idx").collect()
    assert [round(rows[0][c], 6) for c in ("cx", "cy", "w", "h", "confidence")] == [0.2, 0.4, 0.2, 0.4, 0.8] and rows[1].cx is None


def test_predictions_allow_infinity(spark, tmp_path):
    put(tmp_path / "p.json", '[{"sequence_id": "b", "label": "smoke", "score": -Infinity, "tube_logits": []}, {"sequence_id": "a", "label": "fp", "score": 1.5, "tube_logits": [1.5]}]')
    rows = files.read_predictions(spark, str(tmp_path / "p.json"))
    assert [(r.sequence_id, r.score) for r in rows.collect()] == [("a", 1.5), ("b", float("-inf"))]
    files.write_predictions(rows, str(tmp_path / "out"))
    assert {r.sequence_id: r.score for r in spark.read.schema("sequence_id string, score double").json(str(tmp_path / "out")).collect()} == {"a": 1.5, "b": None}


def test_tube_records_round_trip(spark, tmp_path):
    records = spark.createDataFrame([("s", 0, 0, 1, [(0, False, 0, 0.5, 0.5, 0.1, 0.1, 0.9), (1, True, 0, 0.5, 0.5, 0.1, 0.1, 0.0)])], "sequence_id string, tube_id int, start_frame int, end_frame int, entries array<struct<frame_idx: int, is_gap: boolean, class_id: int, cx: double, cy: double, w: double, h: double, confidence: double>>")
    judged = spark.createDataFrame([("s", None), ("t", "no_tubes")], "sequence_id string, reason string")
    files.write_tubes(records, judged, str(tmp_path / "t"))
    assert files.read_tubes(spark, str(tmp_path / "t")).collect() == records.collect()
    assert {r.reason: r.n for r in spark.read.json(str(tmp_path / "t/summary")).collect()} == {"kept": 1, "no_tubes": 1}


def test_latest_log(spark, tmp_path):
    put(tmp_path / "version_2/metrics.csv", "epoch,train_loss\n0,0.5\n"), put(tmp_path / "version_10/metrics.csv", "epoch,train_loss\n0,0.1\n1,\n")
    rows = files.latest_training_log(spark, str(tmp_path)).orderBy("epoch").collect()
    assert [(r.version, r.epoch, r.train_loss) for r in rows] == [(10, 0, 0.1), (10, 1, None)]


def test_text_table(spark, tmp_path):
    rows = spark.createDataFrame([("m", 0.5, None)], "name string, f1 double, ttd double")
    files.write_text_table(rows, [("name", 4), ("f1", 7), ("ttd", 5)], str(tmp_path / "t"))
    assert spark.read.text(str(tmp_path / "t")).first()[0] == "m      0.500     -"
    files.write_csv(rows, str(tmp_path / "c")), files.write_json(rows, str(tmp_path / "j"))
    assert spark.read.option("header", "true").csv(str(tmp_path / "c")).count() == 1


def test_truncated_copy(spark, tmp_path):
    frames = spark.createDataFrame([("s", f"f{i}") for i in range(5)], "sequence_id string, frame_id string")
    files.truncated_copy(frames, frames.withColumn("line", F.lit("x")), 2, str(tmp_path))
    assert sorted(r.frame_id for r in spark.read.parquet(str(tmp_path / "labels")).collect()) == ["f0", "f1"]


def test_strict_time_raises(spark):
    rows = spark.createDataFrame([("nothing",)], "f string")
    assert rows.select(scalar.frame_time("f")).first()[0] is None
    with pytest.raises(Exception, match="no timestamp"):
        rows.select(scalar.frame_time("f", strict=True)).collect()


def test_export_gate(spark, tmp_path):
    good = spark.createDataFrame([("dq-frame_yolo_val", "a", ["label:ok", "label:ok", "reviewer:x"]), ("dq-frame_yolo_val", "b", [])], "dataset string, stem string, tags array<string>")
    bad = good.unionByName(spark.createDataFrame([("d", "c", ["lable:ok"])], good.schema))
    with pytest.raises(ValueError, match="lable:ok"):
        review.export(bad, review.VOCABULARY, str(tmp_path / "x"))
    assert not (tmp_path / "x").exists()
    review.export(good, review.VOCABULARY, str(tmp_path / "x"))
    assert (tmp_path / "x/model=yolo/split=val").exists()
    found = {r.tag: r.suggestion for r in review.suggestions(bad.select(F.explode("tags").alias("tag")), review.VOCABULARY).collect()}
    assert found["lable:ok"] == "label:ok" and found["reviewer:x"] is None


def test_change_validation_guards(spark):
    frames = spark.createDataFrame([(1, 0, 2, 2, [0, 0, 0, 0]), (1, 1, 2, 2, [20, 19, 0, 0]), (1, 2, 2, 2, None), (1, 3, 2, 2, [99] * 4), (1, 4, 1, 4, [0] * 4), (1, 5, 1, 4, [0] * 4)], "sequence_id long, frame_idx int, height int, width int, px array<int>")
    boxes = spark.createDataFrame([(1, i, 0, 0.5, 0.5, 1.0, 1.0, 0.9) for i in range(6)], "sequence_id long, frame_idx int, det_idx int, cx double, cy double, w double, h double, confidence double")
    got = {r.frame_idx: r.change_ratio for r in change.change_ratios(frames, boxes, [19]).collect()}
    assert got == {0: None, 1: 0.25, 2: None, 3: None, 4: None, 5: 0.0}
    assert [r.frame_idx for r in change.validate(frames, boxes, 19, 0.1).collect()] == [1]
    empty = boxes.withColumn("w", F.lit(0.0))
    assert change.change_ratios(frames, empty, [19]).where("frame_idx = 1").first().change_ratio == 0.0


def test_box_evaluation(spark):
    pred = spark.createDataFrame([("a", 0, 0.5, 0.5, 0.2, 0.2, 0.6), ("a", 1, 0.5, 0.5, 0.2, 0.2, 0.9), ("b", 0, 0.1, 0.1, 0.1, 0.1, 0.5)], "stem string, pred_idx int, cx double, cy double, w double, h double, confidence double")
    gt = spark.createDataFrame([("a", 0, 0.5, 0.5, 0.2, 0.2), ("c", 0, 0.5, 0.5, 0.1, 0.1)], "stem string, gt_idx int, cx double, cy double, w double, h double")
    got = {(r.stem, r.pred_idx, r.gt_idx, r.verdict) for r in joins.evaluate_boxes(pred, gt, 0.5).collect()}
    assert got == {("a", 1, 0, "tp"), ("a", 0, None, "fp"), ("b", 0, None, "fp"), ("c", None, 0, "fn")}


def test_augment_is_repeatable(spark):
    entries = spark.createDataFrame([(s, 0, i) for s in range(20) for i in range(12)], "sequence_id long, tube_id int, frame_idx int")
    one, two = (sorted(map(tuple, shape.augment(entries, seed=1).collect())) for _ in range(2))
    assert one == two and one != sorted(map(tuple, shape.augment(entries, seed=1, epoch=1).collect()))
    slots = {}
    for s, _, at, slot in one:
        slots.setdefault(s, []).append((slot, at))
    assert all([x[0] for x in sorted(v)] == list(range(len(v))) and len(v) >= 2 and sorted(v) == sorted(v, key=lambda x: x[1]) for v in slots.values())


def test_sessions_batch_like_window(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(c, f"f{i}", t0 + dt.timedelta(seconds=s)) for c in (1, 2) for i, s in enumerate([0, 30, 60, 400, 430, 2000])]
    frames = spark.createDataFrame(rows, "camera long, frame_id string, ts timestamp")
    batch = frames.transform(lambda f: cameras.sessions_batch(f, 120)).groupBy("camera", "session_id").count()
    window = cameras.sessions(frames, "120 seconds")
    assert sorted(r["count"] for r in batch.collect()) == sorted(r.n_frames for r in window.collect()) == [1, 1, 2, 2, 3, 3]
