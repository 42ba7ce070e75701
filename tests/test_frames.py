import random

import pytest

from trackmill.operators import frames
from trackmill.operators.detections import explode_messages, observations
from trackmill.operators.prefix import running_totals

BOXES = (
    "run_id string, frame_number bigint, seq bigint, timestamp_seconds double, "
    "raw_track_id bigint, class_id bigint, confidence double, "
    "x1 double, y1 double, x2 double, y2 double"
)


def box(frame, track, run="run-a", label=0, x1=1.005, y1=2.0, x2=11.0, y2=22.5, seq=0):
    return (run, frame, seq, frame / 30, track, label, 0.123456, x1, y1, x2, y2)


def tables(spark, frame_rows, box_rows):
    return (
        spark.createDataFrame(frame_rows, "run_id string, frame_number bigint"),
        spark.createDataFrame(box_rows, BOXES),
    )


def test_observations_use_unrounded_corners(spark):
    classes = spark.createDataFrame([(0, "person")], "class_id bigint, label string")
    boxes = spark.createDataFrame([box(1, 7), box(2, None), box(3, 8, label=9)], BOXES)
    got = observations(boxes, classes).orderBy("frame_number").collect()
    assert [(r.track_id, r.label) for r in got] == [(7, "person"), (8, None)]
    row = got[0]
    assert (row.timestamp_seconds, row.confidence) == (0.033, 0.1235)
    assert (row.width, row.height) == (round(11.0 - 1.005, 2), 20.5)
    assert (row.center_x, row.center_y) == (round(1.005 + (11.0 - 1.005) / 2, 2), 12.25)
    assert row.x1 == round(1.005, 2)


def test_detection_messages(spark):
    rows = spark.createDataFrame(
        [("cam", 1.0, [(1, "car", 0.5, 1.0, 2.0, 3.0, 4.0), (2, "bus", 0.6, 0.0, 0.0, 1.0, 1.0)]),
         ("cam", 2.0, [])],
        "sensor_id string, timestamp double, detections array<struct<object_id: bigint, "
        "label: string, confidence: double, x: double, y: double, width: double, height: double>>")
    assert [(r.object_id, r.label) for r in explode_messages(rows).collect()] == [
        (1, "car"), (2, "bus")]


def test_empty_frames_count(spark):
    frame_rows, boxes = tables(
        spark, [("run-a", i) for i in range(1, 5)], [box(1, 7), box(1, 8), box(2, None), box(4, 7)]
    )
    got = frames.frame_activity(frame_rows, boxes).orderBy("frame_number").collect()
    assert [(r.boxes, r.observation_rows, r.active_tracks) for r in got] == [
        (2, 2, 2), (1, 0, 0), (0, 0, 0), (1, 1, 1)]
    totals = frames.run_totals(frame_rows, boxes).first()
    assert tuple(totals)[1:] == (4, 4, 3, 2)


@pytest.mark.parametrize("width", [1, 7, 50_000])
def test_running_values_against_brute_force(spark, width):
    rng = random.Random(3)
    lengths = {"run-a": 120, "run-b": 30}
    frame_rows = [(run, i) for run, n in lengths.items() for i in range(1, n + 1)]
    box_rows = [
        box(i, rng.choice([None, *range(15)]), run) for run, i in frame_rows
        for _ in range(rng.randrange(4))
    ]
    expected = {}
    for run in lengths:
        seen, count, rows = set(), 0, 0
        for i in range(1, lengths[run] + 1):
            here = [b for b in box_rows if b[0] == run and b[1] == i]
            ids = {b[4] for b in here if b[4] is not None}
            new = len(ids - seen)
            seen |= ids
            count += len(here)
            rows += sum(b[4] is not None for b in here)
            expected[run, i] = (len(here), len(ids), new, i, count, rows, len(seen))
    running = frames.running_activity(*tables(spark, frame_rows, box_rows), width)
    got = {
        (r.run_id, r.frame_number): (
            r.boxes, r.active_tracks, r.new_tracks, r.running_frames, r.running_boxes,
            r.running_rows, r.running_unique_tracks)
        for r in running.collect()
    }
    assert got == expected
    samples = frames.progress_samples(running).collect()
    assert sorted((r.run_id, r.frames, r.unique_tracks) for r in samples) == sorted(
        (run, i, v[6]) for (run, i), v in expected.items() if i % 25 == 0)


def test_running_totals_handle_gaps(spark):
    rows = spark.createDataFrame(
        [("a", 5, 1), ("a", 100_000_000_000, 2), ("a", 7, 4), ("b", 1, 8)],
        "k string, p bigint, v bigint")
    got = running_totals(rows, "k", "p", ["v"], 10).collect()
    assert sorted((r.k, r.p, r.running_v) for r in got) == [
        ("a", 5, 1), ("a", 7, 5), ("a", 100_000_000_000, 7), ("b", 1, 8)]
