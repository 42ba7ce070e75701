"""Archives keep documents as they are; frames that boxes invent are none."""

import json

from fixtures import documents, manifest

from trackmill.operators import frames
from trackmill.sources import documents as docs


def test_documents_of_several_lines_come_back_byte_by_byte(spark, tmp_path):
    plain = manifest("run-a")
    texts = {
        "run-a": json.dumps(plain),
        "run-b": json.dumps(manifest("run-b"), indent=2),
        "run-c": "\r\n" + json.dumps(manifest("run-c"), indent="\t") + "\n\n",
        "run-d": '{"run_id": "run-d", "note": "é\\n\\u001e   end"}',
    }
    frame = spark.createDataFrame([*texts.items(), ("run-x", None)], "run_id string, manifest_json string")
    docs.write_manifests(frame.repartition(2), str(tmp_path / "archive"))
    assert {r.run_id: r.manifest_json for r in docs.read_archive(spark, str(tmp_path / "archive")).collect()} == texts
    assert documents(spark, plain).count() == 1


def test_large_archive_is_read_by_several_tasks(spark, tmp_path):
    body = spark.range(3000).selectExpr(
        "concat('run-', id) as run_id", "concat('{\n \"run_id\": \"run-', id, '\",\n \"pad\": \"', repeat('x', 500), '\"\n}') as manifest_json")
    docs.write_manifests(body.coalesce(1), str(tmp_path / "archive"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    try:
        got = docs.read_archive(spark, str(tmp_path / "archive"))
        assert got.rdd.getNumPartitions() > 5
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, body.collect()))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_boxes_make_no_frames(spark):
    known = spark.createDataFrame([("r", n) for n in (1, 2, 4)], "run_id string, frame_number long")
    boxes = [("r", 1, 7), ("r", 3, 8), ("r", 3, None), ("r", 4, 8), ("s", 1, 9)]  # frame 3 and run s were never recorded
    boxes = spark.createDataFrame(boxes, "run_id string, frame_number long, raw_track_id long")
    activity = {tuple(r)[:2]: tuple(r)[2:] for r in frames.frame_activity(known, boxes).collect()}
    assert activity == {("r", 1): (1, 1, 1), ("r", 2): (0, 0, 0), ("r", 4): (1, 1, 1)}
    running = frames.running_activity(known, boxes).orderBy("frame_number").collect()
    assert [(r.running_frames, r.running_boxes, r.running_unique_tracks) for r in running] == [(1, 1, 1), (2, 1, 1), (3, 2, 2)]
    lost = frames.boxes_without_frame(known, boxes).collect()
    assert sorted(map(tuple, lost)) == [("r", 3, 2, 1), ("s", 1, 1, 1)]
