"""Streams whose recordings close: bounded state, a bounded log, totals equal to the batch result."""

import pytest
from pyspark.sql import functions as F

from trackmill.operators import frames
from trackmill.sources import samples
from trackmill.streaming import live

FOLDER = "/root/testdata/sf0.001"
FRAMES = "run_id string, frame_number long, recorded_at timestamp"
BOXES = "run_id string, raw_track_id long, recorded_at timestamp"


def arrive(spark, folder, number, recordings, boxes=40):
    """One file of each stream with some recordings."""
    for name, column, count in (("frames", "frame_number", 10), ("boxes", "raw_track_id", boxes)):
        rows = spark.range(count).crossJoin(spark.createDataFrame([(r,) for r in recordings], "r long"))
        value = F.col("id") if name == "frames" else F.when(F.col("id") % 8 != 0, F.col("id") % 5)
        rows.select(
            F.concat(F.lit("run-"), F.col("r").cast("string")).alias("run_id"), value.alias(column),
            F.timestamp_seconds(1_700_000_000 + F.col("r") * 3600).alias("recorded_at"),
        ).coalesce(1).write.parquet(f"{folder}/{name}/part={number}")


def streams(spark, folder):
    read = spark.readStream.option("maxFilesPerTrigger", 1)
    return [read.schema(s).parquet(f"{folder}/{n}").select(*[f.split()[0] for f in s.split(", ")]) for n, s in (("frames", FRAMES), ("boxes", BOXES))]


def expected(spark, folder):
    return sorted(map(tuple, frames.run_totals(
        spark.read.schema(FRAMES).parquet(f"{folder}/frames"), spark.read.schema(BOXES + ", frame_number long").parquet(f"{folder}/boxes")
    ).collect()))


def columns(rows):
    return rows.select("run_id", "frames_processed", "frame_detections", "tracked_observations", "unique_tracks")


def test_state_falls_and_the_log_stays_short(spark, tmp_path):
    folder = str(tmp_path)
    totals = live.RunTotals(spark, f"{folder}/totals", "2 hours", slots=3)
    seen = []
    for day in range(4):  # the streams stop and go on with what arrived since
        for part in range(3):
            number = 3 * day + part
            arrive(spark, folder, number, [number, number + 1])  # a recording spans two files
        seen += totals.drain(*streams(spark, folder))
        assert sorted(map(tuple, columns(totals.totals()).collect())) == expected(spark, folder)
    # Thirteen recordings with five tracks each passed, 78 keys; only those of open ones are in the state.
    assert max(s["state_rows"] for s in seen) <= 5 * 6 and len(seen) > 8
    assert seen[-1]["state_rows"] < max(s["state_rows"] for s in seen)
    log = spark.read.parquet(f"{folder}/totals/log")
    assert log.select("batch_id").distinct().count() <= 3 < len(seen)
    assert len(totals._folds()) >= 2


def test_rows_of_a_closed_recording_are_an_error(spark, tmp_path):
    folder = str(tmp_path)
    totals = live.RunTotals(spark, f"{folder}/totals", "2 hours")
    for number, recordings in enumerate(([0], [10], [20])):
        arrive(spark, folder, number, recordings)
        totals.drain(*streams(spark, folder))
    arrive(spark, folder, 9, [1])
    with pytest.raises(live.LateRows):
        totals.drain(*streams(spark, folder))


def test_a_repeated_batch_and_a_broken_fold_change_nothing(spark, tmp_path):
    folder = str(tmp_path)
    totals = live.RunTotals(spark, f"{folder}/totals", "2 hours", slots=2)
    for number in range(5):
        arrive(spark, folder, number, [number], boxes=9 + number)
    totals.drain(*streams(spark, folder))
    before = sorted(map(tuple, totals.totals().collect()))
    folds = totals._folds()
    # A fold that failed before its number was recorded: its files are there, nothing reads them.
    totals._newest().limit(1).write.parquet(f"{folder}/totals/snapshot/number={folds[-1][0] + 1}")
    assert sorted(map(tuple, totals.totals().collect())) == before
    last = totals._newest().agg(F.max("batch_id")).first()[0]
    totals.fold_log(last)  # a second fold of the same batches
    assert sorted(map(tuple, totals.totals().collect())) == before


def test_no_input(spark, tmp_path):
    assert live.RunTotals(spark, str(tmp_path)).totals().collect() == []


def test_equals_the_batch_result_of_the_sample(spark, tmp_path):
    totals = live.RunTotals(spark, str(tmp_path), "90 days")
    orders = live.file_stream(spark, FOLDER, "orders.parquet")
    lines = live.file_stream(spark, FOLDER, "lineitem.parquet")
    totals.drain(samples.with_recorded_at(samples.frames_from(orders)), samples.with_recorded_at(samples.detections_from(lines)))
    want = frames.run_totals(samples.frames(spark, FOLDER), samples.detections(spark, FOLDER))
    assert sorted(totals.totals().select(want.columns).collect()) == sorted(want.collect())
