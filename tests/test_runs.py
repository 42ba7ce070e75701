import json

import pytest
from fixtures import documents, evaluated, frame, manifest
from pyspark.sql import functions as F

from trackmill.operators import comparison, fusion, runs
from trackmill.schemas import EVALUATED_COLUMNS
from trackmill.sources.documents import metrics_availability


def raw(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "manifest_json string")


def pair(spark, baseline="run-a", candidate="run-b"):
    return spark.createDataFrame(
        [(baseline, candidate)], "baseline_run_id string, candidate_run_id string")


def compared(spark, first, second):
    metrics = runs.parsed(documents(spark, first, second)).select(
        "run_id", *comparison.document_metrics(F.col("m")))
    rows = {r.name: r for r in comparison.compare(pair(spark), metrics).collect()}
    return rows, comparison.scorecard(pair(spark), metrics).first()


def test_flatten_reads_24_fields(spark):
    row = runs.flatten(documents(spark, manifest())).first()
    assert (row.run_id, row.schema_version, row.exit_code) == ("run-a", 3, 0)
    assert (row.input_path, row.input_sha256, row.model_path) == ("video.mp4", "ab", "m.pt")
    assert (row.average_processing_fps, row.frames_processed) == (2.0, 271.0)
    assert (row.pipeline_duration_seconds, row.initialization_overhead_seconds) == (145.0, 25.0)
    assert row.processing_metrics_available is True
    assert json.loads(row.manifest_json) == manifest()
    assert row.manifest_json.startswith('{"configuration_path":"configs/pipeline.json"')


def test_sections_that_are_no_objects_act_as_empty(spark):
    row = runs.flatten(
        raw(spark, '{"run_id":"a","model":[1],"input":"x","performance":{"processing_metrics":7}}')
    ).first()
    assert (row.run_id, row.model_path, row.input_path) == ("a", None, None)
    assert (row.processing_metrics_available, row.average_processing_fps) == (False, None)


def test_flag_rules_differ(spark):
    docs = raw(spark, *[
        '{"run_id":"r","performance":{"processing_metrics_available":%s}}' % v
        for v in ("true", "false", "1", '"false"', "null")])
    assert [r[0] for r in runs.flatten(docs).select("processing_metrics_available").collect()] == [
        True, False, True, True, False]
    compact = runs.summarize_documents(docs).select("processing_metrics_available").collect()
    assert [r[0] for r in compact] == [True, False, False, False, False]


def test_stages_keep_their_place(spark):
    doc = '{"run_id":"a","stages":[{"name":"x","duration_seconds":1.5},7,{"exit_code":2}]}'
    got = runs.explode_stages(raw(spark, doc)).orderBy("stage_index").collect()
    assert [(r.stage_index, r.name, r.duration_seconds, r.exit_code) for r in got] == [
        (0, "x", 1.5, None), (1, None, None, None), (2, None, None, 2)]


def test_compact_summary_of_a_legacy_run(spark):
    row = runs.summarize_documents(documents(spark, manifest(measured=False, stages=3))).first()
    assert row.stage_count == 3 and row.processing_metrics_available is False
    measured = ("average_processing_fps", "frames_processed", "frame_detections",
                "tracked_observations", "unique_tracks", "processing_duration_seconds",
                "initialization_overhead_seconds", "pipeline_duration_seconds")
    assert all(row[name] is None for name in measured)
    assert runs.summarize_documents(raw(spark, '{"stages": 5}')).first().stage_count == 0


def test_newest_first_with_running_runs_last(spark):
    docs = documents(
        spark, manifest("run-a", "2026-01-01T14:20:00+00:00"),
        manifest("run-b", "2026-01-01T14:30:00+00:00"), manifest("run-c", None),
        manifest("run-d", "2026-01-01T14:30:00+00:00"))
    table = runs.flatten(docs)
    assert [r.run_id for r in runs.run_list(table).collect()] == ["run-d", "run-b", "run-a", "run-c"]
    assert [r.run_id for r in runs.run_list(table, 1).collect()] == ["run-d"]
    assert runs.run_count(table).first().run_count == 4
    with pytest.raises(ValueError):
        runs.run_list(table, 0)


def test_overhead(spark):
    headers = spark.createDataFrame(
        [("a", 3.0), ("b", 1.0), ("c", None), ("d", 0.1239)],
        "run_id string, pipeline_seconds double")
    stages = spark.createDataFrame(
        [("a", 1.5), ("a", 1.0), ("b", 2.0), ("c", 1.0), ("d", None)],
        "run_id string, duration_seconds double")
    got = runs.with_overhead(headers, runs.stage_totals(stages)).orderBy("run_id").collect()
    assert [tuple(r)[2:] for r in got] == [
        (3.0, 2.5, 0.5), (1.0, 2.0, 0.0), (None, 0.0, None), (0.124, 0.0, 0.124)]


def test_measured_results(spark):
    rows = spark.createDataFrame(
        [("a", "completed", 10.0, 300, 500, 450, 25), ("b", "failed", 2.5, 0, 0, 0, 0),
         ("c", "completed", 0.0, 5, 1, 1, 1), ("d", "interrupted", 4.0, 9, 9, 9, 9)],
        "run_id string, status string, seconds double, frames_processed bigint, "
        "frame_detections bigint, tracked_observations bigint, unique_tracks bigint")
    got = {r.run_id: r for r in runs.measured_results(rows).collect()}
    assert (got["a"].duration_seconds, got["a"].average_processing_fps) == (10.0, 30.0)
    assert (got["b"].duration_seconds, got["b"].frames_processed) == (2.5, 0.0)
    assert got["c"].average_processing_fps == 0.0
    assert (got["d"].frames_processed, got["d"].average_processing_fps) == (0.0, 0.0)


def test_closing_record(spark):
    headers = spark.createDataFrame(
        [("a", "completed", 3.0), ("b", "completed", 3.0), ("c", "failed", 3.0),
         ("d", "completed", 1.0)],
        "run_id string, status string, pipeline_seconds double")
    stages = spark.createDataFrame([("a", 2.5)], "run_id string, duration_seconds double")
    metrics = spark.createDataFrame([("a", 9.0), ("c", 8.0)], "run_id string, fps double")
    levels = ["stable", "stable", "tentative", "weak"]
    tracks = [evaluated(i, level, run="a") for i, level in enumerate(levels)]
    tracks += [evaluated(1, run="c"), evaluated(1, run="d"), evaluated(1, run="d")]
    final = runs.finalize(headers, stages, metrics, frame(spark, tracks, EVALUATED_COLUMNS))
    got = {r.run_id: r for r in final.collect()}
    a, b, c, d = (got[k] for k in "abcd")
    assert (a.stable, a.tentative, a.weak, a.total, a.database_track_count) == (2, 1, 1, 4, 4)
    assert (a.initialization_overhead_seconds, a.processing_metrics.fps) == (0.5, 9.0)
    assert (b.processing_metrics_available, b.total, b.quality_counts_available) == (False, 0, True)
    assert b.processing_metrics_error is not None
    assert (c.processing_metrics, c.total, c.quality_counts_available) == (None, 0, False)
    assert (d.database_tracks_available, d.database_track_count, d.total) == (False, 0, 2)
    assert "unique" in d.database_tracks_error


def test_metrics_documents_never_fail(spark):
    headers = spark.createDataFrame([(k,) for k in "abcd"], "run_id string")
    texts = spark.createDataFrame(
        [("a", '{"duration_seconds": 10.0, "results": {"unique_tracks": 25}}'), ("b", "{bad"),
         ("c", "[1]")], "run_id string, metrics_json string")
    got = metrics_availability(headers, texts).orderBy("run_id").collect()
    assert [r.processing_metrics_available for r in got] == [True, False, False, False]
    assert got[0].processing_metrics.results.unique_tracks == 25.0
    assert [r.processing_metrics_error for r in got[1:]] == [
        "Invalid JSON", "Metrics root value must be an object.", "Metrics file not found"]


def test_comparison_improves_and_regresses(spark):
    slow = manifest("run-a", fps=2.0, processing=120.0, pipeline=145.0, overhead=25.0)
    fast = manifest("run-b", fps=2.5, processing=100.0, pipeline=120.0, overhead=20.0)
    rows, card = compared(spark, slow, fast)
    assert rows["average_processing_fps"].absolute_change == 0.5
    assert rows["average_processing_fps"].percentage_change == 25.0
    assert tuple(card)[2:] == (8, 8, 4, 0, 4)
    slow["run_id"], fast["run_id"] = "run-b", "run-a"
    assert tuple(compared(spark, fast, slow)[1])[2:] == (8, 8, 0, 4, 4)


def test_comparison_with_a_legacy_run(spark):
    rows, card = compared(spark, manifest("run-a", measured=False), manifest("run-b"))
    assert {r.assessment for r in rows.values()} == {"unavailable"}
    assert rows["unique_tracks"].baseline is None and rows["unique_tracks"].candidate == 45.0
    assert tuple(card)[2:] == (0, 8, 0, 0, 0)


def test_zero_baseline_has_no_percentage(spark):
    zero = manifest("run-a", fps=0, processing=0, pipeline=0, overhead=0)
    rows, _ = compared(spark, zero, manifest("run-b"))
    assert rows["average_processing_fps"].percentage_change is None
    assert rows["average_processing_fps"].absolute_change == 2.0
    assert rows["average_processing_fps"].assessment == "improved"
    assert rows["frames_processed"].percentage_change == 0.0


def test_only_finite_numbers_are_compared(spark):
    odd = '{"run_id":"run-a","performance":{"pipeline_duration_seconds":NaN,' \
          '"initialization_overhead_seconds":"2.5","processing_metrics":' \
          '{"duration_seconds":true,"results":{"unique_tracks":45,"frames_processed":Infinity}}}}'
    got = runs.parsed(raw(spark, odd)).select(*comparison.document_metrics(F.col("m"))).first()
    assert got.unique_tracks == 45.0
    assert sum(v is not None for v in got) == 1


def test_unknown_or_equal_runs_give_no_row(spark):
    metrics = runs.parsed(documents(spark, manifest("run-a"))).select(
        "run_id", *comparison.document_metrics(F.col("m")))
    assert comparison.compare(pair(spark), metrics).count() == 0
    assert comparison.compare(pair(spark, "run-a", "run-a"), metrics).count() == 0


def test_default_pairs(spark):
    table = spark.createDataFrame(
        [("a", "x", "1", True), ("b", "x", "2", True), ("c", "x", "3", True), ("d", "x", "4", False),
         ("e", "y", "9", True)],
        "run_id string, config_id string, finished_at_utc string, "
        "processing_metrics_available boolean")
    assert [tuple(r) for r in comparison.default_pair(table, "config_id").collect()] == [
        ("x", "b", "c")]
    assert tuple(comparison.default_pair(table).first()) == ("c", "e")
    assert comparison.default_pair(table.where("run_id = 'a'")).count() == 0


def test_metric_table(spark):
    rows = comparison.metric_definitions(spark).orderBy("ord").collect()
    assert len(rows) == 8 and rows[0].higher_is_better is True and rows[7].higher_is_better is None


def test_fusion(spark):
    rows = spark.createDataFrame(
        [("g", 1.0, 0.8), ("g", 4.0, 0.4), ("h", 5.0, None)],
        "fusion_id string, value double, weight double")
    got = {r.fusion_id: r for r in fusion.fuse(rows).collect()}
    assert got["g"].fused_value == pytest.approx(2.0)
    assert got["g"].confidence == pytest.approx(1.2)
    assert (got["g"].sensor_count, got["h"].fused_value, got["h"].confidence) == (2, 5.0, 1.0)
    assert fusion.fuse(rows.where("false")).count() == 0
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO|zero"):
        fusion.fuse(rows.withColumn("weight", F.lit(0.0))).collect()
