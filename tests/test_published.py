"""Runs and stages become visible together; staged tracks are stored wholly or not at all."""

import pytest
from fixtures import documents, evaluated, frame, manifest
from pyspark.sql import functions as F

from trackmill.operators.ranking import newest_run_with_tracks
from trackmill.schemas import EVALUATED_COLUMNS
from trackmill.sources import published, tables


def state(spark, root):
    runs = sorted((r.run_id, r.average_processing_fps) for r in tables.read_runs(spark, root).collect())
    return runs, sorted((r.run_id, r.stage_index) for r in tables.read_stages(spark, root).collect())


def ids(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "run_id string")


@pytest.mark.parametrize("fails", ["stages", "runs", "list"])
def test_a_failure_anywhere_in_a_save_leaves_the_old_state(spark, tmp_path, monkeypatch, fails):
    root = str(tmp_path)
    tables.save_manifests(spark, root, documents(spark, manifest("run-a", fps=2.0), manifest("run-b")))
    before = state(spark, root)
    real = published._write

    def broken(spark_, rows, path, sort):
        written = real(spark_, rows, path, sort)
        if f"/{fails}/" in path:
            raise OSError("disk full")
        return written

    monkeypatch.setattr(published, "_write", broken)
    if fails == "list":  # all files are written, the list that makes them current is not
        monkeypatch.setattr(published, "_LIST", "sequence bigint")
    with pytest.raises(Exception):
        tables.save_manifests(spark, root, documents(spark, manifest("run-a", fps=3.0, stages=1), manifest("run-c")))
    monkeypatch.undo()
    assert state(spark, root) == before
    tables.save_manifests(spark, root, documents(spark, manifest("run-a", fps=3.0, stages=1), manifest("run-c")))
    runs, stages = state(spark, root)
    assert [r[0] for r in runs] == ["run-a", "run-b", "run-c"] and runs[0][1] == 3.0
    assert [s for s in stages if s[0] == "run-a"] == [("run-a", 1)] or [s[0] for s in stages].count("run-a") == 1


def test_a_second_writer_is_noticed(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    tables.save_manifests(spark, root, documents(spark, manifest("run-a")))
    real = published._write

    def slow(spark_, rows, path, sort):
        monkeypatch.setattr(published, "_write", real)
        tables.save_manifests(spark, root, documents(spark, manifest("run-z")))  # another writer is faster
        return real(spark_, rows, path, sort)

    monkeypatch.setattr(published, "_write", slow)
    with pytest.raises(RuntimeError, match="another writer"):
        tables.save_manifests(spark, root, documents(spark, manifest("run-b")))
    assert [r[0] for r in state(spark, root)[0]] == ["run-a", "run-z"]


@pytest.mark.parametrize(
    ("run", "text", "message"),
    [("run-x", None, "does not match"), ("run-a", "{not json", "Invalid JSON"), ("run-a", "[1]", "object"),
     ("run-a", '{"run_id": "run-a", "stages": {"a": 1}}', "must be a list"), ("run-a", '{"run_id": 7}', "string run_id")],
)
def test_bad_documents_are_not_stored(spark, tmp_path, run, text, message):
    root = str(tmp_path)
    good = documents(spark, manifest("run-b"))
    body = text or documents(spark, manifest("run-a")).first().manifest_json
    bad = spark.createDataFrame([(run, body)], "run_id string, manifest_json string")
    with pytest.raises(ValueError, match=message):
        tables.save_manifests(spark, root, good.select("run_id", "manifest_json").unionByName(bad))
    assert state(spark, root) == ([], [])
    assert not tables.has_runs(spark, root)


def test_tracks_that_differ_each_time_are_stored_as_they_were_checked(spark, tmp_path):
    root = str(tmp_path)
    tables.save_manifests(spark, root, documents(spark, manifest("run-a")))
    many = frame(spark, [evaluated(n) for n in range(300)], EVALUATED_COLUMNS)
    unsteady = many.where(F.rand() < 0.5)  # every computation gives other rows
    report = tables.import_evaluated_tracks(spark, root, ids(spark, "run-a"), unsteady).first()
    stored = tables.read_tracks(spark, root).count()
    counts = tables.read_track_counts(spark, root).first().track_count
    assert report.imported == report.database_track_count == stored == counts


def test_newest_run_with_tracks_reads_no_track(spark, tmp_path):
    root = str(tmp_path)
    tables.save_manifests(spark, root, documents(
        spark, manifest("run-a", "2026-01-01T14:00:00+00:00"), manifest("run-b", "2026-01-01T15:00:00+00:00")))
    tables.replace_tracks(spark, root, ids(spark, "run-a", "run-b"), frame(spark, [evaluated(1), evaluated(2, run="run-b")], EVALUATED_COLUMNS))
    newest = newest_run_with_tracks(tables.read_runs(spark, root), tables.read_track_counts(spark, root))
    assert newest.first().run_id == "run-b"
    plan = newest._jdf.queryExecution().executedPlan().toString()
    assert "evaluated_tracks" not in plan and "track_id" not in plan
    tables.replace_tracks(spark, root, ids(spark, "run-b"), frame(spark, [evaluated(1)], EVALUATED_COLUMNS).where("false"))
    newest = newest_run_with_tracks(tables.read_runs(spark, root), tables.read_track_counts(spark, root))
    assert newest.first().run_id == "run-a"


def test_tracks_of_many_runs_share_files_and_only_named_runs_are_replaced(spark, tmp_path):
    root = str(tmp_path)
    names = [f"run-{n}" for n in range(40)]
    tables.save_manifests(spark, root, documents(spark, *[manifest(n) for n in names]))
    tracks = frame(spark, [evaluated(1, run=n) for n in names], EVALUATED_COLUMNS)
    tables.replace_tracks(spark, root, ids(spark, *names), tracks)
    assert len([p for p in (tmp_path / "evaluated_tracks").rglob("*.parquet")]) < len(names)
    tables.replace_tracks(spark, root, ids(spark, "run-3", "run-4"), frame(spark, [evaluated(8, run="run-3")], EVALUATED_COLUMNS))
    stored = {r.run_id: r.track_id for r in tables.read_tracks(spark, root).collect()}
    assert stored == {n: 8 if n == "run-3" else 1 for n in names if n != "run-4"}
    assert [r.track_id for r in tables.read_tracks(spark, root, "run-3").collect()] == [8]
    assert tables.read_tracks(spark, root, "run-4").count() == 0
