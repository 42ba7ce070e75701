import hashlib
import json

import pytest
from fixtures import OBSERVATION_SCHEMA, TRACK_SEVEN, documents, evaluated, frame, manifest

from trackmill.operators.tracks import evaluate, summarize
from trackmill.plans.queries import Store
from trackmill.schemas import EVALUATED_COLUMNS
from trackmill.sources import csv_tables, tables
from trackmill.sources import documents as docs

ids = "run_id string"


def graded(spark, *rows):
    return frame(spark, rows, EVALUATED_COLUMNS)


def known(spark, *names):
    return spark.createDataFrame([(n,) for n in names], ids)


def archive(folder, *manifests):
    folder.mkdir(exist_ok=True)
    for m in manifests:
        (folder / f"{m['run_id']}.json").write_text(json.dumps(m, indent=2))
    return str(folder)


# ---- CSV -------------------------------------------------------------------


def test_csv_stages_equal_the_direct_plan(spark, tmp_path):
    rows = spark.createDataFrame(TRACK_SEVEN, OBSERVATION_SCHEMA)
    assert csv_tables.write_observations(rows, f"{tmp_path}/o") == 3
    read = csv_tables.read_observations(spark, f"{tmp_path}/o")
    assert csv_tables.write_summaries(summarize(read), f"{tmp_path}/s") == 1
    summaries = csv_tables.read_summaries(spark, f"{tmp_path}/s")
    csv_tables.write_evaluated(evaluate(summaries), f"{tmp_path}/e")
    direct = evaluate(summarize(rows))
    assert csv_tables.read_evaluated(spark, f"{tmp_path}/e").select(direct.columns).collect() == direct.collect()


HEADER = ",".join(EVALUATED_COLUMNS)


def csv_file(path, *rows, header=HEADER):
    path.write_text("\n".join([header, *rows]) + "\n")
    return str(path)


def test_csv_is_read_by_name_with_quotes(spark, tmp_path):
    names = list(reversed(EVALUATED_COLUMNS))
    cells = {n: "1" for n in names} | {
        "dominant_label": '"a ""b"", c"', "quality_level": "weak", "quality_reason": "",
        "track_id": " 1_0 ", "average_confidence": "nan", "duration_seconds": "1e-3"}
    path = csv_file(tmp_path / "x.csv", ",".join(cells[n] for n in names), header=",".join(names))
    row = csv_tables.read_evaluated(spark, path, "run-a").first()
    assert (row.dominant_label, row.quality_reason, row.track_id) == ('a "b", c', "", 10)
    assert row.average_confidence != row.average_confidence and row.duration_seconds == 0.001
    assert row.run_id == "run-a"


GOOD = "1,car,weak,r,1,0.0,0.5,0.0,1,1,0.0,0.0,1.0,1.0,1.0,1.0"


@pytest.mark.parametrize("bad", ["5.0", "x", "", "1.5d"])
def test_one_bad_cell_fails_the_load(spark, tmp_path, bad):
    path = csv_file(tmp_path / "x.csv", GOOD, bad + GOOD[1:])
    with pytest.raises(Exception, match="unreadable CSV cells"):
        csv_tables.read_evaluated(spark, path).count()
    cells = csv_tables.scan_text(spark, path, EVALUATED_COLUMNS)
    good, broken = csv_tables.quarantine(csv_tables.typed(cells, EVALUATED_COLUMNS))
    assert (good.count(), broken.first().bad_cells) == (1, ["track_id"])


def test_csv_without_header_columns_or_file(spark, tmp_path):
    (tmp_path / "empty.csv").write_text("")
    with pytest.raises(ValueError, match="header"):
        csv_tables.read_evaluated(spark, f"{tmp_path}/empty.csv")
    with pytest.raises(ValueError, match="lacks columns"):
        csv_tables.read_evaluated(spark, csv_file(tmp_path / "y.csv", "1", header="track_id"))
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        csv_tables.read_evaluated(spark, f"{tmp_path}/none.csv")


def test_numeric_run_folders_stay_text(spark, tmp_path):
    csv_tables.write_evaluated(graded(spark, evaluated(1, run="007")), f"{tmp_path}/e")
    assert csv_tables.read_evaluated(spark, f"{tmp_path}/e").first().run_id == "007"


@pytest.mark.parametrize("multiline", [True, False, "split"])
def test_csv_of_many_runs_shares_files(spark, tmp_path, multiline):
    names = [f"run-{n}" for n in range(40)]
    rows = graded(spark, *[evaluated(1, run=n) for n in names])
    csv_tables.write_evaluated(rows, f"{tmp_path}/e")
    assert len(list((tmp_path / "e").rglob("*.csv"))) < len(names)
    csv_tables.write_evaluated(rows, f"{tmp_path}/f", folders=True)
    assert sorted(p.name for p in (tmp_path / "f").glob("run_id=*")) == sorted(f"run_id={n}" for n in names)
    for folder in ("e", "f"):
        read = csv_tables.read_evaluated(spark, f"{tmp_path}/{folder}", multiline=multiline)
        assert sorted(map(str, read.select(rows.columns).collect())) == sorted(map(str, rows.collect()))


# ---- documents -------------------------------------------------------------


def test_manifest_folder(spark, tmp_path):
    folder = archive(tmp_path / "runs", manifest("run-a"), manifest("run-c"), manifest("run-b"))
    (tmp_path / "runs" / "notes.txt").write_text("no manifest")
    listed = docs.list_manifests(spark, folder).collect()
    assert [r.run_id for r in listed] == ["run-c", "run-b", "run-a"]
    assert [r.run_id for r in docs.list_manifests(spark, folder, 2).collect()] == ["run-c", "run-b"]
    assert docs.count_manifests(spark, folder).first().run_count == 3
    with pytest.raises(ValueError):
        docs.list_manifests(spark, folder, 0)
    (tmp_path / "runs" / "run-d.json").write_text("{invalid JSON")
    assert docs.count_manifests(spark, folder).first().run_count == 4
    with pytest.raises(Exception, match="Invalid pipeline run manifest"):
        docs.list_manifests(spark, folder).collect()
    assert docs.list_manifests(spark, archive(tmp_path / "runs"), 1).schema  # lazy


def test_import_reports_bad_files_and_repeats_safely(spark, tmp_path):
    folder = archive(tmp_path / "runs", manifest("run-a"), manifest("run-b", stages=3))
    (tmp_path / "runs" / "bad.json").write_text("{invalid JSON")
    (tmp_path / "runs" / "different-run.json").write_text(json.dumps(manifest("actual-run")))
    (tmp_path / "runs" / "run-s.json").write_text('{"run_id": "run-s", "stages": 5}')
    root = f"{tmp_path}/tables"
    for _ in range(2):
        report = tables.import_run_history(spark, root, folder).first()
        assert tuple(report) == (5, 2, 3, 2)
    assert tables.read_stages(spark, root).count() == 5
    errors = docs.importable(docs.scan_manifests(spark, folder)).where("error is not null")
    assert {r.file_name: r.error for r in errors.collect()} == {
        "bad.json": "Invalid JSON",
        "different-run.json": "Manifest run_id does not match its filename",
        "run-s.json": "Pipeline manifest stages must be a list"}


def test_fingerprints(spark, tmp_path):
    (tmp_path / "v.mp4").write_bytes(b"\x00video")
    row = docs.fingerprint_files(spark, str(tmp_path), "*.mp4").first()
    assert (row.size_bytes, row.sha256) == (6, hashlib.sha256(b"\x00video").hexdigest())


def test_metrics_folder(spark, tmp_path):
    (tmp_path / "run-a.json").write_text('{"duration_seconds": 1.5}')
    assert tuple(docs.read_metrics(spark, str(tmp_path)).first()) == ("run-a", '{"duration_seconds": 1.5}')


# ---- tables ----------------------------------------------------------------


def test_same_run_twice_is_replaced_with_its_stages(spark, tmp_path):
    root = str(tmp_path)
    tables.save_manifests(spark, root, documents(spark, manifest("run-a", fps=2.0), manifest("run-b")))
    tables.save_manifests(spark, root, documents(spark, manifest("run-a", fps=3.0, stages=1)))
    runs = {r.run_id: r.average_processing_fps for r in tables.read_runs(spark, root).collect()}
    assert runs == {"run-a": 3.0, "run-b": 2.0}
    stages = tables.read_stages(spark, root).groupBy("run_id").count().collect()
    assert {r.run_id: r["count"] for r in stages} == {"run-a": 1, "run-b": 2}
    tables.save_manifests(spark, root, documents(spark, manifest("run-a", stages=0)))
    assert {r.run_id for r in tables.read_stages(spark, root).collect()} == {"run-b"}


def test_last_version_of_a_batch_wins(spark, tmp_path):
    first = documents(spark, manifest("run-a", fps=1.0)).selectExpr("*", "1 as version")
    batch = first.union(documents(spark, manifest("run-a", fps=2.0)).selectExpr("*", "2 as version"))
    tables.save_manifests(spark, str(tmp_path), batch, "version")
    assert [r.average_processing_fps for r in tables.read_runs(spark, str(tmp_path)).collect()] == [2.0]


def stored(spark, root):
    rows = tables.read_tracks(spark, root).collect()
    return sorted((r.run_id, r.track_id, r.average_confidence) for r in rows)


def test_tracks_are_replaced_per_run(spark, tmp_path):
    root = str(tmp_path)
    tables.save_manifests(spark, root, documents(spark, manifest("run-a"), manifest("run-b")))
    both = graded(spark, evaluated(1), evaluated(2), evaluated(1, mean=0.6, run="run-b"))
    for _ in range(2):
        report = tables.import_evaluated_tracks(spark, root, known(spark, "run-a", "run-b"), both)
        got = {r.run_id: (r.imported, r.database_track_count, r.stable) for r in report.collect()}
        assert got == {"run-a": (2, 2, 2), "run-b": (1, 1, 1)}
    tables.replace_tracks(spark, root, known(spark, "run-a"), graded(spark, evaluated(3)))
    assert stored(spark, root) == [("run-a", 3, 0.8), ("run-b", 1, 0.6)]
    tables.replace_tracks(spark, root, known(spark, "run-a"), graded(spark).where("false"))
    assert stored(spark, root) == [("run-b", 1, 0.6)]


@pytest.mark.parametrize(
    ("rows", "run", "message"),
    [([evaluated(1), evaluated(1)], "run-a", "unique"), ([evaluated(1, "odd")], "run-a", "quality"),
     ([evaluated(1, run="run-x")], "run-x", "unknown run"), ([evaluated(-1)], "run-a", "negative")],
)
def test_rejected_tracks_leave_the_table_alone(spark, tmp_path, rows, run, message):
    root = str(tmp_path)
    tables.save_manifests(spark, root, documents(spark, manifest("run-a")))
    tables.replace_tracks(spark, root, known(spark, "run-a"), graded(spark, evaluated(9)))
    with pytest.raises(ValueError, match=message):
        tables.replace_tracks(spark, root, known(spark, run), graded(spark, *rows))
    assert stored(spark, root) == [("run-a", 9, 0.8)]


def test_deleting_a_run_takes_its_children(spark, tmp_path):
    root = str(tmp_path)
    tables.save_manifests(spark, root, documents(spark, manifest("run-a"), manifest("run-b")))
    tracks = graded(spark, evaluated(1), evaluated(1, run="run-b"))
    tables.replace_tracks(spark, root, known(spark, "run-a", "run-b"), tracks)
    tables.delete_runs(spark, root, known(spark, "run-a"))
    for read in (tables.read_runs, tables.read_stages, tables.read_tracks):
        assert {r.run_id for r in read(spark, root).collect()} == {"run-b"}


# ---- user queries ----------------------------------------------------------


def filled(spark, tmp_path):
    root = f"{tmp_path}/tables"
    tables.save_manifests(spark, root, documents(
        spark, manifest("run-a", "2026-01-01T14:00:00+00:00"),
        manifest("run-b", "2026-01-01T15:00:00+00:00", fps=2.5)))
    tables.replace_tracks(spark, root, known(spark, "run-a"), graded(
        spark, evaluated(1, mean=0.9), evaluated(2, mean=0.7), evaluated(3, "weak", 0.4, label="car")))
    return Store(spark, root, archive(tmp_path / "runs", manifest("run-json")))


def test_table_store(spark, tmp_path):
    store = filled(spark, tmp_path)
    assert store.run_source == "table"
    assert [r.run_id for r in store.runs().collect()] == ["run-b", "run-a"]
    assert [r.run_id for r in store.runs(1).collect()] == ["run-b"]
    assert store.run_count().first().run_count == 2
    assert store.latest_run().first().run_id == "run-b"
    assert store.run("run-a").count() == 1 and store.run("run-json").count() == 0
    statistics = {(r.section, r.name): r.value for r in store.current_statistics().collect()}
    assert statistics["total", "tracks"] == 3 and statistics["label", "car"] == 1
    page = store.current_tracks("stable", 0.8).collect()
    assert [(r.track_id, r.total_matching, r.returned) for r in page] == [(1, 1, 1)]
    assert page[0].start_position.x == 100.0 and page[0].storage_source == "table"
    assert store.current_track(2).first().average_confidence == 0.7
    assert store.current_track(99).count() == 0
    assert store.run_tracks("run-b").count() == 0
    assert [r.track_id for r in store.run_tracks("run-a", limit=2).collect()] == [1, 2]
    assert store.run_track("run-a", 3).first().quality_level == "weak"
    assert store.run_statistics("run-a").count() == 6
    assert store.comparison("run-a", "run-b").first().percentage_change == 25.0
    assert store.comparison_summary("run-a", "run-b").first().improved_metric_count == 1
    assert store.comparison("run-a", "run-x").count() == 0
    for bad in (lambda: store.run("../unsafe"), lambda: store.runs(501),
                lambda: store.current_tracks(limit=1001),
                lambda: store.comparison("run-a", "run-a")):
        with pytest.raises(ValueError):
            bad()


def test_point_lookups_prune_files(spark, tmp_path):
    store = filled(spark, tmp_path)
    plan = store.run("run-a")._jdf.queryExecution().toString()
    assert "run_shard" in plan.split("PartitionFilters: [")[1].split("]")[0]
    plan = store.run_track("run-a", 1)._jdf.queryExecution().toString()
    assert "run_id" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "EqualTo(track_id,1)" in plan


def test_json_and_csv_fallback(spark, tmp_path):
    later = manifest("run-b") | {"started_at_utc": "2026-01-02T00:00:00+00:00"}
    folder = archive(tmp_path / "runs", manifest("run-a"), later)
    path = csv_file(tmp_path / "q.csv", GOOD)
    store = Store(spark, f"{tmp_path}/none", folder, path)
    assert store.run_source == "json"
    assert [r.run_id for r in store.runs(5).collect()] == ["run-b", "run-a"]
    assert store.run("run-a").count() == 1 and store.run("run-x").count() == 0
    assert store.latest_run().first().run_id == "run-b"
    assert store.run_count().first().run_count == 2
    row = store.current_tracks().first()
    assert (row.storage_source, row.track_id) == ("csv", 1)
    with pytest.raises(FileNotFoundError):
        Store(spark, f"{tmp_path}/none").current_statistics()
