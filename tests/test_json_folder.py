"""The folder of documents: written by tasks, read as a list, imported with a row per file."""

import pytest
from fixtures import documents, manifest

from trackmill.plans.queries import Store
from trackmill.sources import documents as docs


def test_written_files_are_read_back(spark, tmp_path):
    folder = str(tmp_path / "new" / "runs")
    rows = documents(spark, manifest("run-a"), manifest("run-b"), manifest("run-ü".replace("ü", "u")))
    assert docs.write_files(rows.repartition(3), folder) == 3
    assert docs.write_files(rows, folder) == 3  # again, as a repeated task would
    want = {r.run_id: r.manifest_json for r in rows.collect()}
    assert {r.run_id: r.manifest_json for r in docs.list_manifests(spark, folder).collect()} == want
    assert docs.count_manifests(spark, folder).first().run_count == 3


@pytest.mark.parametrize("names", [["../up"], ["run-a", "run-a"], [None], [""]])
def test_unsafe_or_repeated_names_write_nothing(spark, tmp_path, names):
    rows = spark.createDataFrame([(n, "{}") for n in names], "run_id string, manifest_json string")
    with pytest.raises(ValueError, match="safe and unique"):
        docs.write_files(rows, str(tmp_path / "runs"))
    assert list(tmp_path.iterdir()) == []


def test_a_missing_folder_is_an_empty_list(spark, tmp_path):
    folder = str(tmp_path / "none")
    assert docs.list_manifests(spark, folder).collect() == []
    assert docs.list_manifests(spark, folder, 5).collect() == []
    assert docs.read_manifest(spark, folder, "run-a").collect() == []
    assert docs.count_manifests(spark, folder).first().run_count == 0
    assert docs.import_rows(docs.scan_manifests(spark, folder)).collect() == []
    store = Store(spark, str(tmp_path / "tables"), folder)
    assert store.runs().collect() == [] and store.run_count().first().run_count == 0 and store.latest_run().collect() == []


def test_every_file_of_an_import_has_a_row(spark, tmp_path):
    folder = str(tmp_path)
    docs.write_files(documents(spark, manifest("run-a")), folder)
    (tmp_path / "run-b.json").write_text("{no")
    (tmp_path / "run-c.json").write_text('{"run_id": "run-c", "stages": 3}')
    rows = {r.file_name: (r.run_id, r.error) for r in docs.import_rows(docs.scan_manifests(spark, folder)).collect()}
    assert rows == {
        "run-a.json": ("run-a", None), "run-b.json": (None, "Invalid JSON"),
        "run-c.json": (None, "Pipeline manifest stages must be a list"),
    }
