"""Rows that used to vanish or double without an error."""

import pytest
from fixtures import documents, evaluated, frame, manifest

from trackmill.schemas import EVALUATED_COLUMNS
from trackmill.sources import tables


def runs(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "run_id string")


def test_tracks_outside_the_import_are_an_error(spark, tmp_path):
    root = str(tmp_path)
    tables.save_manifests(spark, root, documents(spark, manifest("run-a"), manifest("run-b")))
    tables.replace_tracks(spark, root, runs(spark, "run-a"), frame(spark, [evaluated(9)], EVALUATED_COLUMNS))
    sent = frame(spark, [evaluated(1), evaluated(2, run="run-b"), evaluated(3, run="run-b")], EVALUATED_COLUMNS)
    with pytest.raises(ValueError, match="2 tracks of 1 runs that are not imported, the first run-b"):
        tables.import_evaluated_tracks(spark, root, runs(spark, "run-a"), sent)
    assert [r.track_id for r in tables.read_tracks(spark, root).collect()] == [9]


def test_replaced_takes_no_rows_of_other_runs(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "run_id string, track_id int")
    with pytest.raises(Exception, match="not replaced: b"):
        tables.replaced(rows, runs(spark, "a"), rows).collect()
    assert sorted(map(tuple, tables.replaced(rows, runs(spark, "a", "b", "b"), rows).collect())) == [("a", 1), ("b", 2)]


def test_a_repeated_run_without_order_is_an_error(spark, tmp_path):
    tables.save_manifests(spark, str(tmp_path), documents(spark, manifest("run-b")))
    with pytest.raises(ValueError, match="run-a 2 times"):
        tables.save_manifests(spark, str(tmp_path), documents(spark, manifest("run-a"), manifest("run-a", fps=2.0)))
    assert [r.run_id for r in tables.read_runs(spark, str(tmp_path)).collect()] == ["run-b"]
