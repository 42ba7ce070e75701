"""Fingerprints of files of any size, absent ones, and many small ones."""

import hashlib
import os

import pytest

from trackmill.sources import fingerprints


def sha(data):
    return hashlib.sha256(data).hexdigest()


@pytest.fixture(scope="module")
def large(tmp_path_factory):
    """A file of 3 GB that takes no disk: zeros with a mark at its end."""
    path = tmp_path_factory.mktemp("large") / "video.bin"
    with open(path, "wb") as file:
        file.truncate(3 << 30)
        file.seek((3 << 30) - 1)
        file.write(b"x")
    expected = hashlib.sha256()
    zeros = bytes(1 << 24)
    for _ in range((3 << 30) // len(zeros) - 1):
        expected.update(zeros)
    expected.update(zeros[:-1] + b"x")
    return path, expected.hexdigest()


def test_three_gigabytes_and_an_absent_path(spark, large):
    path, expected = large
    rows = [("run-1", str(path)), ("run-2", f"file:{path}"), ("run-3", f"{path}.gone"), ("run-4", None), ("run-5", ""), ("run-6", str(path.parent))]
    frame = spark.createDataFrame(rows, "run_id string, path string")
    got = {r.run_id: (r.exists, r.size_bytes, r.sha256) for r in fingerprints.fingerprint_paths(frame).collect()}
    absent = (False, None, None)
    assert got == {"run-1": (True, 3 << 30, expected), "run-2": (True, 3 << 30, expected)} | {f"run-{n}": absent for n in (3, 4, 5, 6)}


def test_large_file_as_a_data_source(spark, large):
    path, expected = large
    got = fingerprints.fingerprint_folder(spark, str(path.parent)).collect()
    assert [tuple(r) for r in got] == [(str(path), True, 3 << 30, expected)]


def test_folder_of_small_files(spark, tmp_path):
    contents = {f"f{i}.bin": os.urandom(i * 7) for i in range(40)} | {"skip.txt": b"no", "ü name.bin": b"yes"}
    for name, data in contents.items():
        (tmp_path / name).write_bytes(data)
    (tmp_path / "inner").mkdir()
    (tmp_path / "inner" / "deep.bin").write_bytes(b"deep")
    wanted = {f"file:{tmp_path}/{n}": (len(d), sha(d)) for n, d in contents.items() if n.endswith(".bin")}
    got = fingerprints.fingerprint_folder(spark, f"file:{tmp_path}", "*.bin")
    assert {r.path: (r.size_bytes, r.sha256) for r in got.collect()} == wanted
    deep = fingerprints.fingerprint_folder(spark, str(tmp_path), "*.bin", recursive=True).collect()
    assert len(deep) == len(wanted) + 1 and all(r.exists for r in deep)
    assert fingerprints.fingerprint_folder(spark, f"{tmp_path}/none").collect() == []


def test_large_files_are_partitions_of_their_own(tmp_path, monkeypatch):
    monkeypatch.setattr(fingerprints, "TASK_BYTES", 100)
    for name, size in {"a": 250, "b": 100, "c": 60, "d": 40, "e": 1, "f": 0}.items():
        (tmp_path / name).write_bytes(bytes(size))
    reader = fingerprints.FingerprintReader({"path": str(tmp_path)})
    packed = [[os.path.basename(p) for p in part.paths] for part in reader.partitions()]
    assert packed == [["a"], ["b"], ["c", "d"], ["e", "f"]]


def test_a_path_of_many_rows_is_read_once_and_columns_stay(spark, tmp_path):
    (tmp_path / "one").write_bytes(b"one")
    opened = spark.sparkContext.accumulator(0)

    def opener(path):
        opened.add(1)
        return fingerprints.open_path(path)

    frame = spark.createDataFrame([(i, f"{tmp_path}/one", "x") for i in range(50)], "exists_ long, place string, kind string")
    rows = fingerprints.fingerprint_paths(frame, "place", opener).collect()
    assert len(rows) == 50 and {(r.kind, r.sha256) for r in rows} == {("x", sha(b"one"))}
    assert opened.value == 1
    assert fingerprints.fingerprint_paths(frame.limit(0), "place").collect() == []
