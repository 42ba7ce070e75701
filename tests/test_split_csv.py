"""Quoted line breaks in files that many tasks read."""

import csv
import random

import pytest

from trackmill.sources import csv_tables, split_csv

COLUMNS = {"a": "string", "b": "string", "c": "string"}


@pytest.fixture
def small_splits(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    before = {n: spark.conf.get(n, None) for n in names}

    def cut(size):
        spark.conf.set(names[0], str(size))
        spark.conf.set(names[1], "0")
        spark.conf.set(names[2], "1")

    yield cut
    for name, value in before.items():
        spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def cells(pick):
    bits = ["x", "1.5", "é", '"', ",", "\n", "\n\n", " ", "word", ""]
    return ["".join(pick.choice(bits) for _ in range(pick.randrange(6))) for _ in range(3)]


def write(path, rows, end="\n"):
    with open(path, "w", newline="") as file:
        writer = csv.writer(file, lineterminator=end)
        writer.writerow(["c", "a", "b"])
        writer.writerows(rows)


def read(rows):
    return [tuple(r[c] or "" for c in COLUMNS) for r in rows.orderBy("seq").collect()]


@pytest.mark.parametrize("size", [7, 40, 1000, 100_000])
def test_any_split_gives_the_rows_of_the_file(spark, tmp_path, small_splits, size):
    pick = random.Random(size)
    rows = [r for r in (cells(pick) for _ in range(300 if size > 7 else 25)) if any(r)]
    write(tmp_path / "f.csv", rows)
    small_splits(size)
    got = read(csv_tables.scan_text(spark, str(tmp_path / "f.csv"), COLUMNS, "split"))
    assert got == [(a, b, c) for c, a, b in rows]


def test_equals_multiline_with_carriage_returns(spark, tmp_path, small_splits):
    rows = [["1", 'say "hi"', "two\nlines"], ["2", "plain", ""], ["3", "a,b", "three\n\nlines"], ["4", "end", "x"]]
    write(tmp_path / "f.csv", rows, "\r\n")
    whole = csv_tables.scan_text(spark, str(tmp_path / "f.csv"), COLUMNS).orderBy("seq").collect()
    small_splits(9)
    split = csv_tables.scan_text(spark, str(tmp_path / "f.csv"), COLUMNS, "split").orderBy("seq").collect()
    assert [tuple(r)[:3] for r in split] == [tuple(r)[:3] for r in whole]


def test_run_folders_and_several_files(spark, tmp_path, small_splits):
    want = set()
    for run in ("007", "b"):
        for part in range(3):
            folder = tmp_path / "in" / f"run_id={run}"
            folder.mkdir(parents=True, exist_ok=True)
            rows = [[f"{part}.{i}", "first\nsecond", '"'] for i in range(20)]
            write(folder / f"{part}.csv", rows)
            want |= {(run, "first\nsecond", '"', r[0]) for r in rows}
    small_splits(50)
    got = csv_tables.scan_text(spark, str(tmp_path / "in"), COLUMNS, "split")
    assert {tuple(r)[:4] for r in got.collect()} == want and got.count() == len(want)


def test_a_file_with_another_header_is_an_error(spark, tmp_path):
    write(tmp_path / "a.csv", [["1", "2", "3"]])
    (tmp_path / "b.csv").write_text("a,b,c\n1,2,3\n")
    with pytest.raises(Exception, match="header differs"):
        csv_tables.scan_text(spark, str(tmp_path), COLUMNS, "split").collect()
    with pytest.raises(ValueError, match="lacks columns"):
        csv_tables.scan_text(spark, str(tmp_path), {"z": "string"}, "split")


def test_a_hundred_megabytes_are_read_by_many_tasks(spark, tmp_path, small_splits):
    pick = random.Random(1)
    block = [[str(i), "line one\nline two " + "x" * pick.randrange(200), 'q "q" ' * (i % 3)] for i in range(5000)]
    with open(tmp_path / "f.csv", "w", newline="") as file:
        writer = csv.writer(file, lineterminator="\n")
        writer.writerow(["c", "a", "b"])
        count = 0
        while file.tell() < 100 << 20:
            writer.writerows(block)
            count += len(block)
    small_splits(8 << 20)
    assert split_csv._lines(spark, str(tmp_path / "f.csv")).rdd.getNumPartitions() > 8
    path = str(tmp_path / "f.csv")
    keys = ["sum(xxhash64(a, b, c) % 1000003) as h", "count(*) as n", "count(distinct a) as d"]
    split = csv_tables.scan_text(spark, path, COLUMNS, "split").selectExpr(*keys).first()
    whole = csv_tables.scan_text(spark, path, COLUMNS).selectExpr(*keys).first()
    assert split == whole and split.n == count
