"""Cells of CSV files are cast once, in code that is small enough to be compiled."""

import math
import re

import pytest
from fixtures import OBSERVATION_SCHEMA, TRACK_SEVEN
from pyspark.sql import functions as F

from trackmill.functions.numbers import py_round
from trackmill.operators.detections import observations
from trackmill.operators.tracks import evaluate, summarize
from trackmill.sources import csv_tables

# HotSpot leaves longer methods to its interpreter.
LARGEST_COMPILED = 8000

PLAIN = ["0", "7", "+7", "-12", "1.5", "-1.5", ".5", "5.", "1e3", "1E-4", "1.e5", "1e", "e5", ".", "+", "-", "--1", "1-", "1e400",
         "9223372036854775807", "9223372036854775808", "1,5", "-0.0"]
ODD = [" 1", "1 ", "\t1.5", " 1_0 ", "1__0", "_1", "1_0.2_5e1_0", "nan", "-inf", "Infinity", "1d", "1.5F", "0x1p3", "0x10", "١", "\x011",
       "", " ", "true", "1.5 x"]


def strict(cell, kind):
    """What a cell is: a pattern of the file format decides, then Python reads it."""
    pattern = csv_tables.INTEGER_CELL if kind == "bigint" else csv_tables.FLOAT_CELL
    flags, pattern = (re.I, pattern[4:]) if pattern.startswith("(?i)") else (0, pattern)
    if cell is None or not re.search(pattern.replace(r"\z", r"\Z"), cell, flags | re.A):
        return None
    if kind == "double":
        return float(cell)
    value = int(cell)
    return value if -(2**63) <= value < 2**63 else None


@pytest.mark.parametrize("neighbour", ["1", " 1 ", "x", None])
@pytest.mark.parametrize("kind", ["bigint", "double"])
def test_a_cell_is_read_alike_beside_any_other(spark, kind, neighbour):
    rows = spark.createDataFrame([(i, c, neighbour, "t") for i, c in enumerate([*PLAIN, *ODD, None])], "i int, a string, b string, s string")
    got = csv_tables.typed(rows, {"a": kind, "b": "bigint", "s": "string"}).orderBy("i").collect()
    bad = [] if neighbour is not None and neighbour.strip() == "1" else ["b"]
    for row, cell in zip(got, [*PLAIN, *ODD, None], strict=True):
        want = strict(cell, kind)
        same = row.a == want or (want is not None and row.a is not None and math.isnan(want) and math.isnan(row.a))
        assert same and (row.a is None) == (want is None), (cell, row.a, want)
        assert row.bad_cells == (["a"] if want is None else []) + bad, cell
        assert (row.i, row.s) == (got.index(row), "t")


def written(spark, tmp_path):
    csv_tables.write_observations(spark.createDataFrame(TRACK_SEVEN, OBSERVATION_SCHEMA), f"{tmp_path}/o")
    return csv_tables.read_observations(spark, f"{tmp_path}/o", multiline=False)


def test_cells_are_cast_once(spark, tmp_path):
    plan = written(spark, tmp_path)._jdf.queryExecution().executedPlan().toString()
    filters = [line for line in plan.splitlines() if "Filter " in line and "FileScan" not in line]
    assert filters and not [line for line in filters if "try_cast(" in line or "RLIKE" in line]


def method_sizes(frame):
    spark, name = frame.sparkSession, "spark.sql.adaptive.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")  # an adaptive plan has no code before it runs
    try:
        text = spark._jvm.PythonSQLUtils.explainString(frame._jdf.queryExecution(), "codegen")
    finally:
        spark.conf.set(name, before)
    return [int(size) for size in re.findall(r"maxMethodCodeSize:(\d+)", text)]


def test_generated_methods_are_small_enough_to_be_compiled(spark, tmp_path):
    box = ("run-a", 1, 0, 0.0, 7, 0, 0.5, 1.0, 1.0, 2.0, 3.0)
    boxes = spark.createDataFrame([box], "run_id string, frame_number bigint, seq bigint, timestamp_seconds double, raw_track_id bigint, "
                                  "class_id bigint, confidence double, x1 double, y1 double, x2 double, y2 double")
    classes = spark.createDataFrame([(0, "car")], "class_id bigint, label string")
    read = written(spark, tmp_path)
    csv_tables.write_summaries(summarize(read), f"{tmp_path}/s")
    summaries = csv_tables.read_summaries(spark, f"{tmp_path}/s", multiline=False)
    for frame in (observations(boxes, classes), read, evaluate(summaries)):
        sizes = method_sizes(frame)
        assert sizes and max(sizes) < LARGEST_COMPILED


@pytest.mark.parametrize("digits", [0, 2, 3, 4])
def test_rounding_apart_gives_the_same(spark, digits):
    values = [0.5, 1.5, 2.5, 0.005, -0.005, 0.015, 1.005, 2.675, 0.0005, 5e-5, 1e16, 123456789012345.675, -0.0, 1.25, math.inf, -math.inf, math.nan, None]
    rows = spark.createDataFrame([(v,) for v in values], "x double")
    both = rows.select(py_round(F.col("x"), digits).alias("a"), py_round(F.col("x"), digits, apart=True).alias("b"), "x")
    for row in both.collect():
        assert repr(row.a) == repr(row.b)
        if row.x is not None and math.isfinite(row.x):
            assert row.b == round(row.x, digits)
