import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trackmill.functions.checks import require_quality, require_run_id, valid_run_id
from trackmill.functions.documents import (
    canonical_json,
    manifest_error,
    stages_error,
    truthy,
    with_json,
)
from trackmill.functions.numbers import exact_mean, exact_sum, finite_or_null, py_round
from trackmill.operators.detections import frame_timestamp


def doubles(spark, values):
    return spark.createDataFrame([(v,) for v in values], "x double")


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    values=st.lists(
        st.one_of(
            st.floats(allow_nan=False, allow_infinity=False, width=64),
            st.integers(-10**9, 10**9).map(lambda k: k / 2 / 10**4),
            st.integers(-10**6, 10**6).map(lambda k: k * 5 / 10**5),
        ),
        min_size=1,
        max_size=200,
    ),
    digits=st.sampled_from([0, 2, 3, 4, 6]),
)
def test_rounding_equals_python(spark, values, digits):
    got = doubles(spark, values).select("x", py_round(F.col("x"), digits).alias("y")).collect()
    assert [r.y for r in got] == [round(r.x, digits) + 0.0 for r in got]


def test_rounding_ties_and_odd_values(spark):
    values = [0.0005, 5e-05, 0.285, 2.675, 0.5, 1.5, -0.5, -0.0004, 1e300, 4503599627370497.5]
    got = doubles(spark, values).select("x", py_round(F.col("x"), 3).alias("y")).collect()
    assert [r.y for r in got] == [round(v, 3) + 0.0 for v in values]
    odd = doubles(spark, [math.nan, math.inf, -math.inf, None]).select(py_round(F.col("x"), 2))
    nan, up, down, null = [r[0] for r in odd.collect()]
    assert math.isnan(nan) and up == math.inf and down == -math.inf and null is None


def test_sums_do_not_depend_on_partitions(spark):
    values = [round(0.0001 * i, 4) for i in range(1, 9999)]
    for parts in (1, 7):
        row = (
            doubles(spark, values)
            .repartition(parts)
            .agg(exact_sum(F.col("x"), 4).alias("s"), exact_mean(F.col("x"), 4).alias("m"))
            .first()
        )
        assert row.s == 9998 * 9999 / 2 / 10000
        assert row.m == row.s / 9998


def test_sum_keeps_more_decimals_and_nan(spark):
    row = doubles(spark, [0.123456, 1e300]).agg(exact_sum(F.col("x"), 4).alias("s")).first()
    assert row.s == 1e300
    row = doubles(spark, [0.123456, 0.1]).agg(exact_sum(F.col("x"), 4).alias("s")).first()
    assert row.s == pytest.approx(0.223456, abs=1e-15)
    row = doubles(spark, [math.nan, 0.1]).agg(exact_sum(F.col("x"), 4).alias("s")).first()
    assert math.isnan(row.s)


def test_finite_guard(spark):
    got = doubles(spark, [1.5, math.nan, math.inf, -math.inf, None])
    assert [r[0] for r in got.select(finite_or_null(F.col("x"))).collect()] == [1.5] + [None] * 4


def test_frame_timestamp_falls_back_to_thirty(spark):
    rows = spark.createDataFrame([(31, 10.0), (31, 0.0), (1, 25.0)], "f bigint, fps double")
    got = rows.select(frame_timestamp(F.col("f"), F.col("fps")).alias("t")).collect()
    assert [r.t for r in got] == [3.0, 1.0, 0.0]


@pytest.mark.parametrize(
    ("run_id", "good"),
    [("run-1", True), ("a" * 128, True), ("a" * 129, False), ("../unsafe", False),
     ("bad$id", False), ("", False), ("run\n", False), (".x", False), ("9._-", True)],
)
def test_run_ids(spark, run_id, good):
    row = spark.createDataFrame([(run_id,)], "r string").select(valid_run_id(F.col("r"))).first()
    assert row[0] is good
    if good:
        assert require_run_id(run_id) == run_id
    else:
        with pytest.raises(ValueError):
            require_run_id(run_id)


def test_quality_argument():
    assert require_quality(None) is None
    with pytest.raises(ValueError):
        require_quality("excellent")


def test_manifest_errors(spark):
    cases = {
        '{"run_id": "a"}': None,
        ' {"run_id": "a", "x": NaN} \n': None,
        "{invalid JSON": "Invalid JSON",
        '{"run_id": "a"} {"run_id": "a"}': "Invalid JSON",
        '{"run_id": "a"}, {}': "Invalid JSON",
        "": "Invalid JSON",
        "[1, 2]": "Manifest root value must be an object",
        '"text"': "Manifest root value must be an object",
        "null": "Manifest root value must be an object",
        "{}": "Manifest must contain a string run_id",
        '{"run_id": 5}': "Manifest must contain a string run_id",
        '{"run_id": null}': "Manifest must contain a string run_id",
        '{"run_id": "../unsafe"}': "Run ID is not safe",
        '{"run_id": "b"}': "Manifest run_id does not match its filename",
    }
    rows = spark.createDataFrame([(t,) for t in cases], "t string")
    error = manifest_error(F.col("json"), F.col("t"), F.lit("a"))
    got = with_json(rows, "t").select("t", error.alias("e")).collect()
    assert {r.t: r.e for r in got} == cases


def test_stage_list_check(spark):
    cases = {
        '{"stages": []}': True, "{}": True, '{"stages": null}': False,
        '{"stages": {}}': False, '{"stages": "[]"}': False,
    }
    rows = spark.createDataFrame([(t,) for t in cases], "t string")
    got = with_json(rows, "t").select("t", stages_error(F.col("json")).alias("e")).collect()
    assert {r.t: r.e is None for r in got} == cases


def test_truthiness(spark):
    cases = {"true": True, "false": False, "1": True, "0": False, "0.0": False, '"false"': True,
             '""': False, "[]": False, "[0]": True, "{}": False, '{"a":0}': True, "null": False}
    rows = spark.createDataFrame([(t,) for t in cases], "t string")
    got = rows.select("t", truthy(F.parse_json("t")).alias("v")).collect()
    assert {r.t: r.v for r in got} == cases


def test_canonical_json(spark):
    rows = spark.createDataFrame([('{ "b": [1, null], "a": {"d": 1, "c": 2} }',)], "t string")
    got = rows.select(canonical_json(F.col("t"))).first()[0]
    assert got == '{"a":{"c":2,"d":1},"b":[1,null]}'
