"""Exact sums against Python's exactly rounded ones, in any order and at any size."""

import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from trackmill.functions.numbers import exact_sum
from trackmill.operators import fusion, sums


def totals(spark, rows, parts=5):
    frame = spark.createDataFrame(rows, "k string, x double").repartition(parts)
    found = sums.exact_totals(sums.exact_parts(frame, ["k"], {"x": F.col("x")}, "n"), ["k"], ["x", "n"])
    return {r.k: (r.x, int(r.n)) for r in found.collect()}


def any_double(pick):
    while True:
        x = struct.unpack("<d", struct.pack("<Q", pick.getrandbits(64)))[0]
        if math.isfinite(x):
            return x


@pytest.mark.parametrize("parts", [1, 7])
def test_doubles_of_all_magnitudes(spark, parts):
    pick = random.Random(8)
    groups = {
        "any": [any_double(pick) / 4096 for _ in range(3000)],
        "cancel": [1e300, 1.0, -1e300, 1e-300, 5e-324] * 50,
        "small": [5e-324 * pick.randrange(1, 9) for _ in range(200)],
        "tenths": [0.1, 0.2, 0.3] * 999,
        "powers": [math.ldexp(s * m, e) for e in range(-1074, 1000, 7) for s in (1, -1) for m in (1, 3)],
        "edge": [math.nextafter(math.ldexp(1, 24 * k), d) for k in range(-40, 42) for d in (0, math.inf)],
        "huge": [9e12] * 20_000,
        "zero": [0.0, -0.0],
    }
    rows = [(k, x) for k, xs in groups.items() for x in xs]
    pick.shuffle(rows)
    assert totals(spark, rows, parts) == {k: (math.fsum(xs), len(xs)) for k, xs in groups.items()}


def test_what_is_no_number(spark):
    rows = [("n", math.nan), ("n", 1.0), ("i", math.inf), ("i", 1.0), ("m", -math.inf), ("b", math.inf), ("b", -math.inf), ("0", None), ("o", 1.7e308), ("o", 1.7e308)]
    got = {k: v[0] for k, v in totals(spark, rows).items()}
    assert math.isnan(got["n"]) and math.isnan(got["b"])
    assert (got["i"], got["m"], got["0"], got["o"]) == (math.inf, -math.inf, 0.0, math.inf)


def test_fusion_has_the_same_last_digit_in_any_order(spark):
    pick = random.Random(3)
    rows = [(f"g{i % 3}", pick.uniform(-1e9, 1e9), pick.uniform(0, 1) ** 9) for i in range(4000)]
    want = {}
    for group in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == group]
        weight = math.fsum(w for _, _, w in mine)
        want[group] = (math.fsum(x * w for _, x, w in mine) / weight, weight, len(mine))
    for parts in (1, 4, 9):
        pick.shuffle(rows)
        frame = spark.createDataFrame(rows, "fusion_id string, value double, weight double").repartition(parts)
        assert {r.fusion_id: tuple(r)[1:] for r in fusion.fuse(frame).collect()} == want


def test_a_weight_of_zero_is_an_error_without_ansi_too(spark):
    frame = spark.createDataFrame([("g", 1.0, 0.0)], "fusion_id string, value double, weight double")
    before = spark.conf.get("spark.sql.ansi.enabled")
    for ansi in ("true", "false"):
        spark.conf.set("spark.sql.ansi.enabled", ansi)
        try:
            with pytest.raises(Exception, match="weight of zero"):
                fusion.fuse(frame).collect()
        finally:
            spark.conf.set("spark.sql.ansi.enabled", before)


@pytest.mark.parametrize("digits", [2, 3])
def test_decimal_sums_of_large_values_do_not_overflow(spark, digits):
    frame = spark.range(20_000).select(F.lit(8.999e12).alias("x"))
    assert frame.agg(exact_sum(F.col("x"), digits).alias("s")).first().s == 8.999e12 * 20_000


def test_many_rows_share_few_bins(spark):
    frame = spark.range(100_000).select((F.col("id") % 2).alias("k"), (F.rand(1) * 100).alias("x"))
    assert sums.exact_parts(frame, ["k"], {"x": F.col("x")}).count() <= 2 * 12
