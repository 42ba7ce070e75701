"""Sums of any doubles that are exact, whatever the order of the rows.

A double is cut into at most four pieces of 24 bits at fixed binary places (*bins*), each an integer.
Integers add up exactly in any order, map-side too, and a bin overflows only after 2^38
rows. At the end a group has one small integer per bin, and the sum is their exact value, rounded
once. Works in batches and, as a streaming aggregation with a row per group and bin, on streams.
"""

from __future__ import annotations

from fractions import Fraction

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackmill.functions.numbers import is_finite

WIDTH = 24
PIECES = 4
#: Bins that count what is no ordinary number.
NAN, PLUS, MINUS = 1001, 1002, 1003
PARTS = ("name", "bin", "total")


def _half(k: Column) -> Column:
    """The square root of a bin's place value, so that two steps neither overflow nor underflow. Powers of two are exact."""
    return F.pow(F.lit(2.0), k * (WIDTH // 2))


def exact_parts(rows: DataFrame, keys: list[str], values: dict[str, Column], count: str | None = None) -> DataFrame:
    """Combinable parts of the sums: keys, name, bin, total.

    Null values add nothing; a group whose values are all null has a part of zero. ``count``: name
    under which rows are counted.
    """
    entries = [F.struct(F.lit(name).alias("name"), value.cast("double").alias("_x")) for name, value in values.items()]
    if count is not None:
        entries.append(F.struct(F.lit(count).alias("name"), F.lit(1.0).alias("_x")))
    long = rows.select(*keys, F.inline(F.array(*entries)))
    usual = is_finite(F.col("_x")) & (F.col("_x") != 0)
    cut = long.withColumn("_k", F.when(usual, F.floor(F.log2(F.abs("_x")) / WIDTH).cast("int"))).withColumn("_r", F.when(usual, F.col("_x")))
    for n in range(PIECES):
        half = _half(F.col("_k") - n)
        cut = cut.withColumn(f"_p{n}", (F.col("_r") / half / half).cast("bigint"))
        cut = cut.withColumn("_r", F.col("_r") - F.col(f"_p{n}") * half * half)
    odd = F.when(F.isnan("_x"), NAN).when(F.col("_x") == float("inf"), PLUS).when(F.col("_x") == -float("inf"), MINUS)
    pieces = [F.struct((F.col("_k") - n).alias("bin"), F.col(f"_p{n}").alias("piece")) for n in range(PIECES)]
    alone = F.array(F.struct(F.coalesce(odd, F.lit(0)).alias("bin"), F.when(odd.isNull(), 0).otherwise(1).cast("bigint").alias("piece")))
    # The first piece stays even when it is zero, so no group is lost.
    found = F.when(usual, F.filter(F.array(*pieces), lambda p, n: (p["piece"] != 0) | (n == 0))).otherwise(alone)
    parts = cut.select(*keys, "name", F.inline(found))
    return parts.groupBy(*keys, "name", "bin").agg(F.sum("piece").alias("total"))


def exact_totals(parts: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """Sums from their parts: keys and one column per name, null where a group has no part of it."""
    entry = F.struct("bin", "total")
    grouped = parts.groupBy(*keys).agg(*[F.collect_list(F.when(F.col("name") == n, entry)).alias(n) for n in names])

    def has(n: str, code: int) -> Column:
        return F.exists(n, lambda e: e["bin"] == code)

    def value(n: str) -> Column:
        # pandas gives NaN back as null.
        return F.when(has(n, NAN) | (has(n, PLUS) & has(n, MINUS)), float("nan")).otherwise(_value(F.col(n))).alias(n)

    return grouped.select(*keys, *[value(n) for n in names])


def exact_value(bins: list[int], totals: list[int]) -> float | None:
    """The double nearest to the sum of ``total * 2^(24 bin)``; infinite beyond the largest double."""
    found = dict(zip(bins, totals))
    nan, plus, minus = (found.pop(b, 0) for b in (NAN, PLUS, MINUS))
    if nan or (plus and minus):
        return float("nan")
    if plus or minus:
        return float("inf") if plus else -float("inf")
    exact = sum(Fraction(total) * Fraction(2) ** (WIDTH * b) for b, total in found.items())
    try:
        return exact.numerator / exact.denominator
    except OverflowError:
        return float("inf") if exact > 0 else -float("inf")


@F.pandas_udf(T.DoubleType())
def _value(entries: pd.Series) -> pd.Series:
    # A list per group, a few dozen integers at most.
    return entries.map(lambda row: exact_value([e["bin"] for e in row], [int(e["total"]) for e in row]) if len(row) else None)
