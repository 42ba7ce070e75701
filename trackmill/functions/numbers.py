"""Number expressions whose results must not depend on partitioning or on ties."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# Bound on the relative error of one product of doubles, with a margin.
_PRODUCT_ERROR = 2.3e-16


def _round_text(x: Column, digits: int) -> Column:
    pattern = "0." + "0" * digits if digits else "0"
    formatted = F.call_function("format_number", x, F.lit(pattern)).try_cast("double")
    by_text = F.coalesce(formatted, x)
    # The formatter loses the lone digit 5 right behind the last kept place.
    lone = float(f"5e-{digits + 1}")
    if round(lone, digits) > 0:
        by_text = F.when(F.abs(x) == lone, F.signum(x) * round(lone, digits)).otherwise(by_text)
    return by_text


def py_round(x: Column, digits: int, apart: bool = False) -> Column:
    """Round the exact binary value half-to-even, as Python's ``round`` does.

    When the scaled product is further from a tie than its own rounding error,
    ``rint(x * 10^d) / 10^d`` is already the correctly rounded result and stays
    in generated arithmetic. Only rows near a tie, and numbers too large for
    that, go through decimal formatting. NaN and infinities pass through; -0.0
    becomes 0.0. ``apart`` keeps the formatting out of generated code, for steps that round so many
    columns that one method of them all would be too large to be compiled; the results are equal.
    """
    scale = F.lit(float(10**digits))
    scaled = x * scale
    nearest = F.rint(scaled)
    off = F.abs(scaled - nearest) + F.abs(scaled) * _PRODUCT_ERROR
    by_text = F.get(F.transform(F.array(x), lambda v: _round_text(v, digits)), F.lit(0)) if apart else _round_text(x, digits)
    return F.when(off < 0.499999, nearest / scale).otherwise(by_text) + F.lit(0.0)


def is_finite(x: Column) -> Column:
    """True for ordinary numbers, false for NaN and infinities, null for null."""
    return ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def finite_or_null(x: Column) -> Column:
    """Keep finite numbers; NaN, infinities and null become null."""
    return F.when(is_finite(x), x)


# Scaled values up to here are whole doubles; they are summed in two parts of so many bits.
_WHOLE = 9.0e15
_LOW = 1 << 24


def _scaled_integer(x: Column, digits: int) -> Column:
    scaled = F.rint(x * float(10**digits))
    return F.when(F.abs(scaled) <= _WHOLE, scaled).otherwise(0.0)


def sum_parts(x: Column, digits: int) -> tuple[Column, Column]:
    """Two partial aggregates for an order-independent sum of decimal-like doubles.

    Values with at most ``digits`` decimals land completely in the whole part, a decimal
    that holds 2^34 values of any size up to 9e15 / 10^digits and is exact in any order.
    Whatever is left (more decimals, larger values, NaN, infinities) is summed as double;
    ``operators.sums`` is exact for those too. Both parts combine map-side.
    """
    whole = _scaled_integer(x, digits)
    rest = x - whole / float(10**digits)
    high = F.floor(whole / _LOW)
    low = whole - high * _LOW
    wide = F.sum(high.cast("bigint")).cast("decimal(38,0)") * _LOW + F.sum(low.cast("bigint"))
    return wide.cast("decimal(38,0)"), F.sum(rest)


def join_parts(whole: Column, rest: Column, digits: int) -> Column:
    """Put the two sums of :func:`sum_parts` back together."""
    return whole.cast("double") / F.lit(float(10**digits)) + rest


def exact_sum(x: Column, digits: int) -> Column:
    """Order-independent sum; null for an empty group."""
    whole, rest = sum_parts(x, digits)
    return join_parts(whole, rest, digits)


def exact_mean(x: Column, digits: int) -> Column:
    """Order-independent mean; null for an empty group."""
    return exact_sum(x, digits) / F.count(x)
