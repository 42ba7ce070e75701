"""Weighted fusion of sensor readings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackmill.operators.sums import PARTS, exact_parts, exact_totals

_SUMS = ["weighted_sum", "confidence", "sensor_count"]


def fuse_parts(messages: DataFrame, *keys: str) -> DataFrame:
    """Combinable integers of a fusion, one row per group, sum and bin; for batch and for streaming input."""
    weight = F.coalesce("weight", F.lit(1.0)) if "weight" in messages.columns else F.lit(1.0)
    values = {"weighted_sum": F.col("value") * weight, "confidence": weight.cast("double")}
    return exact_parts(messages, list(keys), values, "sensor_count")


def fused(parts: DataFrame) -> DataFrame:
    """Estimates from the parts: the sums are exact and rounded once, so no order of messages or tasks shows.

    A total weight of zero is an error, not a null, whatever the session's ANSI setting.
    """
    keys = [c for c in parts.columns if c not in PARTS]
    sums = exact_totals(parts, keys, _SUMS)
    zero = F.when(F.col("confidence") == 0, F.raise_error(F.lit("fusion group with a total weight of zero")).cast("double"))
    return sums.select(
        *keys,
        F.coalesce(zero, F.try_divide("weighted_sum", "confidence")).alias("fused_value"),
        "confidence",
        F.col("sensor_count").cast("bigint").alias("sensor_count"),
    )


def fuse(messages: DataFrame, key: str = "fusion_id") -> DataFrame:
    """Weighted mean, total weight and message count per fusion group.

    A group without messages has no row; a missing weight counts as 1.
    """
    return fused(fuse_parts(messages, key))
