"""Metric-by-metric comparison of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trackmill.functions.changes import (
    METRIC_NAMES,
    METRICS,
    absolute_change,
    assessment,
    percentage_change,
)
from trackmill.functions.numbers import finite_or_null
from trackmill.operators.runs import newest_first, processing_summary
from trackmill.operators.skew import salted_join


def metric_definitions(spark: SparkSession) -> DataFrame:
    """The metric dictionary as a table in report order."""
    rows = [(i, m.name, m.label, m.unit, m.higher_is_better) for i, m in enumerate(METRICS)]
    return spark.createDataFrame(
        rows, "ord bigint, name string, label string, unit string, higher_is_better boolean"
    )


def document_metrics(m: Column) -> list[Column]:
    """The comparable metrics of a parsed manifest; anything but a finite number is null."""
    fields = processing_summary(m)
    return [finite_or_null(fields[name]).alias(name) for name in METRIC_NAMES]


def comparable(runs: DataFrame) -> DataFrame:
    """Runs with measured metrics."""
    return runs.where(F.col("processing_metrics_available"))


def default_pair(runs: DataFrame, group: str | None = None) -> DataFrame:
    """Newest comparable run as candidate, the one before it as baseline.

    With ``group`` one pair per group. Only the two best rows of a group leave
    each input partition (Spark's window group limit), so a group holding a large
    part of all runs costs its reducer two rows per partition. Fewer than two
    comparable runs give no pair.
    """
    slim = comparable(runs).select("run_id", "finished_at_utc", *([group] if group else []))
    if group is None:
        newest = slim.orderBy(*newest_first(slim)).limit(2).withColumn("_all", F.lit(1))
    else:
        newest = slim.withColumnRenamed(group, "_all")
    order = W.partitionBy("_all").orderBy(*newest_first(slim))
    ranked = newest.withColumn("_rank", F.row_number().over(order)).where("_rank <= 2")
    pairs = ranked.groupBy("_all").agg(
        F.max(F.when(F.col("_rank") == 2, F.col("run_id"))).alias("baseline_run_id"),
        F.max(F.when(F.col("_rank") == 1, F.col("run_id"))).alias("candidate_run_id"),
    )
    kept = pairs.where(F.col("baseline_run_id").isNotNull())
    return kept.drop("_all") if group is None else kept.withColumnRenamed("_all", group)


def pair_metrics(pairs: DataFrame, metrics: DataFrame) -> DataFrame:
    """Pairs with ``b_`` and ``c_`` metric columns; equal or unknown ids give no row.

    A run that is the baseline (or the candidate) of very many pairs is a hot key: it is found by
    counting the pairs, and only its metrics are repeated for the tasks that share its pairs.
    """

    def side(prefix: str, key: str) -> DataFrame:
        return metrics.select(
            F.col("run_id").alias(key),
            *[F.col(name).alias(f"{prefix}_{name}") for name in METRIC_NAMES],
        )

    different = pairs.where(F.col("baseline_run_id") != F.col("candidate_run_id"))
    spread = F.struct(*different.columns)
    based = salted_join(different, side("b", "baseline_run_id"), "baseline_run_id", spread)
    return salted_join(based, side("c", "candidate_run_id"), "candidate_run_id", spread, counted=different)


def compare(pairs: DataFrame, metrics: DataFrame) -> DataFrame:
    """One row per pair and metric."""
    entries = F.array(
        *[
            F.struct(
                F.lit(i).cast("bigint").alias("ord"),
                F.lit(m.name).alias("name"),
                F.lit(m.label).alias("label"),
                F.lit(m.unit).alias("unit"),
                F.lit(m.higher_is_better).cast("boolean").alias("higher_is_better"),
                F.col(f"b_{m.name}").alias("baseline"),
                F.col(f"c_{m.name}").alias("candidate"),
            )
            for i, m in enumerate(METRICS)
        ]
    )
    long = pair_metrics(pairs, metrics).select(
        "baseline_run_id", "candidate_run_id", F.inline(entries)
    )
    b, c = F.col("baseline"), F.col("candidate")
    return long.select(
        *long.columns,
        (b.isNotNull() & c.isNotNull()).alias("available"),
        absolute_change(b, c).alias("absolute_change"),
        percentage_change(b, c).alias("percentage_change"),
        assessment(b, c, F.col("higher_is_better")).alias("assessment"),
    )


def scorecard(pairs: DataFrame, metrics: DataFrame) -> DataFrame:
    """Counts of available, improved, regressed and unchanged metrics per pair.

    All metrics of a pair sit in one row after the join, so the counts are a
    projection and need no further grouping.
    """
    wide = pair_metrics(pairs, metrics)

    def verdict(m) -> Column:
        direction = F.lit(m.higher_is_better).cast("boolean")
        return assessment(F.col(f"b_{m.name}"), F.col(f"c_{m.name}"), direction)

    def total(test) -> Column:
        count = F.lit(0).cast("bigint")
        for m in METRICS:
            count = count + F.when(test(verdict(m)), 1).otherwise(0)
        return count

    return wide.select(
        "baseline_run_id",
        "candidate_run_id",
        total(lambda v: v != "unavailable").alias("available_metric_count"),
        F.lit(len(METRICS)).cast("bigint").alias("total_metric_count"),
        total(lambda v: v == "improved").alias("improved_metric_count"),
        total(lambda v: v == "regressed").alias("regressed_metric_count"),
        total(lambda v: v == "unchanged").alias("unchanged_metric_count"),
    )
