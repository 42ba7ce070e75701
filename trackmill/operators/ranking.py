"""Filtered and ranked track reads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trackmill.functions.checks import require_fraction, require_limit, require_quality
from trackmill.operators.runs import newest_first


def matching(
    tracks: DataFrame, quality: str | None = None, minimum_confidence: float = 0.0
) -> DataFrame:
    """Tracks of a level (optional) with at least a mean confidence."""
    require_quality(quality)
    require_fraction(minimum_confidence, "minimum_confidence")
    confidence = F.col("average_confidence")
    kept = tracks.where((confidence >= minimum_confidence) & ~F.isnan(confidence))
    return kept if quality is None else kept.where(F.col("quality_level") == quality)


def best_first() -> list:
    """Track order: confidence descending, then track id."""
    return [F.col("average_confidence").desc(), F.col("track_id").asc()]


def top_tracks(tracks: DataFrame, limit: int = 100) -> DataFrame:
    """The best tracks of one run or snapshot."""
    require_limit(limit)
    return tracks.orderBy(*best_first()).limit(limit)


def top_tracks_per_run(tracks: DataFrame, limit: int = 100) -> DataFrame:
    """The best tracks of every run with their 1-based place.

    The rank filter becomes a window group limit below the shuffle: each input
    partition sends at most ``limit`` rows per run.
    """
    require_limit(limit)
    order = W.partitionBy("run_id").orderBy(*best_first())
    ranked = tracks.withColumn("place", F.row_number().over(order).cast("bigint"))
    return ranked.where(F.col("place") <= limit)


def with_envelope(page: DataFrame, matches: DataFrame, limit: int) -> DataFrame:
    """Put the number of matches and of returned rows beside a page.

    The count is a scalar subquery, so the page itself is not shuffled again.
    """
    total = matches.agg(F.count("*").alias("n")).scalar()
    return page.select("*", total.alias("total_matching")).withColumn(
        "returned", F.least("total_matching", F.lit(limit).cast("bigint"))
    )


def page_sizes(matches: DataFrame, limit: int = 100) -> DataFrame:
    """Matches and returned rows per run."""
    require_limit(limit)
    return matches.groupBy("run_id").agg(F.count("*").alias("total_matching")).withColumn(
        "returned", F.least("total_matching", F.lit(limit).cast("bigint"))
    )


def newest_run_with_tracks(runs: DataFrame, tracks: DataFrame) -> DataFrame:
    """Id of the newest run that has at least one stored track.

    Track rows are reduced to one per run before the semi join, so a run with
    very many tracks does not weigh on it.
    """
    present = tracks.groupBy("run_id").agg(F.count("*").alias("n")).select("run_id")
    slim = runs.select("run_id", "finished_at_utc")
    return (
        slim.join(present, "run_id", "left_semi")
        .orderBy(*newest_first(slim))
        .limit(1)
        .select("run_id")
    )
