"""Row checks, duplicate keys and orphans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackmill.functions.checks import QUALITY_LEVELS

DUPLICATE_TEXT = "Track IDs must be unique within one run"


def _fails(rule: Column) -> Column:
    """A rule that is false or unknown counts as broken."""
    return ~F.coalesce(rule, F.lit(False))


def track_rules() -> dict[str, Column]:
    """Row-level rules of an evaluated track, by message, in checking order."""
    required = (
        "track_id",
        "dominant_label",
        "quality_reason",
        "observation_count",
        "duration_seconds",
        "average_confidence",
        "displacement_pixels",
        "first_frame",
        "last_frame",
        "first_seen_seconds",
        "last_seen_seconds",
        "start_center_x",
        "start_center_y",
        "end_center_x",
        "end_center_y",
    )
    present = F.lit(True)
    for name in required:
        present = present & F.col(name).isNotNull()
    confidence = F.col("average_confidence")
    return {
        "quality must be stable, tentative, or weak": F.col("quality_level").isin(*QUALITY_LEVELS),
        "a required field is missing": present,
        "track_id cannot be negative": F.col("track_id") >= 0,
        "observation_count cannot be negative": F.col("observation_count") >= 0,
        # NaN sorts above 1 in Spark, so it fails this rule as it should.
        "average_confidence must be between 0 and 1": (confidence >= 0) & (confidence <= 1),
    }


def with_violations(tracks: DataFrame) -> DataFrame:
    """Add ``violations``: the messages of all broken row rules, empty for a good row."""
    messages = [F.when(_fails(rule), message) for message, rule in track_rules().items()]
    return tracks.withColumn("violations", F.array_compact(F.array(*messages)))


def violation_counts(tracks: DataFrame) -> DataFrame:
    """Rows per run and broken rule."""
    return (
        with_violations(tracks)
        .select("run_id", F.explode("violations").alias("violation"))
        .groupBy("run_id", "violation")
        .agg(F.count("*").alias("track_count"))
    )


def duplicate_keys(tracks: DataFrame, keys: tuple[str, ...] = ("run_id", "track_id")) -> DataFrame:
    """Key combinations that occur more than once."""
    counts = tracks.groupBy(*keys).agg(F.count("*").alias("copies"))
    return counts.where(F.col("copies") > 1)


def track_report(tracks: DataFrame) -> DataFrame:
    """Level counts and the first storage problem of every run, in one pass.

    Grouping by track first finds repeated ids; freshly summarized tracks are
    already partitioned that way, and the run-level step combines map-side.
    """
    level = F.col("quality_level")
    per_track = with_violations(tracks).groupBy("run_id", "track_id").agg(
        F.count("*").alias("total"),
        F.min(F.get("violations", 0)).alias("problem"),
        *[F.count_if(level == name).alias(name) for name in QUALITY_LEVELS],
    )
    problem = F.coalesce("problem", F.when(F.col("total") > 1, DUPLICATE_TEXT))
    return per_track.groupBy("run_id").agg(
        *[F.sum(name).alias(name) for name in (*QUALITY_LEVELS, "total")],
        F.min(problem).alias("problem"),
    )


def run_track_problems(tracks: DataFrame) -> DataFrame:
    """One problem text for each run whose tracks may not be stored."""
    return track_report(tracks).where(F.col("problem").isNotNull()).select("run_id", "problem")


def orphans(tracks: DataFrame, runs: DataFrame) -> DataFrame:
    """Tracks of runs that are not known."""
    return tracks.join(runs.select("run_id"), "run_id", "left_anti")
