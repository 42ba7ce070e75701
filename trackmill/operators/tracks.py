"""Track summaries, grades and their counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackmill.functions.grading import StableThresholds, quality_level, quality_reason
from trackmill.functions.numbers import join_parts, py_round, sum_parts
from trackmill.schemas import EVALUATED_COLUMNS, SUMMARY_COLUMNS

_CONFIDENCE_DIGITS = 4


def summarize(observations: DataFrame) -> DataFrame:
    """One summary row per ``(run_id, track_id)``.

    Two hash-partitioned steps. The first groups by label as well, so the second
    sees one row per track and label; both combine map-side, so a track that
    holds a large part of all rows still reaches its reducer as one row per
    input partition. Rows are ordered by frame, then by ``seq`` (their position
    in the recording, if there), which also decides label ties: the label seen
    first wins.
    """
    whole, rest = sum_parts(F.col("confidence"), _CONFIDENCE_DIGITS)
    seq = F.col("seq") if "seq" in observations.columns else F.lit(0)
    moment = F.struct(
        F.col("frame_number").alias("frame"),
        seq.alias("seq"),
        F.col("timestamp_seconds").alias("seconds"),
        F.col("center_x").alias("x"),
        F.col("center_y").alias("y"),
    )
    per_label = observations.groupBy("run_id", "track_id", "label").agg(
        F.count("*").alias("n"),
        whole.alias("confidence_whole"),
        rest.alias("confidence_rest"),
        F.min(moment).alias("first"),
        F.max(moment).alias("last"),
    )
    rank = F.struct("n", -F.col("first.frame"), -F.col("first.seq"), "label")
    per_track = per_label.groupBy("run_id", "track_id").agg(
        F.max_by("label", rank).alias("dominant_label"),
        F.sum("n").alias("observation_count"),
        F.sum("confidence_whole").alias("confidence_whole"),
        F.sum("confidence_rest").alias("confidence_rest"),
        F.min("first").alias("first"),
        F.max("last").alias("last"),
    )
    total = join_parts(F.col("confidence_whole"), F.col("confidence_rest"), _CONFIDENCE_DIGITS)
    dx = F.col("last.x") - F.col("first.x")
    dy = F.col("last.y") - F.col("first.y")
    lasting = F.greatest(F.lit(0.0), F.col("last.seconds") - F.col("first.seconds"))
    return per_track.select(
        "run_id",
        "track_id",
        "dominant_label",
        "observation_count",
        F.col("first.frame").alias("first_frame"),
        F.col("last.frame").alias("last_frame"),
        py_round(F.col("first.seconds"), 3).alias("first_seen_seconds"),
        py_round(F.col("last.seconds"), 3).alias("last_seen_seconds"),
        py_round(lasting, 3).alias("duration_seconds"),
        py_round(total / F.col("observation_count"), 4).alias("average_confidence"),
        py_round(F.col("first.x"), 2).alias("start_center_x"),
        py_round(F.col("first.y"), 2).alias("start_center_y"),
        py_round(F.col("last.x"), 2).alias("end_center_x"),
        py_round(F.col("last.y"), 2).alias("end_center_y"),
        py_round(F.sqrt(dx * dx + dy * dy), 2).alias("displacement_pixels"),
    ).select("run_id", *SUMMARY_COLUMNS)


def evaluate(
    summaries: DataFrame, thresholds: StableThresholds = StableThresholds()
) -> DataFrame:
    """Grade every summary row; rows are neither merged nor dropped."""
    count, seconds, mean = (
        F.col("observation_count"),
        F.col("duration_seconds"),
        F.col("average_confidence"),
    )
    graded = summaries.withColumn("quality_level", quality_level(count, seconds, mean, thresholds))
    reasoned = graded.withColumn(
        "quality_reason", quality_reason(F.col("quality_level"), count, mean)
    )
    return reasoned.select("run_id", *EVALUATED_COLUMNS)


def nest_positions(tracks: DataFrame) -> DataFrame:
    """Replace the four centre columns by two ``struct<x,y>`` columns."""
    flat = ("start_center_x", "start_center_y", "end_center_x", "end_center_y")
    return tracks.select(
        *[c for c in tracks.columns if c not in flat],
        F.struct(
            F.col("start_center_x").alias("x"), F.col("start_center_y").alias("y")
        ).alias("start_position"),
        F.struct(F.col("end_center_x").alias("x"), F.col("end_center_y").alias("y")).alias(
            "end_position"
        ),
    )


def flatten_positions(tracks: DataFrame) -> DataFrame:
    """Inverse of :func:`nest_positions`."""
    nested = ("start_position", "end_position")
    return tracks.select(
        *[c for c in tracks.columns if c not in nested],
        F.col("start_position.x").alias("start_center_x"),
        F.col("start_position.y").alias("start_center_y"),
        F.col("end_position.x").alias("end_center_x"),
        F.col("end_position.y").alias("end_center_y"),
    )


def quality_counts(tracks: DataFrame) -> DataFrame:
    """Zero-filled level counts per run; ``total`` counts every row, whatever its level."""
    level = F.col("quality_level")
    return tracks.groupBy("run_id").agg(
        F.count_if(level == "stable").alias("stable"),
        F.count_if(level == "tentative").alias("tentative"),
        F.count_if(level == "weak").alias("weak"),
        F.count("*").alias("total"),
    )


def label_counts(tracks: DataFrame) -> DataFrame:
    """Tracks per run and dominant label."""
    return tracks.groupBy("run_id", "dominant_label").agg(F.count("*").alias("track_count"))


def ordered_label_counts(tracks: DataFrame) -> DataFrame:
    """Label counts, most frequent first, labels of equal count in text order."""
    return label_counts(tracks).orderBy("run_id", F.desc("track_count"), "dominant_label")


def track_counts(tracks: DataFrame) -> DataFrame:
    """Tracks per run."""
    return tracks.groupBy("run_id").agg(F.count("*").alias("track_count"))


def statistics(tracks: DataFrame) -> DataFrame:
    """Totals, level counts and label counts of every run as ``(section, name, value)``.

    One scan: counts per run and label first, everything else from that.
    """
    level = F.col("quality_level")
    by_label = tracks.groupBy("run_id", "dominant_label").agg(
        F.count("*").alias("n"),
        *[F.count_if(level == name).alias(name) for name in ("stable", "tentative", "weak")],
    )

    def entry(section: str, name: Column, n: str) -> Column:
        return F.struct(
            F.lit(section).alias("section"), name.alias("name"), F.col(n).alias("n")
        )

    parts = F.array(
        entry("total", F.lit("tracks"), "n"),
        *[entry("quality", F.lit(name), name) for name in ("stable", "tentative", "weak")],
        entry("label", F.col("dominant_label"), "n"),
    )
    return (
        by_label.select("run_id", F.inline(parts))
        .groupBy("run_id", "section", "name")
        .agg(F.sum("n").alias("value"))
    )
