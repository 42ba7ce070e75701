"""Per-frame activity, running totals and run totals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackmill.operators.prefix import DEFAULT_WIDTH, running_totals

# Fixed value: a progress sample is taken every 25th frame.
PROGRESS_INTERVAL = 25


def _marked(frames: DataFrame, detections: DataFrame) -> DataFrame:
    """Frames and boxes in one table, so that empty frames need no outer join."""
    box = detections.select(
        "run_id",
        "frame_number",
        F.col("raw_track_id").alias("track_id"),
        F.lit(0).cast("bigint").alias("frames"),
        F.lit(1).cast("bigint").alias("boxes"),
    )
    frame = frames.select(
        "run_id",
        "frame_number",
        F.lit(None).cast(box.schema["track_id"].dataType).alias("track_id"),
        F.lit(1).cast("bigint").alias("frames"),
        F.lit(0).cast("bigint").alias("boxes"),
    )
    return frame.unionByName(box)


def _activity(frames: DataFrame, detections: DataFrame) -> DataFrame:
    """Activity of every frame and of every place of a box, with the number of frame rows there."""
    return (
        _marked(frames, detections)
        .groupBy("run_id", "frame_number")
        .agg(
            F.sum("boxes").alias("boxes"),
            F.count("track_id").alias("observation_rows"),
            F.count_distinct("track_id").alias("active_tracks"),
            F.sum("frames").alias("frames"),
        )
    )


def frame_activity(frames: DataFrame, detections: DataFrame) -> DataFrame:
    """Boxes, confirmed rows and distinct confirmed tracks of every frame, zeros included.

    A box whose frame is not among ``frames`` makes no frame; ``boxes_without_frame`` reports it.
    """
    return _activity(frames, detections).where("frames > 0").drop("frames")


def boxes_without_frame(frames: DataFrame, detections: DataFrame) -> DataFrame:
    """Places of boxes that no frame has: run_id, frame_number, boxes, observation_rows."""
    lost = _activity(frames, detections).where("frames = 0")
    return lost.select("run_id", "frame_number", "boxes", "observation_rows")


def first_appearances(detections: DataFrame) -> DataFrame:
    """Number of tracks that appear for the first time in each frame."""
    firsts = (
        detections.where(F.col("raw_track_id").isNotNull())
        .groupBy("run_id", "raw_track_id")
        .agg(F.min("frame_number").alias("frame_number"))
    )
    return firsts.groupBy("run_id", "frame_number").agg(F.count("*").alias("new_tracks"))


def running_activity(
    frames: DataFrame, detections: DataFrame, width: int = DEFAULT_WIDTH
) -> DataFrame:
    """Frame activity with running frames, boxes, rows and unique tracks.

    A running distinct count is the running number of first appearances, in real frames
    only: boxes without a frame, which should be few, are left out by their places.
    """
    lost = boxes_without_frame(frames, detections).select("run_id", "frame_number")
    placed = detections.join(lost, ["run_id", "frame_number"], "left_anti")
    activity = frame_activity(frames, detections)
    per_frame = activity.join(
        first_appearances(placed), ["run_id", "frame_number"], "left"
    ).select(
        *activity.columns,
        F.lit(1).cast("bigint").alias("frames"),
        F.coalesce("new_tracks", F.lit(0)).alias("new_tracks"),
    )
    totals = running_totals(
        per_frame,
        "run_id",
        "frame_number",
        ["frames", "boxes", "observation_rows", "new_tracks"],
        width,
    )
    return totals.select(
        *activity.columns,
        "new_tracks",
        "running_frames",
        "running_boxes",
        F.col("running_observation_rows").alias("running_rows"),
        F.col("running_new_tracks").alias("running_unique_tracks"),
    )


def progress_samples(running: DataFrame, interval: int = PROGRESS_INTERVAL) -> DataFrame:
    """State of a run after every ``interval`` processed frames."""
    return running.where(F.col("running_frames") % interval == 0).select(
        "run_id",
        F.col("running_frames").alias("frames"),
        "active_tracks",
        F.col("running_unique_tracks").alias("unique_tracks"),
        F.col("running_rows").alias("observation_rows"),
    )


def run_totals(frames: DataFrame, detections: DataFrame) -> DataFrame:
    """Frames (empty ones too), boxes, confirmed rows and distinct tracks per run."""
    return (
        _marked(frames, detections)
        .groupBy("run_id")
        .agg(
            F.sum("frames").alias("frames_processed"),
            F.sum("boxes").alias("frame_detections"),
            F.count("track_id").alias("tracked_observations"),
            F.count_distinct("track_id").alias("unique_tracks"),
        )
    )
