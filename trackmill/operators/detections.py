"""From raw boxes to frame-level observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackmill.functions.numbers import py_round

# Frame rate used when the source reports none, and the decimals
# kept in an observation.
DEFAULT_FPS = 30.0
TIME_DIGITS, CONFIDENCE_DIGITS, GEOMETRY_DIGITS = 3, 4, 2


def explode_messages(messages: DataFrame) -> DataFrame:
    """One row per detection of ``sensor_id, timestamp, detections array<struct>``."""
    return messages.select("sensor_id", "timestamp", F.inline("detections"))


def effective_fps(fps: Column) -> Column:
    """Source frame rate, or the default when it is not positive."""
    return F.when(fps <= 0, DEFAULT_FPS).otherwise(fps)


def frame_timestamp(frame_number: Column, fps: Column) -> Column:
    """Seconds from the start of the recording to a 1-based frame."""
    return (frame_number - 1) / effective_fps(fps)


def with_geometry(boxes: DataFrame) -> DataFrame:
    """Add width, height and centre from the unrounded corners."""
    width = F.col("x2") - F.col("x1")
    height = F.col("y2") - F.col("y1")
    return boxes.withColumns(
        {
            "width": width,
            "height": height,
            "center_x": F.col("x1") + width / 2,
            "center_y": F.col("y1") + height / 2,
        }
    )


def with_labels(boxes: DataFrame, classes: DataFrame) -> DataFrame:
    """Look up class labels; a box of an unknown class keeps a null label.

    ``classes`` is the class dictionary of the model. Spark broadcasts it when its
    measured size is under the broadcast threshold and joins by shuffle otherwise.
    """
    return boxes.join(classes.select("class_id", "label"), "class_id", "left")


def observations(detections: DataFrame, classes: DataFrame) -> DataFrame:
    """Confirmed boxes as rounded observations.

    Needs ``run_id, frame_number, timestamp_seconds, raw_track_id, class_id,
    confidence, x1, y1, x2, y2`` and a ``seq`` that orders the boxes of a frame.
    """
    confirmed = detections.where(F.col("raw_track_id").isNotNull())
    boxes = with_labels(with_geometry(confirmed), classes)
    geometry = ("x1", "y1", "x2", "y2", "center_x", "center_y", "width", "height")
    return boxes.select(
        "run_id",
        F.col("frame_number").cast("bigint").alias("frame_number"),
        "seq",
        py_round(F.col("timestamp_seconds"), TIME_DIGITS, apart=True).alias("timestamp_seconds"),
        F.col("raw_track_id").cast("bigint").alias("track_id"),
        "label",
        py_round(F.col("confidence"), CONFIDENCE_DIGITS, apart=True).alias("confidence"),
        *[py_round(F.col(c), GEOMETRY_DIGITS, apart=True).alias(c) for c in geometry],
    )
