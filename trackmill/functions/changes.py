"""Metric dictionary and metric-to-metric change expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from trackmill.functions.numbers import py_round


@dataclass(frozen=True)
class Metric:
    """One comparable run metric."""

    name: str
    label: str
    unit: str
    higher_is_better: bool | None


# The comparable metrics in report order.
METRICS = (
    Metric("average_processing_fps", "Average processing FPS", "fps", True),
    Metric("processing_duration_seconds", "Processing duration", "seconds", False),
    Metric("pipeline_duration_seconds", "Pipeline duration", "seconds", False),
    Metric("initialization_overhead_seconds", "Initialization overhead", "seconds", False),
    Metric("frames_processed", "Frames processed", "frames", None),
    Metric("frame_detections", "Frame detections", "detections", None),
    Metric("tracked_observations", "Tracked observations", "observations", None),
    Metric("unique_tracks", "Unique tracks", "tracks", None),
)
METRIC_NAMES = tuple(m.name for m in METRICS)


def absolute_change(baseline: Column, candidate: Column) -> Column:
    """Candidate minus baseline, six decimals."""
    return py_round(candidate - baseline, 6)


def percentage_change(baseline: Column, candidate: Column) -> Column:
    """Change relative to the size of the baseline in percent, null for a zero baseline."""
    ratio = F.try_divide(candidate - baseline, F.abs(baseline)) * 100
    return py_round(ratio, 3)


def assessment(baseline: Column, candidate: Column, higher_is_better: Column) -> Column:
    """Say whether the unrounded change is favourable."""
    change = candidate - baseline
    better = F.when(higher_is_better, change > 0).otherwise(change < 0)
    return (
        F.when(change.isNull(), "unavailable")
        .when(change == 0, "unchanged")
        .when(higher_is_better.isNull(), "changed")
        .when(better, "improved")
        .otherwise("regressed")
    )
