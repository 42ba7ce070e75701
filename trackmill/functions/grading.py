"""Track quality level and reason."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from trackmill.functions.checks import require_fraction

# The lower bounds of "tentative" and the explanatory texts.
TENTATIVE_OBSERVATIONS = 3
TENTATIVE_CONFIDENCE = 0.40
STABLE_TEXT = "Persistent track with sufficient average confidence"
TENTATIVE_TEXT = "Track requires more persistence or confidence"
FEW_OBSERVATIONS_TEXT = "too few observations"
LOW_CONFIDENCE_TEXT = "low average confidence"
SHORT_TEXT = "insufficient duration"


@dataclass(frozen=True)
class StableThresholds:
    """What a track must reach to be called stable."""

    observations: int = 5
    duration: float = 0.2
    confidence: float = 0.5

    def __post_init__(self) -> None:
        if self.observations < 1:
            raise ValueError("observations must be positive")
        if not self.duration >= 0:
            raise ValueError("duration cannot be negative")
        require_fraction(self.confidence, "confidence")


def _at_least(x: Column, bound: float) -> Column:
    # Spark sorts NaN above every number; a NaN must not pass a lower bound.
    return ~F.isnan(x) & (x >= bound)


def quality_level(
    count: Column,
    duration: Column,
    confidence: Column,
    thresholds: StableThresholds = StableThresholds(),
) -> Column:
    """Grade one summarized track. Expects the rounded summary values."""
    stable = (
        (count >= thresholds.observations)
        & _at_least(duration, thresholds.duration)
        & _at_least(confidence, thresholds.confidence)
    )
    tentative = (count >= TENTATIVE_OBSERVATIONS) & _at_least(confidence, TENTATIVE_CONFIDENCE)
    return F.when(stable, "stable").when(tentative, "tentative").otherwise("weak")


def quality_reason(level: Column, count: Column, confidence: Column) -> Column:
    """Explain a grade."""
    few = F.when(count < TENTATIVE_OBSERVATIONS, FEW_OBSERVATIONS_TEXT)
    low = F.when(confidence < TENTATIVE_CONFIDENCE, LOW_CONFIDENCE_TEXT)
    weak = F.concat_ws("; ", few, low)
    return (
        F.when(level == "stable", STABLE_TEXT)
        .when(level == "tentative", TENTATIVE_TEXT)
        .when(weak == "", SHORT_TEXT)
        .otherwise(weak)
    )
