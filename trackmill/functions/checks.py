"""Predicates and argument checks."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted run ids and quality levels.
RUN_ID_BODY = "[A-Za-z0-9][A-Za-z0-9._-]{0,127}"
QUALITY_LEVELS = ("stable", "tentative", "weak")


def valid_run_id(run_id: Column) -> Column:
    """True when the whole text is a safe run id (null counts as unsafe)."""
    return F.coalesce(run_id.rlike(rf"\A{RUN_ID_BODY}\z"), F.lit(False))


def require_run_id(run_id: str) -> str:
    """Check a run-id argument before a plan is built."""
    if not isinstance(run_id, str) or not re.fullmatch(RUN_ID_BODY, run_id):
        raise ValueError(
            "run_id must be 1 to 128 letters, digits, '.', '_' or '-', "
            f"starting with a letter or digit: {run_id!r}"
        )
    return run_id


def require_limit(limit: int, maximum: int | None = None) -> int:
    """Check a result limit."""
    if limit < 1 or (maximum is not None and limit > maximum):
        upper = "" if maximum is None else f" and at most {maximum}"
        raise ValueError(f"limit must be at least 1{upper}: {limit}")
    return limit


def require_quality(quality: str | None) -> str | None:
    """Check an optional quality-level argument."""
    if quality is not None and quality not in QUALITY_LEVELS:
        raise ValueError(f"quality must be one of {QUALITY_LEVELS}: {quality!r}")
    return quality


def require_fraction(value: float, name: str) -> float:
    """Check an argument that must lie in [0, 1]; NaN is rejected."""
    if not 0.0 <= value <= 1.0:
        raise ValueError(f"{name} must lie between 0 and 1: {value}")
    return value
