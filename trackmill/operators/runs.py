"""Run documents, stages and the final record of a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackmill.functions.checks import require_limit
from trackmill.functions.documents import (
    canonical_json,
    parse_manifest,
    parse_stages,
    truthy,
)
from trackmill.functions.numbers import exact_sum, py_round
from trackmill.operators.validation import track_report
from trackmill.schemas import RUN_COLUMNS, STAGE_FIELDS

_TIME_DIGITS = 3

# Columns of the compact run list.
RUN_LIST_COLUMNS = (
    "run_id",
    "schema_version",
    "status",
    "exit_code",
    "started_at_utc",
    "finished_at_utc",
    "duration_seconds",
    "model_path",
    "device",
    "processing_metrics_available",
    "average_processing_fps",
    "frames_processed",
    "unique_tracks",
    "processing_duration_seconds",
    "initialization_overhead_seconds",
    "pipeline_duration_seconds",
)


def parsed(documents: DataFrame, text: str = "manifest_json") -> DataFrame:
    """Add the typed view ``m`` of the document text."""
    return documents.withColumn("m", parse_manifest(F.col(text)))


def flatten(documents: DataFrame, text: str = "manifest_json") -> DataFrame:
    """Documents as run-table rows: 24 scalars and the canonical document.

    The stored availability flag follows truthiness, so ``1`` or ``"yes"`` count.
    """
    m, performance = F.col("m"), F.col("m.performance")
    metrics = performance["processing_metrics"]
    results = metrics["results"]
    given = F.try_variant_get(
        F.col("strict"), "$.performance.processing_metrics_available", "variant"
    )
    flag = F.coalesce(
        F.when(F.col("given").isNotNull(), truthy(F.col("given"))),
        performance["processing_metrics_available"],
        F.lit(False),
    )
    moved = {
        "input_path": m["input"]["path"],
        "input_sha256": m["input"]["sha256"],
        **{
            name: m["model"][name]
            for name in (
                "model_path",
                "tracker_config",
                "device",
                "confidence_threshold",
                "image_size",
            )
        },
        "processing_metrics_available": flag,
        **{
            name: results[name]
            for name in (
                "average_processing_fps",
                "frames_processed",
                "frame_detections",
                "tracked_observations",
                "unique_tracks",
            )
        },
        "processing_duration_seconds": metrics["duration_seconds"],
        "initialization_overhead_seconds": performance["initialization_overhead_seconds"],
        "pipeline_duration_seconds": performance["pipeline_duration_seconds"],
    }
    # Separate steps, so that each document is parsed once and not once per field.
    ready = (
        parsed(documents, text)
        .withColumn("strict", F.try_parse_json(F.col(text)))
        .withColumn("given", given)
    )
    return ready.select(
        *[moved.get(name, m[name]).alias(name) for name in RUN_COLUMNS],
        canonical_json(F.col(text), F.col("strict")).alias("manifest_json"),
    )


def explode_stages(documents: DataFrame, text: str = "manifest_json") -> DataFrame:
    """One row per stage with its 0-based place in the list."""
    stages = parse_stages(F.col("m.stages"))
    return (
        parsed(documents, text)
        .select(F.col("m.run_id").alias("run_id"), F.posexplode(stages).alias("stage_index", "s"))
        .select(
            "run_id",
            F.col("stage_index").cast("bigint").alias("stage_index"),
            *[F.col(f"s.{name}").alias(name) for name in STAGE_FIELDS],
        )
    )


def processing_summary(m: Column) -> dict[str, Column]:
    """Nine measured fields; available only when the flag is exactly true."""
    performance = m["performance"]
    metrics = performance["processing_metrics"]
    results = metrics["results"]
    return {
        "processing_metrics_available": F.coalesce(
            performance["processing_metrics_available"], F.lit(False)
        ),
        "average_processing_fps": results["average_processing_fps"],
        "frames_processed": results["frames_processed"],
        "frame_detections": results["frame_detections"],
        "tracked_observations": results["tracked_observations"],
        "unique_tracks": results["unique_tracks"],
        "processing_duration_seconds": metrics["duration_seconds"],
        "initialization_overhead_seconds": performance["initialization_overhead_seconds"],
        "pipeline_duration_seconds": performance["pipeline_duration_seconds"],
    }


def summarize_documents(documents: DataFrame, text: str = "manifest_json") -> DataFrame:
    """Compact row per run document: header, stage count and measured fields."""
    m = F.col("m")
    header = {
        name: m[name]
        for name in (
            "run_id",
            "schema_version",
            "status",
            "exit_code",
            "started_at_utc",
            "finished_at_utc",
            "duration_seconds",
        )
    }
    header["model_path"] = m["model"]["model_path"]
    header["device"] = m["model"]["device"]
    header["input_path"] = m["input"]["path"]
    stages = m["stages"]
    header["stage_count"] = F.when(stages.isNull(), 0).otherwise(F.size(stages)).cast("bigint")
    fields = header | processing_summary(m)
    return parsed(documents, text).select(*[c.alias(name) for name, c in fields.items()])


def newest_first(runs: DataFrame) -> list[Column]:
    """Sort order of the run list: finish text descending, unfinished runs last."""
    return [F.col("finished_at_utc").desc_nulls_last(), F.col("run_id").desc()]


def run_list(runs: DataFrame, limit: int = 50) -> DataFrame:
    """Newest runs from the run table."""
    require_limit(limit)
    return runs.select(*RUN_LIST_COLUMNS).orderBy(*newest_first(runs)).limit(limit)


def run_count(runs: DataFrame) -> DataFrame:
    """Number of stored runs."""
    return runs.agg(F.count("*").alias("run_count"))


def stage_totals(stages: DataFrame) -> DataFrame:
    """Summed (already rounded) stage durations per run; a missing one counts zero."""
    seconds = F.coalesce("duration_seconds", F.lit(0.0))
    return stages.groupBy("run_id").agg(
        exact_sum(seconds, _TIME_DIGITS).alias("stage_seconds"),
        F.count("*").alias("stage_count"),
    )


def with_overhead(runs: DataFrame, totals: DataFrame) -> DataFrame:
    """Pipeline time not spent in stages, never negative.

    ``runs`` has the unrounded ``pipeline_seconds``, null while a run is running.
    """
    spent = F.coalesce("stage_seconds", F.lit(0.0))
    pipeline = F.col("pipeline_seconds")
    # greatest() skips nulls, but an unfinished run has no overhead yet.
    overhead = F.when(pipeline.isNotNull(), F.greatest(pipeline - spent, F.lit(0.0)))
    joined = runs.join(totals.select("run_id", "stage_seconds"), "run_id", "left")
    stage_seconds = F.when(pipeline.isNull(), 0.0).otherwise(py_round(spent, _TIME_DIGITS))
    return joined.select(
        *runs.columns,
        py_round(pipeline, _TIME_DIGITS).alias("pipeline_duration_seconds"),
        stage_seconds.alias("stage_duration_seconds"),
        py_round(overhead, _TIME_DIGITS).alias("initialization_overhead_seconds"),
    )


def measured_results(measurements: DataFrame) -> DataFrame:
    """Final metrics of each run: speed and rounded time, zeros unless completed.

    ``measurements`` has ``run_id, status, seconds`` (unrounded) and the four counts.
    The speed divides by the time before it is rounded.
    """
    done = F.col("status") == "completed"
    frames, seconds = F.col("frames_processed"), F.col("seconds")
    fps = F.when(seconds > 0, frames / seconds).otherwise(0.0)
    counts = ("frames_processed", "frame_detections", "tracked_observations", "unique_tracks")
    return measurements.select(
        "run_id",
        "status",
        py_round(seconds, _TIME_DIGITS).alias("duration_seconds"),
        *[
            F.when(done, F.col(c).cast("double")).otherwise(0.0).alias(c)
            for c in counts
        ],
        F.when(done, py_round(fps, _TIME_DIGITS)).otherwise(0.0).alias("average_processing_fps"),
    )


_METRICS_MISSING = "Processing metrics were not found"


def with_metrics(runs: DataFrame, stages: DataFrame, metrics: DataFrame) -> DataFrame:
    """Durations, overhead and (completed runs only) the metrics document of every run.

    Each joined side has one row per run after its own aggregation, so no join
    key repeats and the joins share the partitioning on ``run_id``.
    """
    done = F.col("status") == "completed"
    results = metrics.select(
        "run_id",
        F.struct(*[c for c in metrics.columns if c != "run_id"]).alias("found_metrics"),
    )
    joined = with_overhead(runs, stage_totals(stages)).join(results, "run_id", "left")
    found = F.col("found_metrics").isNotNull()
    return joined.select(
        *[c for c in runs.columns if c != "pipeline_seconds"],
        "pipeline_duration_seconds",
        "stage_duration_seconds",
        "initialization_overhead_seconds",
        (done & found).alias("processing_metrics_available"),
        F.when(done, F.col("found_metrics")).alias("processing_metrics"),
        F.when(done & ~found, _METRICS_MISSING).alias("processing_metrics_error"),
    )


def with_track_counts(runs: DataFrame, tracks: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """Quality counts and stored-track count of completed runs.

    A run whose track rows break a rule keeps the reason and a stored count of zero. ``sources``
    (run_id, path, exists) says which runs' track files are there: a completed run without one
    has no counts available, and ``quality_counts_error`` names the file. Without ``sources``
    every completed run counts as having one.
    """
    done = F.col("status") == "completed"
    joined = runs.join(track_report(tracks), "run_id", "left")
    there, error = F.lit(True), []
    if sources is not None:
        files = sources.select("run_id", F.col("path").alias("_path"), F.col("exists").alias("_exists"))
        joined = joined.join(files, "run_id", "left")
        there = F.coalesce("_exists", F.lit(False))
        lost = F.concat(F.lit("Quality file not found: "), F.coalesce("_path", F.lit("no path")))
        error = [F.when(done & ~there, lost).alias("quality_counts_error")]
    counted = done & there
    stored = counted & F.col("problem").isNull()
    return joined.select(
        *runs.columns,
        counted.alias("quality_counts_available"),
        *error,
        *[
            F.when(counted, F.coalesce(F.col(c), F.lit(0))).otherwise(0).alias(c)
            for c in ("stable", "tentative", "weak", "total")
        ],
        stored.alias("database_tracks_available"),
        F.when(stored, F.coalesce("total", F.lit(0))).otherwise(0).alias("database_track_count"),
        F.when(counted, F.col("problem")).alias("database_tracks_error"),
    )


def finalize(
    runs: DataFrame, stages: DataFrame, metrics: DataFrame, tracks: DataFrame, sources: DataFrame | None = None
) -> DataFrame:
    """The closing record of every run."""
    return with_track_counts(with_metrics(runs, stages, metrics), tracks, sources)
