"""Column lists and types of the domain tables (fixed values)."""

from __future__ import annotations

# CSV column orders. The run id is a key of ours, kept beside them.
OBSERVATION_COLUMNS = {
    "frame_number": "bigint",
    "timestamp_seconds": "double",
    "track_id": "bigint",
    "label": "string",
    "confidence": "double",
    "x1": "double",
    "y1": "double",
    "x2": "double",
    "y2": "double",
    "center_x": "double",
    "center_y": "double",
    "width": "double",
    "height": "double",
}

SUMMARY_COLUMNS = {
    "track_id": "bigint",
    "dominant_label": "string",
    "observation_count": "bigint",
    "first_frame": "bigint",
    "last_frame": "bigint",
    "first_seen_seconds": "double",
    "last_seen_seconds": "double",
    "duration_seconds": "double",
    "average_confidence": "double",
    "start_center_x": "double",
    "start_center_y": "double",
    "end_center_x": "double",
    "end_center_y": "double",
    "displacement_pixels": "double",
}

EVALUATED_COLUMNS = {
    "track_id": "bigint",
    "dominant_label": "string",
    "quality_level": "string",
    "quality_reason": "string",
    "observation_count": "bigint",
    "duration_seconds": "double",
    "average_confidence": "double",
    "displacement_pixels": "double",
    "first_frame": "bigint",
    "last_frame": "bigint",
    "first_seen_seconds": "double",
    "last_seen_seconds": "double",
    "start_center_x": "double",
    "start_center_y": "double",
    "end_center_x": "double",
    "end_center_y": "double",
}

# The stored run table without its document text.
RUN_COLUMNS = {
    "run_id": "string",
    "schema_version": "bigint",
    "status": "string",
    "exit_code": "bigint",
    "configuration_path": "string",
    "started_at_utc": "string",
    "finished_at_utc": "string",
    "duration_seconds": "double",
    "input_path": "string",
    "input_sha256": "string",
    "model_path": "string",
    "tracker_config": "string",
    "device": "string",
    "confidence_threshold": "double",
    "image_size": "bigint",
    "processing_metrics_available": "boolean",
    "average_processing_fps": "double",
    "frames_processed": "double",
    "frame_detections": "double",
    "tracked_observations": "double",
    "unique_tracks": "double",
    "processing_duration_seconds": "double",
    "initialization_overhead_seconds": "double",
    "pipeline_duration_seconds": "double",
}

STAGE_FIELDS = {
    "name": "string",
    "status": "string",
    "duration_seconds": "double",
    "exit_code": "bigint",
}

# The processing-metrics document and the run manifest document.
METRICS_DOCUMENT = """
    schema_version bigint, status string, duration_seconds double, error string,
    video struct<width: bigint, height: bigint, source_fps: double>,
    results struct<frames_processed: double, frame_detections: double,
        tracked_observations: double, unique_tracks: double,
        average_processing_fps: double>
"""

MANIFEST_DOCUMENT = f"""
    schema_version bigint, run_id string, status string, exit_code bigint,
    configuration_path string, started_at_utc string, finished_at_utc string,
    duration_seconds double,
    input struct<path: string, exists: boolean, size_bytes: bigint, sha256: string>,
    model struct<model_path: string, tracker_config: string,
        confidence_threshold: double, image_size: bigint, device: string>,
    performance struct<
        pipeline_duration_seconds: double,
        stage_duration_seconds: double,
        initialization_overhead_seconds: double,
        processing_metrics_available: boolean,
        processing_metrics: struct<{METRICS_DOCUMENT}>,
        processing_metrics_error: string,
        quality_counts_available: boolean,
        quality_counts: struct<stable: bigint, tentative: bigint, weak: bigint, total: bigint>,
        quality_counts_error: string,
        database_tracks_available: boolean,
        database_track_count: bigint,
        database_tracks_error: string>,
    stages array<string>
"""


def ddl(columns: dict[str, str]) -> str:
    """Schema text of a column list."""
    return ", ".join(f"{name} {kind}" for name, kind in columns.items())
