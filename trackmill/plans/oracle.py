"""Independent SQL for the registered queries (DuckDB dialect).

Every text is assembled from named common table expressions over the sample
tables. Rounding goes through ``printf``, which rounds the exact binary value.
"""

from __future__ import annotations


def rnd(x: str, digits: int) -> str:
    """Exact half-even rounding of a double."""
    return f"(CAST(printf('%.{digits}f', CAST({x} AS DOUBLE)) AS DOUBLE) + 0e0)"


def exact(x: str, digits: int) -> str:
    """Order-independent sum of values with at most ``digits`` decimals."""
    return f"(CAST(sum(CAST(round({x} * 1e{digits}) AS BIGINT)) AS DOUBLE) / 1e{digits})"


EVENT_OBS = """event_obs AS (
    SELECT 'run-' || strftime(ts, '%Y%m%d') AS run_id, event_id AS frame_number,
        event_id AS seq,
        floor((epoch_us(ts) % 86400000000 + 500) / 1e3) / 1e3 AS timestamp_seconds,
        user_id AS track_id, event_type AS label,
        floor(least(value, 1e2) * 1e2 + 0.5e0) / 1e4 AS confidence,
        CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS DOUBLE) AS center_x,
        value AS center_y
    FROM events)"""

MESSAGES = """messages AS (
    SELECT 'run-' || strftime(ts, '%Y%m%d') AS fusion_id, value,
        (CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS DOUBLE) + 1) / 1e2 AS weight
    FROM events)"""

FRAMES = """frames AS (
    SELECT 'run-' || (o_orderkey // 500 * 500) AS run_id, o_orderkey % 500 + 1 AS frame_number,
        CAST(o_orderkey // 500 % 4 * 10 AS DOUBLE) AS source_fps
    FROM orders)"""

DETECTIONS = """detections AS (
    SELECT 'run-' || (l_orderkey // 500 * 500) AS run_id, l_orderkey % 500 + 1 AS frame_number,
        l_linenumber AS seq,
        (l_orderkey % 500) / (CASE WHEN l_orderkey // 500 % 4 = 0 THEN 30e0
            ELSE CAST(l_orderkey // 500 % 4 * 10 AS DOUBLE) END) AS timestamp_seconds,
        CASE WHEN l_linestatus <> 'F' THEN l_suppkey END AS raw_track_id,
        l_linenumber % 5 AS class_id,
        3e-1 + l_discount * 5e0 AS confidence,
        l_quantity AS x1, l_discount * 1e2 AS y1,
        l_quantity + l_extendedprice / 1e3 AS x2,
        l_discount * 1e2 + l_tax * 1e2 + 1e0 AS y2
    FROM lineitem)"""

RECORDING_OBS = f"""recording_obs AS (
    SELECT run_id, frame_number, seq,
        {rnd("timestamp_seconds", 3)} AS timestamp_seconds,
        raw_track_id AS track_id, r_name AS label, {rnd("confidence", 4)} AS confidence,
        {rnd("x1", 2)} AS x1, {rnd("y1", 2)} AS y1, {rnd("x2", 2)} AS x2, {rnd("y2", 2)} AS y2,
        {rnd("x1 + (x2 - x1) / 2e0", 2)} AS center_x,
        {rnd("y1 + (y2 - y1) / 2e0", 2)} AS center_y,
        {rnd("x2 - x1", 2)} AS width, {rnd("y2 - y1", 2)} AS height
    FROM detections LEFT JOIN region ON r_regionkey = class_id
    WHERE raw_track_id IS NOT NULL)"""


def summary(obs: str) -> str:
    """Track summary of an observation expression, as ``summary``."""
    order = "frame_number {0}, seq {0}, timestamp_seconds {0}, center_x {0}, center_y {0}"
    up, down = order.format("ASC"), order.format("DESC")
    mean = f"{exact('confidence', 4)} / count(*)"
    dx, dy = "(max(xb) - max(xa))", "(max(yb) - max(ya))"
    return f"""numbered AS (
    SELECT *, row_number() OVER (PARTITION BY run_id, track_id ORDER BY {up}) AS from_start,
        row_number() OVER (PARTITION BY run_id, track_id ORDER BY {down}) AS from_end
    FROM {obs}),
marked AS (
    SELECT *,
        CASE WHEN from_start = 1 THEN center_x END AS xa,
        CASE WHEN from_start = 1 THEN center_y END AS ya,
        CASE WHEN from_end = 1 THEN center_x END AS xb,
        CASE WHEN from_end = 1 THEN center_y END AS yb,
        CASE WHEN from_start = 1 THEN timestamp_seconds END AS ta,
        CASE WHEN from_end = 1 THEN timestamp_seconds END AS tb
    FROM numbered),
labels_seen AS (
    SELECT run_id, track_id, label,
        row_number() OVER (PARTITION BY run_id, track_id
            ORDER BY count(*) DESC, min(from_start)) AS place
    FROM numbered GROUP BY run_id, track_id, label),
summary AS (
    SELECT m.run_id, m.track_id, max(l.label) AS dominant_label,
        count(*) AS observation_count,
        min(frame_number) AS first_frame, max(frame_number) AS last_frame,
        {rnd("max(ta)", 3)} AS first_seen_seconds, {rnd("max(tb)", 3)} AS last_seen_seconds,
        {rnd("greatest(0e0, max(tb) - max(ta))", 3)} AS duration_seconds,
        {rnd(mean, 4)} AS average_confidence,
        {rnd("max(xa)", 2)} AS start_center_x, {rnd("max(ya)", 2)} AS start_center_y,
        {rnd("max(xb)", 2)} AS end_center_x, {rnd("max(yb)", 2)} AS end_center_y,
        {rnd(f"sqrt({dx} * {dx} + {dy} * {dy})", 2)} AS displacement_pixels
    FROM marked m JOIN labels_seen l
        ON l.run_id = m.run_id AND l.track_id = m.track_id AND l.place = 1
    GROUP BY m.run_id, m.track_id)"""


def evaluated(
    source: str = "summary",
    name: str = "evaluated",
    n: int = 5,
    seconds: float = 0.2,
    mean: float = 0.5,
) -> str:
    """Graded tracks of a summary expression."""
    return f"""{name} AS (
    SELECT *, CASE
            WHEN quality_level = 'stable'
                THEN 'Persistent track with sufficient average confidence'
            WHEN quality_level = 'tentative'
                THEN 'Track requires more persistence or confidence'
            WHEN observation_count < 3 AND average_confidence < 0.4e0
                THEN 'too few observations; low average confidence'
            WHEN observation_count < 3 THEN 'too few observations'
            WHEN average_confidence < 0.4e0 THEN 'low average confidence'
            ELSE 'insufficient duration' END AS quality_reason
    FROM (SELECT *, CASE
            WHEN observation_count >= {n} AND duration_seconds >= {seconds}
                AND average_confidence >= {mean} THEN 'stable'
            WHEN observation_count >= 3 AND average_confidence >= 0.4e0 THEN 'tentative'
            ELSE 'weak' END AS quality_level FROM {source}))"""


EVENT_TRACKS = ",\n".join([EVENT_OBS, summary("event_obs"), evaluated()])
TRACKS = ",\n".join([DETECTIONS, RECORDING_OBS, summary("recording_obs"), evaluated()])

HEADERS = """headers AS (
    SELECT 'run-' || o_orderkey AS run_id, CAST(3 AS BIGINT) AS schema_version,
        CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running'
            ELSE 'failed' END AS status,
        CAST(CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN NULL ELSE 1 END AS BIGINT)
            AS exit_code,
        o_custkey AS config_id,
        strftime(o_orderdate, '%Y-%m-%d') || 'T00:00:00+00:00' AS started_at_utc,
        CASE WHEN o_orderstatus <> 'O'
            THEN strftime(o_orderdate, '%Y-%m-%d') || 'T12:00:00+00:00' END AS finished_at_utc,
        CASE WHEN o_orderstatus <> 'O' THEN o_totalprice / 1e3 END AS pipeline_seconds,
        o_orderpriority AS model_path
    FROM orders)"""

STAGES = f"""stages AS (
    SELECT 'run-' || l_orderkey AS run_id, (l_linenumber - 1) % 7 AS slot,
        'stage-' || ((l_linenumber - 1) % 7) AS name, 'completed' AS status,
        {rnd(exact("l_extendedprice", 2) + " / 1e3", 3)} AS duration_seconds,
        CAST(0 AS BIGINT) AS exit_code
    FROM lineitem GROUP BY l_orderkey, (l_linenumber - 1) % 7)"""

STAGE_TOTALS = f"""stage_totals AS (
    SELECT run_id, {exact("duration_seconds", 3)} AS stage_seconds, count(*) AS stage_count
    FROM stages GROUP BY run_id)"""

MEASURED = f"""measured AS (
    SELECT 'run-' || l_orderkey AS run_id, {exact("l_extendedprice", 2)} / 1e3 AS seconds,
        CAST({exact("l_quantity", 2)} AS BIGINT) AS frames_processed,
        count(*) AS frame_detections,
        count(*) FILTER (WHERE l_linestatus = 'O') AS tracked_observations,
        count(DISTINCT CASE WHEN l_linestatus = 'O' THEN l_suppkey END) AS unique_tracks
    FROM lineitem GROUP BY l_orderkey)"""

CLOSED = f"""closed AS (
    SELECT h.*,
        {rnd("pipeline_seconds", 3)} AS pipeline_duration_seconds,
        CASE WHEN pipeline_seconds IS NULL THEN 0e0
            ELSE {rnd("coalesce(stage_seconds, 0e0)", 3)} END AS stage_duration_seconds,
        CASE WHEN pipeline_seconds IS NOT NULL THEN
            {rnd("greatest(pipeline_seconds - coalesce(stage_seconds, 0e0), 0e0)", 3)} END
            AS initialization_overhead_seconds,
        status = 'completed' AND m.run_id IS NOT NULL AS processing_metrics_available,
        CASE WHEN status = 'completed' AND m.run_id IS NULL
            THEN 'Processing metrics were not found' END AS processing_metrics_error,
        CASE WHEN status = 'completed' THEN {rnd("seconds", 3)} END
            AS processing_duration_seconds,
        CASE WHEN status = 'completed' AND m.run_id IS NOT NULL THEN
            CASE WHEN seconds > 0 THEN {rnd("frames_processed / seconds", 3)} ELSE 0e0 END END
            AS average_processing_fps,
        CASE WHEN status = 'completed' THEN CAST(frames_processed AS DOUBLE) END
            AS frames_processed,
        CASE WHEN status = 'completed' THEN CAST(frame_detections AS DOUBLE) END
            AS frame_detections,
        CASE WHEN status = 'completed' THEN CAST(tracked_observations AS DOUBLE) END
            AS tracked_observations,
        CASE WHEN status = 'completed' THEN CAST(unique_tracks AS DOUBLE) END AS unique_tracks
    FROM headers h LEFT JOIN stage_totals s ON s.run_id = h.run_id
        LEFT JOIN measured m ON m.run_id = h.run_id)"""

RUNS = ",\n".join([HEADERS, STAGES, STAGE_TOTALS, MEASURED, CLOSED])

# Metric name, label, unit and direction in report order.
METRIC_ROWS = """metric_rows(ord, name, label, unit, higher_is_better) AS (VALUES
    (0, 'average_processing_fps', 'Average processing FPS', 'fps', true),
    (1, 'processing_duration_seconds', 'Processing duration', 'seconds', false),
    (2, 'pipeline_duration_seconds', 'Pipeline duration', 'seconds', false),
    (3, 'initialization_overhead_seconds', 'Initialization overhead', 'seconds', false),
    (4, 'frames_processed', 'Frames processed', 'frames', NULL),
    (5, 'frame_detections', 'Frame detections', 'detections', NULL),
    (6, 'tracked_observations', 'Tracked observations', 'observations', NULL),
    (7, 'unique_tracks', 'Unique tracks', 'tracks', NULL))"""

METRIC_VALUES = """metric_values AS (
    SELECT run_id, name, value FROM (SELECT run_id, average_processing_fps,
        processing_duration_seconds, pipeline_duration_seconds,
        initialization_overhead_seconds, frames_processed, frame_detections,
        tracked_observations, unique_tracks FROM closed)
    UNPIVOT INCLUDE NULLS (value FOR name IN (average_processing_fps,
        processing_duration_seconds, pipeline_duration_seconds,
        initialization_overhead_seconds, frames_processed, frame_detections,
        tracked_observations, unique_tracks)))"""

PAIRS = """ranked AS (
    SELECT run_id, config_id, row_number() OVER (PARTITION BY config_id
        ORDER BY finished_at_utc, run_id) AS age
    FROM closed WHERE status <> 'running'),
pairs AS (
    SELECT b.run_id AS baseline_run_id, c.run_id AS candidate_run_id
    FROM ranked b JOIN ranked c ON b.config_id = c.config_id AND b.age = 1 AND c.age > 1)"""

COMPARED = f"""compared AS (
    SELECT baseline_run_id, candidate_run_id, CAST(ord AS BIGINT) AS ord, d.name, label, unit,
        higher_is_better, b.value AS baseline, c.value AS candidate,
        b.value IS NOT NULL AND c.value IS NOT NULL AS available,
        {rnd("c.value - b.value", 6)} AS absolute_change,
        CASE WHEN b.value <> 0 THEN {rnd("(c.value - b.value) / abs(b.value) * 1e2", 3)} END
            AS percentage_change,
        CASE WHEN b.value IS NULL OR c.value IS NULL THEN 'unavailable'
            WHEN c.value = b.value THEN 'unchanged'
            WHEN higher_is_better IS NULL THEN 'changed'
            WHEN (c.value > b.value) = higher_is_better THEN 'improved'
            ELSE 'regressed' END AS assessment
    FROM pairs
        JOIN metric_values b ON b.run_id = baseline_run_id
        JOIN metric_values c ON c.run_id = candidate_run_id AND c.name = b.name
        JOIN metric_rows d ON d.name = b.name)"""

COMPARISON = ",\n".join([RUNS, METRIC_ROWS, METRIC_VALUES, PAIRS, COMPARED])


def with_parts(*parts: str, select: str) -> str:
    """One statement."""
    return "WITH " + ",\n".join(parts) + "\n" + select
