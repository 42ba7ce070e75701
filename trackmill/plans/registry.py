"""Registered queries over the sample tables, each with its SQL check.

Every query reads whole tables. ``QUERIES`` maps a name to ``(spark, sf_dir) ->
DataFrame``, ``SQL`` maps it to the equivalent statement.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackmill.functions.checks import valid_run_id
from trackmill.functions.documents import (
    canonical_json,
    manifest_error,
    stages_error,
    with_json,
)
from trackmill.functions.grading import StableThresholds
from trackmill.functions.numbers import py_round
from trackmill.operators import (
    comparison,
    detections,
    frames,
    fusion,
    ranking,
    runs,
    tracks,
    validation,
)
from trackmill.operators.skew import salted_join
from trackmill.plans import oracle as O
from trackmill.plans.queries import Store
from trackmill.schemas import EVALUATED_COLUMNS
from trackmill.session import new_path
from trackmill.sources import csv_tables, documents, fingerprints, samples, tables
from trackmill.streaming import live

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function name."""

    def add(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql is not None:
            SQL[function.__name__] = sql
        return function

    return add


# ---- detections and frames -------------------------------------------------


@query(
    O.with_parts(
        O.DETECTIONS,
        O.RECORDING_OBS,
        select="SELECT run_id, frame_number, timestamp_seconds, track_id, label, confidence, "
        "x1, y1, x2, y2, center_x, center_y, width, height FROM recording_obs",
    )
)
def detection_geometry(spark, sf_dir):
    return samples.recording_observations(spark, sf_dir).drop("seq")


@query(
    O.with_parts(
        O.FRAMES,
        select=f"""SELECT run_id, frame_number, {O.rnd('''(frame_number - 1) /
        (CASE WHEN source_fps <= 0 THEN 30e0 ELSE source_fps END)''', 3)} AS timestamp_seconds
        FROM frames""",
    )
)
def frame_timestamp(spark, sf_dir):
    seconds = detections.frame_timestamp(F.col("frame_number"), F.col("source_fps"))
    return samples.frames(spark, sf_dir).select(
        "run_id", "frame_number", py_round(seconds, 3).alias("timestamp_seconds")
    )


_ACTIVITY = """activity AS (
    SELECT f.run_id, f.frame_number, count(d.run_id) AS boxes,
        count(raw_track_id) AS observation_rows, count(DISTINCT raw_track_id) AS active_tracks
    FROM frames f LEFT JOIN detections d
        ON d.run_id = f.run_id AND d.frame_number = f.frame_number
    GROUP BY f.run_id, f.frame_number)"""

_RUNNING = """fresh AS (
    SELECT run_id, frame_number, count(*) AS new_tracks FROM (
        SELECT run_id, raw_track_id, min(frame_number) AS frame_number FROM detections
        WHERE raw_track_id IS NOT NULL GROUP BY run_id, raw_track_id)
    GROUP BY run_id, frame_number),
running AS (
    SELECT a.*, coalesce(new_tracks, 0) AS new_tracks,
        count(*) OVER w AS running_frames,
        CAST(sum(boxes) OVER w AS BIGINT) AS running_boxes,
        CAST(sum(observation_rows) OVER w AS BIGINT) AS running_rows,
        CAST(sum(coalesce(new_tracks, 0)) OVER w AS BIGINT) AS running_unique_tracks
    FROM activity a LEFT JOIN fresh n
        ON n.run_id = a.run_id AND n.frame_number = a.frame_number
    WINDOW w AS (PARTITION BY a.run_id ORDER BY a.frame_number
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""

_FRAME_PARTS = (O.FRAMES, O.DETECTIONS, _ACTIVITY)


@query(O.with_parts(*_FRAME_PARTS, select="SELECT * FROM activity"))
def frame_activity(spark, sf_dir):
    return frames.frame_activity(
        samples.frames(spark, sf_dir), samples.detections(spark, sf_dir)
    )


def _running(spark, sf_dir, width=100):
    return frames.running_activity(
        samples.frames(spark, sf_dir), samples.detections(spark, sf_dir), width
    )


@query(
    O.with_parts(
        *_FRAME_PARTS,
        _RUNNING,
        select="SELECT run_id, frame_number, new_tracks, running_unique_tracks FROM running",
    )
)
def running_unique(spark, sf_dir):
    return _running(spark, sf_dir).select(
        "run_id", "frame_number", "new_tracks", "running_unique_tracks"
    )


@query(
    O.with_parts(
        *_FRAME_PARTS,
        _RUNNING,
        select="SELECT run_id, frame_number, running_frames, running_boxes, running_rows "
        "FROM running",
    )
)
def running_totals(spark, sf_dir):
    return _running(spark, sf_dir).select(
        "run_id", "frame_number", "running_frames", "running_boxes", "running_rows"
    )


@query(
    O.with_parts(
        *_FRAME_PARTS,
        _RUNNING,
        select="SELECT run_id, running_frames AS frames, active_tracks, running_unique_tracks "
        "AS unique_tracks, running_rows AS observation_rows FROM running "
        "WHERE running_frames % 25 = 0",
    )
)
def progress_samples(spark, sf_dir):
    return frames.progress_samples(_running(spark, sf_dir))


_SOME_FRAMES = """frames AS (
    SELECT * FROM all_frames WHERE frame_number % 10 <> 3)"""
_SOME_PARTS = (O.FRAMES.replace("frames AS", "all_frames AS"), _SOME_FRAMES, O.DETECTIONS)


def _some_frames(spark, sf_dir):
    """The order recordings with every tenth frame missing, though boxes name it."""
    return samples.frames(spark, sf_dir).where("frame_number % 10 <> 3")


@query(
    O.with_parts(
        *_SOME_PARTS,
        select="""SELECT run_id, frame_number, count(*) AS boxes, count(raw_track_id) AS observation_rows
        FROM detections d WHERE NOT EXISTS (SELECT 1 FROM frames f
            WHERE f.run_id = d.run_id AND f.frame_number = d.frame_number)
        GROUP BY run_id, frame_number""",
    )
)
def boxes_without_frame(spark, sf_dir):
    return frames.boxes_without_frame(_some_frames(spark, sf_dir), samples.detections(spark, sf_dir))


@query(
    O.with_parts(
        *_SOME_PARTS[:2],
        O.DETECTIONS.replace("detections AS", "all_boxes AS"),
        """detections AS (SELECT * FROM all_boxes d WHERE EXISTS (SELECT 1 FROM frames f
            WHERE f.run_id = d.run_id AND f.frame_number = d.frame_number))""",
        _ACTIVITY,
        _RUNNING,
        select="SELECT * FROM running",
    )
)
def running_real_frames(spark, sf_dir):
    """Running totals where boxes name frames that were never recorded."""
    return frames.running_activity(_some_frames(spark, sf_dir), samples.detections(spark, sf_dir), 100)


_RUN_TOTALS = O.with_parts(
    O.FRAMES,
    O.DETECTIONS,
    select="""SELECT f.run_id, frames_processed, coalesce(frame_detections, 0)
        AS frame_detections, coalesce(tracked_observations, 0) AS tracked_observations,
        coalesce(unique_tracks, 0) AS unique_tracks
    FROM (SELECT run_id, count(*) AS frames_processed FROM frames GROUP BY run_id) f
    LEFT JOIN (SELECT run_id, count(*) AS frame_detections,
        count(raw_track_id) AS tracked_observations,
        count(DISTINCT raw_track_id) AS unique_tracks FROM detections GROUP BY run_id) d
    ON d.run_id = f.run_id""",
)


@query(_RUN_TOTALS)
def run_totals(spark, sf_dir):
    return frames.run_totals(samples.frames(spark, sf_dir), samples.detections(spark, sf_dir))


# ---- tracks ----------------------------------------------------------------

_EVALUATED = "run_id, " + ", ".join(EVALUATED_COLUMNS)


@query(
    O.with_parts(O.EVENT_OBS, O.summary("event_obs"), select="SELECT * FROM summary")
)
def track_summary(spark, sf_dir):
    return tracks.summarize(samples.event_observations(spark, sf_dir))


@query(O.with_parts(O.EVENT_TRACKS, select=f"SELECT {_EVALUATED} FROM evaluated"))
def track_quality(spark, sf_dir):
    return tracks.evaluate(tracks.summarize(samples.event_observations(spark, sf_dir)))


@query(O.with_parts(O.TRACKS, select=f"SELECT {_EVALUATED} FROM evaluated"))
def recording_quality(spark, sf_dir):
    return samples.recording_tracks(spark, sf_dir)


@query(O.with_parts(O.EVENT_TRACKS, select=f"SELECT {_EVALUATED} FROM evaluated"))
def nested_positions(spark, sf_dir):
    flat = tracks.evaluate(tracks.summarize(samples.event_observations(spark, sf_dir)))
    return tracks.flatten_positions(tracks.nest_positions(flat))


_COUNTS = """SELECT run_id, count(*) FILTER (WHERE quality_level = 'stable') AS stable,
    count(*) FILTER (WHERE quality_level = 'tentative') AS tentative,
    count(*) FILTER (WHERE quality_level = 'weak') AS weak, count(*) AS total
FROM {0} GROUP BY run_id"""


@query(O.with_parts(O.TRACKS, select=_COUNTS.format("evaluated")))
def quality_counts(spark, sf_dir):
    return tracks.quality_counts(samples.recording_tracks(spark, sf_dir))


@query(
    O.with_parts(
        O.TRACKS,
        select="SELECT run_id, dominant_label, count(*) AS track_count FROM evaluated "
        "GROUP BY run_id, dominant_label",
    )
)
def label_counts(spark, sf_dir):
    return tracks.ordered_label_counts(samples.recording_tracks(spark, sf_dir))


@query(
    O.with_parts(
        O.TRACKS, select="SELECT run_id, count(*) AS track_count FROM evaluated GROUP BY run_id"
    )
)
def run_track_counts(spark, sf_dir):
    return tracks.track_counts(samples.recording_tracks(spark, sf_dir))


@query(
    O.with_parts(
        O.TRACKS,
        select="""SELECT run_id, 'total' AS section, 'tracks' AS name, count(*) AS value
        FROM evaluated GROUP BY run_id
        UNION ALL SELECT run_id, 'label', dominant_label, count(*)
        FROM evaluated GROUP BY run_id, dominant_label
        UNION ALL SELECT run_id, 'quality', level, count(*) FILTER (WHERE quality_level = level)
        FROM evaluated, (VALUES ('stable'), ('tentative'), ('weak')) levels(level)
        GROUP BY run_id, level""",
    )
)
def run_statistics(spark, sf_dir):
    return tracks.statistics(samples.recording_tracks(spark, sf_dir))


@query(
    O.with_parts(
        O.EVENT_TRACKS,
        select=f"""SELECT {_EVALUATED}, place FROM (SELECT *, row_number() OVER (
            PARTITION BY run_id ORDER BY average_confidence DESC, track_id) AS place
        FROM evaluated WHERE quality_level = 'tentative' AND average_confidence >= 0.45e0)
        WHERE place <= 20""",
    )
)
def track_list(spark, sf_dir):
    graded = tracks.evaluate(tracks.summarize(samples.event_observations(spark, sf_dir)))
    return ranking.top_tracks_per_run(ranking.matching(graded, "tentative", 0.45), 20)


@query(
    O.with_parts(
        O.EVENT_TRACKS,
        select="""SELECT run_id, count(*) AS total_matching, least(count(*), 20) AS returned
        FROM evaluated WHERE quality_level = 'tentative' AND average_confidence >= 0.45e0
        GROUP BY run_id""",
    )
)
def track_page(spark, sf_dir):
    graded = tracks.evaluate(tracks.summarize(samples.event_observations(spark, sf_dir)))
    return ranking.page_sizes(ranking.matching(graded, "tentative", 0.45), 20)


@query(
    O.with_parts(
        O.EVENT_TRACKS,
        select=f"""SELECT {_EVALUATED}, (SELECT count(*) FROM evaluated) AS total_matching,
        least((SELECT count(*) FROM evaluated), 100) AS returned
        FROM evaluated ORDER BY average_confidence DESC, track_id, run_id LIMIT 100""",
    )
)
def best_tracks_page(spark, sf_dir):
    """Top-k over all recordings with the size of the match beside it."""
    graded = tracks.evaluate(tracks.summarize(samples.event_observations(spark, sf_dir)))
    matches = ranking.matching(graded)
    page = matches.orderBy(*ranking.best_first(), "run_id").limit(100)
    return ranking.with_envelope(page, matches, 100)


@query(
    O.with_parts(
        O.EVENT_TRACKS,
        select=f"SELECT {_EVALUATED} FROM evaluated "
        "WHERE run_id = 'run-20240115' AND track_id = 42",
    )
)
def track_point(spark, sf_dir):
    graded = tracks.evaluate(tracks.summarize(samples.event_observations(spark, sf_dir)))
    return graded.where((F.col("run_id") == "run-20240115") & (F.col("track_id") == 42))


_LATEST = """latest AS (
    SELECT run_id FROM headers WHERE run_id IN (SELECT run_id FROM evaluated)
    ORDER BY finished_at_utc DESC NULLS LAST, run_id DESC LIMIT 1)"""


@query(O.with_parts(O.TRACKS, O.HEADERS, _LATEST, select="SELECT run_id FROM latest"))
def latest_track_run(spark, sf_dir):
    return ranking.newest_run_with_tracks(
        samples.run_headers(spark, sf_dir), samples.recording_tracks(spark, sf_dir)
    )


@query(
    O.with_parts(
        O.TRACKS,
        O.HEADERS,
        _LATEST,
        select=f"""SELECT {_EVALUATED} FROM evaluated
        WHERE run_id = (SELECT run_id FROM latest) AND quality_level = 'stable'
        ORDER BY average_confidence DESC, track_id LIMIT 50""",
    )
)
def current_tracks(spark, sf_dir):
    """Best stable tracks of the newest run that has any."""
    graded = samples.recording_tracks(spark, sf_dir)
    newest = ranking.newest_run_with_tracks(samples.run_headers(spark, sf_dir), graded)
    current = graded.where(F.col("run_id") == newest.scalar())
    return ranking.top_tracks(ranking.matching(current, "stable"), 50)


# ---- runs ------------------------------------------------------------------


@query("SELECT count(*) AS run_count FROM orders")
def run_count(spark, sf_dir):
    return runs.run_count(samples.run_headers(spark, sf_dir))


_OVERHEAD = """SELECT run_id, pipeline_duration_seconds, stage_duration_seconds,
    initialization_overhead_seconds FROM closed"""


@query(O.with_parts(O.RUNS, select=_OVERHEAD))
def stage_totals(spark, sf_dir):
    totals = runs.stage_totals(samples.stages(spark, sf_dir))
    headers = samples.run_headers(spark, sf_dir).select("run_id", "pipeline_seconds")
    return runs.with_overhead(headers, totals).drop("pipeline_seconds")


@query(
    O.with_parts(
        O.STAGES,
        select="""SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY slot) - 1
        AS stage_index, name, status, duration_seconds, exit_code FROM stages""",
    )
)
def stage_index(spark, sf_dir):
    return runs.explode_stages(samples.manifests(spark, sf_dir).select("manifest_json"))


@query(
    O.with_parts(
        O.HEADERS,
        O.MEASURED,
        select=f"""SELECT m.run_id, status, {O.rnd("seconds", 3)} AS duration_seconds,
        CASE WHEN status = 'completed' THEN CAST(frames_processed AS DOUBLE) ELSE 0e0 END
            AS frames_processed,
        CASE WHEN status = 'completed' THEN CAST(frame_detections AS DOUBLE) ELSE 0e0 END
            AS frame_detections,
        CASE WHEN status = 'completed' THEN CAST(tracked_observations AS DOUBLE) ELSE 0e0 END
            AS tracked_observations,
        CASE WHEN status = 'completed' THEN CAST(unique_tracks AS DOUBLE) ELSE 0e0 END
            AS unique_tracks,
        CASE WHEN status = 'completed' AND seconds > 0
            THEN {O.rnd("frames_processed / seconds", 3)} ELSE 0e0 END AS average_processing_fps
        FROM measured m JOIN headers h ON h.run_id = m.run_id""",
    )
)
def average_fps(spark, sf_dir):
    return runs.measured_results(samples.run_measurements(spark, sf_dir))


_RUN_LIST = """run_id, schema_version, status, exit_code, started_at_utc, finished_at_utc,
    pipeline_duration_seconds AS duration_seconds, model_path, 'cpu' AS device,
    processing_metrics_available, average_processing_fps, frames_processed, unique_tracks,
    processing_duration_seconds, initialization_overhead_seconds, pipeline_duration_seconds"""


@query(
    O.with_parts(
        O.RUNS,
        select=f"SELECT {_RUN_LIST} FROM closed "
        "ORDER BY finished_at_utc DESC NULLS LAST, run_id DESC LIMIT 50",
    )
)
def run_list(spark, sf_dir):
    return runs.run_list(samples.measured_runs(spark, sf_dir), 50)


@query(
    O.with_parts(
        O.RUNS,
        select=f"""SELECT {_RUN_LIST}, 'videos/' || config_id AS input_path,
        coalesce(stage_count, 0) AS stage_count, frame_detections, tracked_observations
        FROM closed LEFT JOIN stage_totals USING (run_id)""",
    )
)
def run_summary(spark, sf_dir):
    return runs.summarize_documents(samples.manifests(spark, sf_dir))


@query(
    O.with_parts(
        O.RUNS,
        select=f"""SELECT {_RUN_LIST}, 'config-' || config_id AS configuration_path,
        'videos/' || config_id AS input_path, sha256(run_id) AS input_sha256,
        'tracker.yaml' AS tracker_config, 35e-2 AS confidence_threshold,
        CAST(640 AS BIGINT) AS image_size, frame_detections, tracked_observations
        FROM closed""",
    )
)
def manifest_flatten(spark, sf_dir):
    return runs.flatten(samples.manifests(spark, sf_dir)).drop("manifest_json")


@query(
    O.with_parts(
        O.RUNS,
        select=f"SELECT {_RUN_LIST} FROM closed WHERE run_id = 'run-77'",
    )
)
def run_point(spark, sf_dir):
    found = samples.measured_runs(spark, sf_dir).where(F.col("run_id") == "run-77")
    return found.select(*runs.RUN_LIST_COLUMNS)


@query(
    O.with_parts(
        O.TRACKS,
        O.RUNS,
        f"counts AS ({_COUNTS.format('evaluated')})",
        """counted AS (SELECT c.run_id, status = 'completed' AND config_id % 3 <> 0 AS available,
            CASE WHEN status = 'completed' AND config_id % 3 = 0 THEN 'Quality file not found: tracks/' || config_id || '.csv' END
                AS quality_counts_error, coalesce(total, 0) AS n
            FROM closed c LEFT JOIN counts q ON q.run_id = c.run_id)""",
        select="""SELECT run_id, available AS quality_counts_available, quality_counts_error,
        CASE WHEN available THEN n ELSE 0 END AS total, available AS database_tracks_available,
        CASE WHEN available THEN n ELSE 0 END AS database_track_count FROM counted""",
    )
)
def run_final_sources(spark, sf_dir):
    """Closing records where the track files of every third configuration are missing."""
    closed = samples.closed_runs(spark, sf_dir)
    path = F.concat(F.lit("tracks/"), F.col("config_id").cast("string"), F.lit(".csv"))
    sources = closed.select("run_id", path.alias("path"), (F.col("config_id") % 3 != 0).alias("exists"))
    final = runs.with_track_counts(closed, samples.recording_tracks(spark, sf_dir), sources)
    return final.select(
        "run_id", "quality_counts_available", "quality_counts_error", "total", "database_tracks_available", "database_track_count"
    )


@query(
    "SELECT CAST(doc_id AS VARCHAR) AS doc_id, coalesce(text, '') AS text, coalesce(source, '') AS source FROM documents"
)
def csv_line_breaks(spark, sf_dir):
    """Texts with line breaks through CSV files that are read in splits."""
    folder = new_path(spark, "breaks")
    columns = {"doc_id": "string", "text": "string", "source": "string"}
    rows = samples.table(spark, sf_dir, "documents").select(*columns)
    rows.write.csv(folder, header=True, quote='"', escape='"', quoteAll=True, emptyValue="")
    cells = csv_tables.scan_text(spark, folder, columns, "split")
    return csv_tables.all_good(csv_tables.typed(cells, columns)).drop("seq")


@query(
    O.with_parts(
        O.TRACKS,
        O.RUNS,
        f"counts AS ({_COUNTS.format('evaluated')})",
        select="""SELECT c.run_id, status, pipeline_duration_seconds, stage_duration_seconds,
        initialization_overhead_seconds, processing_metrics_available, processing_metrics_error,
        processing_duration_seconds, average_processing_fps, frames_processed,
        status = 'completed' AS quality_counts_available,
        CASE WHEN status = 'completed' THEN coalesce(stable, 0) ELSE 0 END AS stable,
        CASE WHEN status = 'completed' THEN coalesce(tentative, 0) ELSE 0 END AS tentative,
        CASE WHEN status = 'completed' THEN coalesce(weak, 0) ELSE 0 END AS weak,
        CASE WHEN status = 'completed' THEN coalesce(total, 0) ELSE 0 END AS total,
        status = 'completed' AS database_tracks_available,
        CASE WHEN status = 'completed' THEN coalesce(total, 0) ELSE 0 END
            AS database_track_count
        FROM closed c LEFT JOIN counts q ON q.run_id = c.run_id""",
    )
)
def run_final(spark, sf_dir):
    final = samples.final_runs(spark, sf_dir)
    metrics = F.col("processing_metrics")
    return final.select(
        "run_id",
        "status",
        "pipeline_duration_seconds",
        "stage_duration_seconds",
        "initialization_overhead_seconds",
        "processing_metrics_available",
        "processing_metrics_error",
        metrics["duration_seconds"].alias("processing_duration_seconds"),
        metrics["average_processing_fps"].alias("average_processing_fps"),
        metrics["frames_processed"].alias("frames_processed"),
        "quality_counts_available",
        "stable",
        "tentative",
        "weak",
        "total",
        "database_tracks_available",
        "database_track_count",
    )


def _damaged(spark, sf_dir):
    """Documents, each kind of run damaged in its own way."""
    status = F.from_json("manifest_json", "status string")["status"]
    text = F.col("manifest_json")
    number = F.substring_index("run_id", "-", -1).cast("bigint")
    damaged = (
        F.when(status == "failed", F.concat(F.lit("["), text, F.lit("]")))
        .when(status == "running", F.concat(text, F.lit("}")))
        .when(number % 4 == 0, F.replace(text, F.lit('"run_id":"run-'), F.lit('"run_id":"$run-')))
        .when(number % 4 == 1, F.replace(text, F.lit('"run_id":"run-'), F.lit('"run_id":"ran-')))
        .when(number % 4 == 2, F.replace(text, F.lit('"run_id":'), F.lit('"ran_id":')))
        .otherwise(text)
    )
    return samples.manifests(spark, sf_dir).select("run_id", damaged.alias("manifest_json"))


@query(
    O.with_parts(
        O.HEADERS,
        select="""SELECT run_id, CASE
            WHEN status = 'failed' THEN 'Manifest root value must be an object'
            WHEN status = 'running' THEN 'Invalid JSON'
            WHEN CAST(split_part(run_id, '-', 2) AS BIGINT) % 4 = 0 THEN 'Run ID is not safe'
            WHEN CAST(split_part(run_id, '-', 2) AS BIGINT) % 4 = 1
                THEN 'Manifest run_id does not match its filename'
            WHEN CAST(split_part(run_id, '-', 2) AS BIGINT) % 4 = 2
                THEN 'Manifest must contain a string run_id' END AS error
        FROM headers""",
    )
)
def manifest_checks(spark, sf_dir):
    error = manifest_error(F.col("json"), F.col("manifest_json"), F.col("run_id"))
    return with_json(_damaged(spark, sf_dir), "manifest_json").select(
        "run_id", error.alias("error")
    )


@query(
    O.with_parts(
        O.HEADERS,
        select="""SELECT run_id, CASE WHEN status <> 'completed'
            THEN 'Pipeline manifest stages must be a list' END AS error FROM headers""",
    )
)
def stage_list_checks(spark, sf_dir):
    status = F.from_json("manifest_json", "status string")["status"]
    text = F.col("manifest_json")
    damaged = F.when(
        status != "completed", F.replace(text, F.lit('"stages":['), F.lit('"stages":null,"old":['))
    ).otherwise(text)
    texts = samples.manifests(spark, sf_dir).select("run_id", damaged.alias("text"))
    return with_json(texts, "text").select("run_id", stages_error(F.col("json")).alias("error"))


@query(
    """SELECT 'run-' || o_orderkey AS run_id, '{"a":' || o_custkey || ',"b":{"c":"' ||
    o_orderstatus || '","d":[' || o_orderkey || ',null]}}' AS canonical FROM orders"""
)
def canonical_documents(spark, sf_dir):
    """Unsorted, widely spaced documents in canonical form."""
    template = '{ "b" : {"d": [%d, null],  "c": "%s"},\n "a" : %d }'
    text = F.format_string(template, "o_orderkey", "o_orderstatus", "o_custkey")
    return samples.table(spark, sf_dir, "orders").select(
        F.concat(F.lit("run-"), F.col("o_orderkey").cast("string")).alias("run_id"),
        canonical_json(text).alias("canonical"),
    )


# ---- comparison ------------------------------------------------------------


def _pairs(spark, sf_dir):
    """Every ended run against the oldest ended run of its configuration."""
    ended = samples.run_headers(spark, sf_dir).where(F.col("status") != "running")
    age = F.struct("finished_at_utc", "run_id")
    first = ended.groupBy("config_id").agg(F.min_by("run_id", age).alias("baseline_run_id"))
    candidates = ended.select("config_id", F.col("run_id").alias("candidate_run_id"))
    pairs = salted_join(candidates, first, "config_id", "candidate_run_id")
    return pairs.where(F.col("baseline_run_id") != F.col("candidate_run_id")).select(
        "baseline_run_id", "candidate_run_id"
    )


@query(O.with_parts(O.COMPARISON, select="SELECT * FROM compared"))
def metric_compare(spark, sf_dir):
    return comparison.compare(_pairs(spark, sf_dir), samples.measured_runs(spark, sf_dir))


@query(
    O.with_parts(
        O.COMPARISON,
        select="""SELECT baseline_run_id, candidate_run_id,
        count(*) FILTER (WHERE available) AS available_metric_count,
        count(*) AS total_metric_count,
        count(*) FILTER (WHERE assessment = 'improved') AS improved_metric_count,
        count(*) FILTER (WHERE assessment = 'regressed') AS regressed_metric_count,
        count(*) FILTER (WHERE assessment = 'unchanged') AS unchanged_metric_count
        FROM compared GROUP BY baseline_run_id, candidate_run_id""",
    )
)
def compare_scorecard(spark, sf_dir):
    return comparison.scorecard(_pairs(spark, sf_dir), samples.measured_runs(spark, sf_dir))


_NEWEST = """newest AS (
    SELECT run_id, {0} AS config_id, row_number() OVER (PARTITION BY {0}
        ORDER BY finished_at_utc DESC NULLS LAST, run_id DESC) AS place
    FROM closed WHERE processing_metrics_available)"""


@query(
    O.with_parts(
        O.RUNS,
        _NEWEST.format("config_id"),
        select="""SELECT c.config_id, b.run_id AS baseline_run_id, c.run_id AS candidate_run_id
        FROM newest c JOIN newest b ON b.config_id = c.config_id
        WHERE c.place = 1 AND b.place = 2""",
    )
)
def default_pair(spark, sf_dir):
    return comparison.default_pair(samples.measured_runs(spark, sf_dir), "config_id")


@query(
    O.with_parts(
        O.RUNS,
        _NEWEST.format("1"),
        select="""SELECT b.run_id AS baseline_run_id, c.run_id AS candidate_run_id
        FROM newest c JOIN newest b ON c.place = 1 AND b.place = 2""",
    )
)
def newest_pair(spark, sf_dir):
    return comparison.default_pair(samples.measured_runs(spark, sf_dir))


@query(
    O.with_parts(
        O.RUNS,
        select="SELECT run_id, finished_at_utc FROM closed WHERE processing_metrics_available",
    )
)
def comparable_runs(spark, sf_dir):
    comparable = comparison.comparable(samples.measured_runs(spark, sf_dir))
    return comparable.select("run_id", "finished_at_utc")


# ---- fusion ----------------------------------------------------------------

_FUSION = O.with_parts(
    O.MESSAGES,
    select=f"""SELECT fusion_id, {O.rnd("sum(value * weight) / sum(weight)", 6)} AS fused_value,
    {O.rnd("sum(weight)", 6)} AS confidence, count(*) AS sensor_count
    FROM messages GROUP BY fusion_id""",
)


def _six_decimals(estimates):
    # Double sums differ in the last bits with the order of the rows.
    return estimates.select(
        "fusion_id",
        py_round(F.col("fused_value"), 6).alias("fused_value"),
        py_round(F.col("confidence"), 6).alias("confidence"),
        "sensor_count",
    )


@query(_FUSION)
def fusion_estimates(spark, sf_dir):
    return _six_decimals(fusion.fuse(samples.sensor_messages(spark, sf_dir)))


# ---- validation and fingerprints -------------------------------------------


@query(
    O.with_parts(
        O.TRACKS,
        O.HEADERS,
        select="""SELECT run_id, track_id, quality_level FROM evaluated
        WHERE run_id NOT IN (SELECT run_id FROM headers WHERE status = 'completed')""",
    )
)
def orphan_tracks(spark, sf_dir):
    """Tracks whose run did not complete."""
    known = samples.run_headers(spark, sf_dir).where(F.col("status") == "completed")
    found = validation.orphans(samples.recording_tracks(spark, sf_dir), known)
    return found.select("run_id", "track_id", "quality_level")


@query(
    """SELECT 'run-' || l_orderkey AS run_id, CAST(l_linenumber AS BIGINT) AS track_id,
    count(*) AS copies FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1"""
)
def duplicate_keys(spark, sf_dir):
    keys = samples.table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("run-"), F.col("l_orderkey").cast("string")).alias("run_id"),
        F.col("l_linenumber").cast("bigint").alias("track_id"),
    )
    return validation.duplicate_keys(keys)


@query(
    """WITH rows AS (
    SELECT 'run-' || l_orderkey AS run_id, l_suppkey - 3 AS track_id,
        l_quantity - 5 AS observation_count, l_discount * 20 AS average_confidence, l_returnflag
    FROM lineitem),
violations AS (
    SELECT run_id, 'quality must be stable, tentative, or weak' AS violation FROM rows
    WHERE l_returnflag = 'R'
    UNION ALL SELECT run_id, 'a required field is missing' FROM rows WHERE l_returnflag = 'N'
    UNION ALL SELECT run_id, 'track_id cannot be negative' FROM rows WHERE track_id < 0
    UNION ALL SELECT run_id, 'observation_count cannot be negative' FROM rows
    WHERE observation_count < 0
    UNION ALL SELECT run_id, 'average_confidence must be between 0 and 1' FROM rows
    WHERE average_confidence > 1)
SELECT run_id, violation, count(*) AS track_count FROM violations GROUP BY run_id, violation"""
)
def track_violations(spark, sf_dir):
    flag = F.col("l_returnflag")
    level = F.when(flag == "R", "unknown").when(flag == "N", "weak").otherwise("stable")
    zero = ("duration_seconds", "displacement_pixels", "first_seen_seconds", "last_seen_seconds")
    centre = ("start_center_x", "start_center_y", "end_center_x", "end_center_y")
    rows = samples.table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("run-"), F.col("l_orderkey").cast("string")).alias("run_id"),
        (F.col("l_suppkey") - 3).alias("track_id"),
        F.when(flag != "N", F.lit("label")).alias("dominant_label"),
        level.alias("quality_level"),
        F.lit("reason").alias("quality_reason"),
        (F.col("l_quantity") - 5).cast("bigint").alias("observation_count"),
        (F.col("l_discount") * 20).alias("average_confidence"),
        *[F.lit(0.0).alias(c) for c in (*zero, *centre)],
        *[F.lit(1).cast("bigint").alias(c) for c in ("first_frame", "last_frame")],
    )
    return validation.violation_counts(rows)


_RUN_ID = "'[A-Za-z0-9][A-Za-z0-9._-]{0,127}'"


@query(
    f"""SELECT doc_id, regexp_full_match(text, {_RUN_ID}) AS text_valid,
    regexp_full_match(lang || '.' || source, {_RUN_ID}) AS source_valid,
    regexp_full_match(lang || chr(10), {_RUN_ID}) AS broken_line_valid FROM documents"""
)
def run_id_valid(spark, sf_dir):
    return samples.table(spark, sf_dir, "documents").select(
        "doc_id",
        valid_run_id(F.col("text")).alias("text_valid"),
        valid_run_id(F.concat_ws(".", "lang", "source")).alias("source_valid"),
        valid_run_id(F.concat("lang", F.lit("\n"))).alias("broken_line_valid"),
    )


@query(
    """SELECT doc_id, CAST(strlen(text) AS BIGINT) AS size_bytes, sha256(text) AS sha256
    FROM documents"""
)
def fingerprint(spark, sf_dir):
    return samples.table(spark, sf_dir, "documents").select(
        "doc_id", *documents.content_fingerprint(F.col("text"))
    )


_INPUT_FILES = """WITH files AS (
    SELECT CAST(doc_id // 100 AS BIGINT) AS input_id, doc_id // 100 % 7 <> 6 AS present,
        string_agg(coalesce(text, '') || chr(10), '' ORDER BY doc_id, text) AS content
    FROM documents GROUP BY doc_id // 100)"""


def _input_files(spark, sf_dir):
    """Text files of a hundred documents each, every seventh left out: their numbers and the folder."""
    folder = new_path(spark, "inputs")
    rows = samples.table(spark, sf_dir, "documents").select(
        F.expr("doc_id div 100").alias("input_id"), "doc_id", F.coalesce("text", F.lit("")).alias("text")
    )
    present = rows.where("input_id % 7 <> 6").repartition("input_id")
    ordered = present.sortWithinPartitions("input_id", "doc_id", "text")
    ordered.select("input_id", "text").write.partitionBy("input_id").text(folder)
    return rows.select("input_id").distinct(), folder


@query(
    f"""{_INPUT_FILES} SELECT input_id, present AS exists,
    CASE WHEN present THEN CAST(strlen(content) AS BIGINT) END AS size_bytes,
    CASE WHEN present THEN sha256(content) END AS sha256 FROM files"""
)
def input_fingerprints(spark, sf_dir):
    """Files that a table names, read in blocks; some are absent."""
    wanted, folder = _input_files(spark, sf_dir)
    files = spark.read.format("binaryFile").load(folder, pathGlobFilter="*.txt")
    listed = files.select(F.col("input_id").cast("bigint").alias("input_id"), "path")
    absent = F.concat(F.lit(f"{folder}/input_id="), F.col("input_id").cast("string"), F.lit("/absent.txt"))
    named = wanted.join(listed, "input_id", "left").select("input_id", F.coalesce("path", absent).alias("path"))
    return fingerprints.fingerprint_paths(named).drop("path")


@query(
    f"""{_INPUT_FILES} SELECT input_id, CAST(strlen(content) AS BIGINT) AS size_bytes,
    sha256(content) AS sha256 FROM files WHERE present"""
)
def folder_fingerprints(spark, sf_dir):
    """Every file of a folder, by the data source."""
    _, folder = _input_files(spark, sf_dir)
    found = fingerprints.fingerprint_folder(spark, folder, "*.txt", recursive=True)
    number = F.regexp_extract("path", r"/input_id=(\d+)/", 1).cast("bigint")
    return found.select(number.alias("input_id"), "size_bytes", "sha256")


# ---- table maintenance -----------------------------------------------------


@query(
    O.with_parts(
        O.HEADERS, select="SELECT run_id, status, exit_code, finished_at_utc FROM headers"
    )
)
def upsert_latest(spark, sf_dir):
    """All runs were stored as running; ended ones arrive twice, the last version wins."""
    columns = ["run_id", "status", "exit_code", "finished_at_utc"]
    final = samples.run_headers(spark, sf_dir).select(*columns)
    started = final.select(
        "run_id",
        F.lit("running").alias("status"),
        F.lit(None).cast("bigint").alias("exit_code"),
        F.lit(None).cast("string").alias("finished_at_utc"),
    )
    ended = final.where(F.col("status") != "running")
    first = ended.withColumns({"status": F.lit("interrupted"), "version": F.lit(1)})
    batch = first.unionByName(ended.withColumn("version", F.lit(2)))
    return tables.upserted(started, tables.latest_per_run(batch, "version"))


_STRICT = StableThresholds(observations=20, duration=1.0, confidence=0.55)


@query(
    O.with_parts(
        O.TRACKS,
        O.evaluated("summary", "regraded", 20, 1.0, 0.55),
        O.HEADERS,
        select="""SELECT run_id, track_id, quality_level FROM regraded
        WHERE run_id IN (SELECT run_id FROM headers WHERE status = 'completed')
        UNION ALL SELECT run_id, track_id, quality_level FROM evaluated
        WHERE run_id IN (SELECT run_id FROM headers WHERE status = 'running')""",
    )
)
def replace_tracks(spark, sf_dir):
    """Ended runs are replaced: completed ones regraded, failed ones emptied."""
    summaries = tracks.summarize(samples.recording_observations(spark, sf_dir))
    columns = ["run_id", "track_id", "quality_level"]
    headers = samples.run_headers(spark, sf_dir).select("run_id", "status")
    ended = headers.where(F.col("status") != "running").select("run_id")
    completed = headers.where(F.col("status") == "completed").select("run_id")
    regraded = tracks.evaluate(summaries, _STRICT).join(completed, "run_id", "left_semi")
    return tables.replaced(
        tracks.evaluate(summaries).select(*columns), ended, regraded.select(*columns)
    )


@query(
    O.with_parts(
        O.TRACKS,
        O.HEADERS,
        O.STAGES,
        select="""SELECT run_id, 'stages' AS child, count(*) AS kept FROM stages
        WHERE run_id NOT IN (SELECT run_id FROM headers WHERE status = 'failed')
        GROUP BY run_id
        UNION ALL SELECT run_id, 'tracks', count(*) FROM evaluated
        WHERE run_id NOT IN (SELECT run_id FROM headers WHERE status = 'failed')
        GROUP BY run_id""",
    )
)
def cascade_delete(spark, sf_dir):
    """Stages and tracks left after failed runs are deleted."""
    removed = samples.run_headers(spark, sf_dir).where(F.col("status") == "failed")
    kept = [
        tables.without_runs(rows.select("run_id"), removed).withColumn("child", F.lit(name))
        for name, rows in (
            ("stages", samples.stages(spark, sf_dir)),
            ("tracks", samples.recording_tracks(spark, sf_dir)),
        )
    ]
    return kept[0].unionByName(kept[1]).groupBy("run_id", "child").agg(
        F.count("*").alias("kept")
    )


@query(O.with_parts(O.TRACKS, select=f"SELECT {_EVALUATED} FROM evaluated"))
def csv_round_trip(spark, sf_dir):
    """Observations, summaries and grades through their CSV forms, stage by stage."""
    folder = new_path(spark, "csv")
    csv_tables.write_observations(
        samples.recording_observations(spark, sf_dir), f"{folder}/observations"
    )
    observed = csv_tables.read_observations(spark, f"{folder}/observations", multiline=False)
    csv_tables.write_summaries(tracks.summarize(observed), f"{folder}/summaries")
    summaries = csv_tables.read_summaries(spark, f"{folder}/summaries", multiline=False)
    csv_tables.write_evaluated(tracks.evaluate(summaries), f"{folder}/evaluated")
    return csv_tables.read_evaluated(spark, f"{folder}/evaluated", multiline=False).select(
        "run_id", *EVALUATED_COLUMNS
    )


@query(
    O.with_parts(
        O.TRACKS,
        O.RUNS,
        f"counts AS ({_COUNTS.format('evaluated')})",
        select="""SELECT c.run_id, c.status, coalesce(stage_count, 0) AS stored_stages,
        coalesce(total, 0) AS imported, coalesce(total, 0) AS database_track_count,
        coalesce(stable, 0) AS stable, coalesce(tentative, 0) AS tentative,
        coalesce(weak, 0) AS weak
        FROM closed c LEFT JOIN stage_totals s ON s.run_id = c.run_id
        LEFT JOIN counts q ON q.run_id = c.run_id WHERE c.status = 'completed'""",
    )
)
def table_round_trip(spark, sf_dir):
    """Runs, stages and tracks of completed runs through the archive and the Parquet tables."""
    root = new_path(spark, "tables")
    completed = (
        samples.run_headers(spark, sf_dir).where(F.col("status") == "completed").select("run_id")
    )
    documents.write_manifests(
        samples.manifests(spark, sf_dir).join(completed, "run_id", "left_semi"),
        f"{root}/archive",
    )
    stored = documents.read_archive(spark, f"{root}/archive")
    graded = samples.recording_tracks(spark, sf_dir).join(completed, "run_id", "left_semi")
    tables.save_manifests(spark, root, stored)
    report = tables.import_evaluated_tracks(spark, root, completed, graded)
    stage_rows = tables.read_stages(spark, root).groupBy("run_id").agg(
        F.count("*").alias("stored_stages")
    )
    return (
        tables.read_runs(spark, root)
        .select("run_id", "status")
        .join(stage_rows, "run_id", "left")
        .join(report, "run_id", "left")
        .withColumn("stored_stages", F.coalesce("stored_stages", F.lit(0)))
    )


@query(
    O.with_parts(
        O.HEADERS,
        O.MEASURED,
        select=f"""SELECT h.run_id, m.run_id IS NOT NULL AND status <> 'failed'
            AS processing_metrics_available,
        CASE WHEN m.run_id IS NULL THEN 'Metrics file not found'
            WHEN status = 'failed' THEN 'Metrics root value must be an object.' END
            AS processing_metrics_error,
        CASE WHEN status <> 'failed' THEN {O.rnd("seconds", 3)} END AS duration_seconds,
        CASE WHEN status <> 'failed' THEN CAST(unique_tracks AS DOUBLE) END AS unique_tracks
        FROM headers h LEFT JOIN measured m ON m.run_id = h.run_id""",
    )
)
def metrics_attach(spark, sf_dir):
    """Metrics documents as text; those of failed runs are not objects."""
    names = ("frames_processed", "frame_detections", "tracked_observations", "unique_tracks")
    text = F.to_json(
        F.struct("duration_seconds", F.struct(*names, "average_processing_fps").alias("results"))
    )
    measured = runs.measured_results(
        samples.run_measurements(spark, sf_dir).withColumnRenamed("status", "final")
        .withColumn("status", F.lit("completed")).drop("final")
    )
    headers = samples.run_headers(spark, sf_dir).select("run_id", "status")
    texts = measured.drop("status").join(headers, "run_id").select(
        "run_id",
        F.when(F.col("status") == "failed", F.concat(F.lit("["), text, F.lit("]")))
        .otherwise(text)
        .alias("metrics_json"),
    )
    attached = documents.metrics_availability(headers, texts)
    metrics = F.col("processing_metrics")
    return attached.select(
        "run_id",
        "processing_metrics_available",
        "processing_metrics_error",
        metrics["duration_seconds"].alias("duration_seconds"),
        metrics["results"]["unique_tracks"].alias("unique_tracks"),
    )


# ---- the user queries ------------------------------------------------------

_RECORDINGS = f"""totals AS ({_RUN_TOTALS}),
numbered_runs AS (SELECT *, CAST(substr(run_id, 5) AS BIGINT) // 500 AS number FROM totals),
recordings AS (
    SELECT run_id, number, CASE WHEN number % 7 = 3 THEN 'running' ELSE 'completed' END AS status,
        CAST(DATE '2000-01-01' + CAST(number AS INTEGER) AS VARCHAR) AS day,
        CASE WHEN number % 7 <> 3 THEN day || 'T12:00:00+00:00' END AS finished_at_utc,
        CASE WHEN number % 5 = 0 THEN unique_tracks + 0.5e0 END AS average_processing_fps,
        number + 0.25e0 AS processing_duration_seconds, frames_processed, frame_detections, tracked_observations, unique_tracks
    FROM numbered_runs)"""


def _change(name: str, better: str) -> str:
    """SQL: one compared metric of the two recordings."""
    verdict = "WHEN c > b THEN 'improved' ELSE 'regressed'" if better == "up" else "WHEN c < b THEN 'improved' ELSE 'regressed'" if better == "down" else "ELSE 'changed'"
    return f"""SELECT 'comparison' AS query, '{name}' AS name, c - b AS number,
        CASE WHEN c IS NULL OR b IS NULL THEN 'unavailable' WHEN c = b THEN 'unchanged' {verdict} END AS text
        FROM (SELECT CAST(max(CASE WHEN run_id = 'run-0' THEN {name} END) AS DOUBLE) AS b,
            CAST(max(CASE WHEN run_id = 'run-500' THEN {name} END) AS DOUBLE) AS c FROM recordings)"""


_DIRECTIONS = {"average_processing_fps": "up", "processing_duration_seconds": "down"} | dict.fromkeys(
    ("frames_processed", "frame_detections", "tracked_observations", "unique_tracks"), ""
)


def _store_sql(order: str) -> str:
    changes = " UNION ALL ".join(_change(n, d) for n, d in _DIRECTIONS.items())
    return f"""WITH {_RECORDINGS},
changes AS ({changes} UNION ALL SELECT 'comparison', name, NULL, 'unavailable'
    FROM (VALUES ('pipeline_duration_seconds'), ('initialization_overhead_seconds')) absent(name)),
listed AS (SELECT * FROM recordings ORDER BY {order} LIMIT 500)
SELECT 'runs' AS query, run_id AS name, CAST(frames_processed AS DOUBLE) AS number, status AS text FROM listed
UNION ALL SELECT 'run_count', '', CAST(count(*) AS DOUBLE), '' FROM recordings
UNION ALL SELECT 'latest_run', (SELECT run_id FROM recordings ORDER BY day DESC, run_id DESC LIMIT 1), NULL, ''
UNION ALL SELECT 'run', run_id, NULL, status FROM recordings WHERE run_id = 'run-500'
UNION ALL SELECT * FROM changes
UNION ALL SELECT 'comparison_summary', text, CAST(count(*) AS DOUBLE), ''
    FROM changes WHERE text IN ('improved', 'regressed', 'unchanged') GROUP BY text"""


def _store_rows(store: Store) -> DataFrame:
    """The run queries of a store in one table: query, name, number, text."""

    def rows(frame, query, name, number, text):
        number = F.lit(None) if number is None else F.col(number)
        columns = [F.lit(query).alias("query"), F.col(name) if isinstance(name, str) else name, number.cast("double"), text]
        return frame.select(*[c.alias(n) for c, n in zip(columns, ("query", "name", "number", "text"))])

    status = F.from_json("manifest_json", "status string")["status"]
    empty = F.lit("")
    summary = store.comparison_summary("run-0", "run-500")
    counts = F.inline(F.array(*[
        F.struct(F.lit(kind).alias("name"), F.col(f"{kind}_metric_count").alias("n")) for kind in ("improved", "regressed", "unchanged")
    ]))
    parts = [
        rows(store.runs(500), "runs", "run_id", "frames_processed", F.col("status")),
        rows(store.run_count(), "run_count", empty, "run_count", empty),
        rows(store.latest_run(), "latest_run", "run_id", None, empty),
        rows(store.run("run-500"), "run", "run_id", None, status),
        rows(store.comparison("run-0", "run-500"), "comparison", "name", "absolute_change", F.col("assessment")),
        rows(summary.select(counts).where("n > 0"), "comparison_summary", "name", "n", empty),
    ]
    return reduce(DataFrame.unionByName, parts)


@query(_store_sql("finished_at_utc DESC NULLS LAST, run_id DESC"))
def store_runs_of_tables(spark, sf_dir):
    """Run queries over the tables, filled from a folder of documents."""
    folder = new_path(spark, "store")
    documents.write_files(samples.recording_manifests(spark, sf_dir), f"{folder}/documents")
    tables.import_run_history(spark, f"{folder}/tables", f"{folder}/documents")
    return _store_rows(Store(spark, f"{folder}/tables", f"{folder}/documents"))


@query(_store_sql("run_id || '.json' DESC"))
def store_runs_of_documents(spark, sf_dir):
    """The same queries over the folder itself, where no table exists."""
    folder = new_path(spark, "store")
    documents.write_files(samples.recording_manifests(spark, sf_dir), f"{folder}/documents")
    return _store_rows(Store(spark, f"{folder}/none", f"{folder}/documents"))


_STORE_TRACKS = O.with_parts(
    O.TRACKS,
    _RECORDINGS,
    """current_run AS (SELECT r.run_id FROM recordings r WHERE run_id IN (SELECT run_id FROM evaluated)
        ORDER BY finished_at_utc DESC NULLS LAST, run_id DESC LIMIT 1)""",
    """asked AS (SELECT 'current' AS query, e.* FROM evaluated e JOIN current_run USING (run_id)
        UNION ALL SELECT 'run', e.* FROM evaluated e WHERE run_id = 'run-500')""",
    """pages AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY average_confidence DESC, track_id) AS place
        FROM asked WHERE average_confidence >= 0.4e0)""",
    select="""SELECT query || '_tracks' AS query, CAST(track_id AS VARCHAR) AS name, average_confidence AS number, quality_level AS text
        FROM pages WHERE place <= 50
    UNION ALL SELECT query || '_track', dominant_label, start_center_x, quality_level FROM asked WHERE track_id = 7
    UNION ALL SELECT query || '_statistics', 'tracks', CAST(count(*) AS DOUBLE), 'total' FROM asked GROUP BY query
    UNION ALL SELECT query || '_statistics', dominant_label, CAST(count(*) AS DOUBLE), 'label' FROM asked GROUP BY query, dominant_label
    UNION ALL SELECT query || '_statistics', level, CAST(count(*) FILTER (WHERE quality_level = level) AS DOUBLE), 'quality'
        FROM asked, (VALUES ('stable'), ('tentative'), ('weak')) levels(level) GROUP BY query, level""",
)


@query(_STORE_TRACKS)
def store_tracks(spark, sf_dir):
    """Track queries of the current and of a named recording over the tables."""
    root = new_path(spark, "store")
    saved = samples.recording_manifests(spark, sf_dir)
    tables.save_manifests(spark, root, saved.select("run_id", "manifest_json"))
    graded = samples.recording_tracks(spark, sf_dir)
    tables.import_evaluated_tracks(spark, root, saved.select("run_id"), graded)
    store = Store(spark, root)

    def rows(frame, query, name, number, text):
        return frame.select(F.lit(query).alias("query"), F.col(name).cast("string").alias("name"), F.col(number).cast("double").alias("number"), F.col(text).alias("text"))

    page, track, counts = ("track_id", "average_confidence", "quality_level"), ("dominant_label", "start_position.x", "quality_level"), ("name", "value", "section")
    parts = [
        rows(store.current_tracks(minimum_confidence=0.4, limit=50), "current_tracks", *page),
        rows(store.run_tracks("run-500", minimum_confidence=0.4, limit=50), "run_tracks", *page),
        rows(store.current_track(7), "current_track", *track),
        rows(store.run_track("run-500", 7), "run_track", *track),
        rows(store.current_statistics(), "current_statistics", *counts),
        rows(store.run_statistics("run-500"), "run_statistics", *counts),
    ]
    return reduce(DataFrame.unionByName, parts)


@query(
    f"""WITH {_RECORDINGS}
    SELECT run_id || '.json' AS file_name, CASE WHEN number % 4 IN (0, 3) THEN run_id END AS run_id,
        CASE number % 4 WHEN 1 THEN 'Manifest root value must be an object' WHEN 2 THEN 'Invalid JSON' END AS error
    FROM recordings"""
)
def import_rows(spark, sf_dir):
    """Every file of a folder with what the import made of it; half of them are damaged."""
    folder = new_path(spark, "import")
    kind = F.col("number") % 4
    text = F.when(kind == 1, "[1]").when(kind == 2, "{broken").otherwise(F.col("manifest_json"))
    documents.write_files(samples.recording_manifests(spark, sf_dir).withColumn("manifest_json", text), folder)
    return documents.import_rows(documents.scan_manifests(spark, folder))


# ---- streams ---------------------------------------------------------------


@query(_RUN_TOTALS)
def stream_run_totals(spark, sf_dir):
    return live.live_run_totals(
        spark,
        samples.frames_from(live.file_stream(spark, sf_dir, "orders.parquet")),
        samples.detections_from(live.file_stream(spark, sf_dir, "lineitem.parquet")),
    )


@query(_RUN_TOTALS)
def stream_closing_totals(spark, sf_dir):
    """Run totals from streams whose recordings close 90 days after the newest one began."""
    totals = live.RunTotals(spark, new_path(spark, "closing-totals"), "90 days")
    totals.drain(
        samples.with_recorded_at(samples.frames_from(live.file_stream(spark, sf_dir, "orders.parquet"))),
        samples.with_recorded_at(samples.detections_from(live.file_stream(spark, sf_dir, "lineitem.parquet"))),
    )
    return totals.totals()


@query(_FUSION)
def stream_fusion(spark, sf_dir):
    messages = samples.messages_from(live.file_stream(spark, sf_dir, "events.parquet"))
    return _six_decimals(live.live_fusion(spark, messages))
