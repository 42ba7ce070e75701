"""Domain tables derived from the sample star schema.

Recordings: 500 consecutive order keys are the frames of one recording, a
lineitem is a box in its order's frame. Runs: every order is one processing run
of a configuration (its customer); the recording of orders ``k*500..k*500+499``
is the output of run ``run-<k*500>``. Events are a second set of observations,
one recording per day. All mappings are per-row expressions; nothing is joined
to build a fact table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackmill.functions.numbers import exact_sum, py_round
from trackmill.operators.detections import frame_timestamp, observations
from trackmill.operators.frames import run_totals
from trackmill.operators.runs import measured_results, with_metrics, with_track_counts
from trackmill.operators.tracks import evaluate, summarize

FRAMES_PER_RECORDING = 500
STAGES_PER_RUN = 7


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One sample table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _run_id(order_key: str) -> Column:
    return F.concat(F.lit("run-"), F.col(order_key).cast("string"))


def _recording(order_key: str) -> dict[str, Column]:
    size = FRAMES_PER_RECORDING
    number = F.expr(f"{order_key} div {size}")
    return {
        "run_id": F.concat(F.lit("run-"), (number * size).cast("string")),
        "frame_number": (F.col(order_key) % size + 1).cast("bigint"),
        # 0, 10, 20 or 30 frames per second; 0 stands for "not reported".
        "source_fps": (number % 4 * 10).cast("double"),
    }


def frames_from(orders: DataFrame) -> DataFrame:
    """Recording frames, empty ones included."""
    return orders.select(*[c.alias(n) for n, c in _recording("o_orderkey").items()])


def detections_from(lineitem: DataFrame) -> DataFrame:
    """Raw boxes; a box without a confirmed track has no track id."""
    place = _recording("l_orderkey")
    x1, y1 = F.col("l_quantity"), F.col("l_discount") * 100
    return lineitem.select(
        place["run_id"].alias("run_id"),
        place["frame_number"].alias("frame_number"),
        F.col("l_linenumber").cast("bigint").alias("seq"),
        frame_timestamp(place["frame_number"], place["source_fps"]).alias("timestamp_seconds"),
        F.when(F.col("l_linestatus") != "F", F.col("l_suppkey")).alias("raw_track_id"),
        (F.col("l_linenumber") % 5).cast("bigint").alias("class_id"),
        (F.lit(0.3) + F.col("l_discount") * 5).alias("confidence"),
        x1.alias("x1"),
        y1.alias("y1"),
        (x1 + F.col("l_extendedprice") / 1000).alias("x2"),
        (y1 + F.col("l_tax") * 100 + 1).alias("y2"),
    )


def with_recorded_at(rows: DataFrame) -> DataFrame:
    """Add the start of each order recording: one an hour, in the order of their numbers."""
    number = F.substring("run_id", 5, 20).cast("bigint") / FRAMES_PER_RECORDING
    return rows.withColumn("recorded_at", F.timestamp_seconds(1_700_000_000 + number * 3600))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of the order recordings."""
    return frames_from(table(spark, sf_dir, "orders"))


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of the order recordings."""
    return detections_from(table(spark, sf_dir, "lineitem"))


def classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class dictionary."""
    return table(spark, sf_dir, "region").select(
        F.col("r_regionkey").cast("bigint").alias("class_id"), F.col("r_name").alias("label")
    )


def recording_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations of the order recordings."""
    return observations(detections(spark, sf_dir), classes(spark, sf_dir))


def recording_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graded tracks of the order recordings."""
    return evaluate(summarize(recording_observations(spark, sf_dir)))


def _event_fields() -> dict[str, Column]:
    day = F.regexp_replace(F.col("ts").cast("date").cast("string"), "-", "")
    micros = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")
    in_day = F.pmod(micros, F.lit(86_400_000_000))
    return {
        "run_id": F.concat(F.lit("run-"), day),
        "seconds": F.floor((in_day + 500) / 1000) / 1000,
        "k": F.from_json("props", "k double")["k"],
    }


def event_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as observations: one recording per day, one track per user."""
    fields = _event_fields()
    capped = F.least(F.col("value"), F.lit(100.0))
    return table(spark, sf_dir, "events").select(
        fields["run_id"].alias("run_id"),
        F.col("event_id").alias("frame_number"),
        F.col("event_id").alias("seq"),
        fields["seconds"].alias("timestamp_seconds"),
        F.col("user_id").alias("track_id"),
        F.col("event_type").alias("label"),
        (F.floor(capped * 100 + 0.5) / 10000).alias("confidence"),
        fields["k"].alias("center_x"),
        F.col("value").alias("center_y"),
    )


def messages_from(events: DataFrame) -> DataFrame:
    """Weighted sensor messages; one fusion group per day."""
    fields = _event_fields()
    return events.select(
        fields["run_id"].alias("fusion_id"),
        F.col("event_type").alias("sensor_id"),
        F.col("value").alias("value"),
        ((fields["k"] + 1) / 100).alias("weight"),
    )


def sensor_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sensor messages of the events."""
    return messages_from(table(spark, sf_dir, "events"))


def run_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per run as recorded while it ran."""
    status = (
        F.when(F.col("o_orderstatus") == "F", "completed")
        .when(F.col("o_orderstatus") == "O", "running")
        .otherwise("failed")
    )
    day = F.col("o_orderdate").cast("date").cast("string")
    ended = F.col("status") != "running"
    return (
        table(spark, sf_dir, "orders")
        .withColumn("status", status)
        .select(
            _run_id("o_orderkey").alias("run_id"),
            F.lit(3).cast("bigint").alias("schema_version"),
            "status",
            F.when(ended, F.when(F.col("status") == "failed", 1).otherwise(0))
            .cast("bigint")
            .alias("exit_code"),
            F.col("o_custkey").alias("config_id"),
            F.concat(day, F.lit("T00:00:00+00:00")).alias("started_at_utc"),
            F.when(ended, F.concat(day, F.lit("T12:00:00+00:00"))).alias("finished_at_utc"),
            F.when(ended, F.col("o_totalprice") / 1000).alias("pipeline_seconds"),
            F.col("o_orderpriority").alias("model_path"),
        )
    )


def stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stage log: at most seven stages per run, each the sum of its lineitems.

    ``slot`` is where the stage stands among all possible ones; its place in the
    run's own list is derived by the stage-index operator.
    """
    slot = F.pmod(F.col("l_linenumber") - 1, F.lit(STAGES_PER_RUN)).cast("bigint")
    sums = (
        table(spark, sf_dir, "lineitem")
        .select(_run_id("l_orderkey").alias("run_id"), slot.alias("slot"), "l_extendedprice")
        .groupBy("run_id", "slot")
        .agg(exact_sum(F.col("l_extendedprice"), 2).alias("amount"))
    )
    return sums.select(
        "run_id",
        "slot",
        F.concat(F.lit("stage-"), F.col("slot").cast("string")).alias("name"),
        F.lit("completed").alias("status"),
        py_round(F.col("amount") / 1000, 3).alias("duration_seconds"),
        F.lit(0).cast("bigint").alias("exit_code"),
    )


def measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw processing counts per run; runs without lineitems have none."""
    confirmed = F.col("l_linestatus") == "O"
    per_run = (
        table(spark, sf_dir, "lineitem")
        .select(
            _run_id("l_orderkey").alias("run_id"),
            "l_quantity",
            "l_extendedprice",
            confirmed.alias("confirmed"),
            F.when(confirmed, F.col("l_suppkey")).alias("confirmed_id"),
        )
        .groupBy("run_id")
        .agg(
            (exact_sum(F.col("l_extendedprice"), 2) / 1000).alias("seconds"),
            exact_sum(F.col("l_quantity"), 2).cast("bigint").alias("frames_processed"),
            F.count("*").alias("frame_detections"),
            F.count_if("confirmed").alias("tracked_observations"),
            F.count_distinct("confirmed_id").alias("unique_tracks"),
        )
    )
    return per_run


def run_measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements with the status of their run."""
    headers = run_headers(spark, sf_dir).select("run_id", "status")
    return measurements(spark, sf_dir).join(headers, "run_id")


def metrics_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Processing-metrics documents; metrics exist for runs that processed something."""
    done = measurements(spark, sf_dir).withColumn("status", F.lit("completed"))
    return measured_results(done)


def closed_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run records with durations and metrics, without track counts."""
    return with_metrics(
        run_headers(spark, sf_dir), stages(spark, sf_dir), metrics_documents(spark, sf_dir)
    )


def final_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closing records of all runs."""
    return with_track_counts(closed_runs(spark, sf_dir), recording_tracks(spark, sf_dir))


def measured_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run table with the comparable metrics, without documents."""
    runs = closed_runs(spark, sf_dir)
    metrics = F.col("processing_metrics")
    return runs.select(
        "run_id",
        "config_id",
        "schema_version",
        "status",
        "exit_code",
        "started_at_utc",
        "finished_at_utc",
        F.col("pipeline_duration_seconds").alias("duration_seconds"),
        "model_path",
        F.lit("cpu").alias("device"),
        "processing_metrics_available",
        metrics["average_processing_fps"].alias("average_processing_fps"),
        metrics["duration_seconds"].alias("processing_duration_seconds"),
        "pipeline_duration_seconds",
        "initialization_overhead_seconds",
        *[
            metrics[name].alias(name)
            for name in (
                "frames_processed",
                "frame_detections",
                "tracked_observations",
                "unique_tracks",
            )
        ],
    )


def recording_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document per order recording with its totals; some rates are NaN, text, a flag or absent.

    Every seventh recording is still running. Recordings end a day apart in the order of their numbers.
    """
    totals = run_totals(frames(spark, sf_dir), detections(spark, sf_dir))
    number = (F.substring("run_id", 5, 20).cast("bigint") / FRAMES_PER_RECORDING).cast("bigint")
    day = F.date_add(F.lit("2000-01-01").cast("date"), F.col("number").cast("int")).cast("string")
    rate = (
        F.when(F.col("number") % 5 == 1, "NaN").when(F.col("number") % 5 == 2, '"fast"').when(F.col("number") % 5 == 3, "true")
        .when(F.col("number") % 5 == 4, "null").otherwise(F.concat(F.col("unique_tracks").cast("string"), F.lit(".5")))
    )
    running = F.col("number") % 7 == 3
    text = F.format_string(
        '{"run_id":"%s","schema_version":3,"status":"%s","started_at_utc":"%sT00:00:00+00:00","finished_at_utc":%s,'
        '"performance":{"processing_metrics_available":true,"processing_metrics":{"duration_seconds":%d.25,"results":{'
        '"average_processing_fps":%s,"frames_processed":%d,"frame_detections":%d,"tracked_observations":%d,"unique_tracks":%d}}},'
        '"stages":[]}',
        "run_id", F.when(running, "running").otherwise("completed"), day,
        F.when(running, "null").otherwise(F.concat(F.lit('"'), day, F.lit('T12:00:00+00:00"'))),
        "number", rate, "frames_processed", "frame_detections", "tracked_observations", "unique_tracks",
    )
    return totals.withColumn("number", number).select("run_id", "number", text.alias("manifest_json"))


def manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run documents as JSON text with ``run_id`` beside it."""
    lists = (
        stages(spark, sf_dir)
        .groupBy("run_id")
        .agg(
            # At most seven entries: one per slot.
            F.sort_array(
                F.collect_list(F.struct("slot", "name", "status", "duration_seconds", "exit_code"))
            ).alias("listed")
        )
    )
    stage_list = F.transform(
        "listed",
        lambda s: F.struct(
            s["name"].alias("name"),
            s["status"].alias("status"),
            s["duration_seconds"].alias("duration_seconds"),
            s["exit_code"].alias("exit_code"),
        ),
    )
    metrics = F.col("processing_metrics")
    names = (
        "frames_processed",
        "frame_detections",
        "tracked_observations",
        "unique_tracks",
        "average_processing_fps",
    )
    document = F.struct(
        "schema_version",
        "run_id",
        "status",
        "exit_code",
        F.concat(F.lit("config-"), F.col("config_id").cast("string")).alias("configuration_path"),
        "started_at_utc",
        "finished_at_utc",
        F.col("pipeline_duration_seconds").alias("duration_seconds"),
        F.struct(
            F.concat(F.lit("videos/"), F.col("config_id").cast("string")).alias("path"),
            F.lit(True).alias("exists"),
            F.sha2("run_id", 256).alias("sha256"),
        ).alias("input"),
        F.struct(
            "model_path",
            F.lit("tracker.yaml").alias("tracker_config"),
            F.lit(0.35).alias("confidence_threshold"),
            F.lit(640).cast("bigint").alias("image_size"),
            F.lit("cpu").alias("device"),
        ).alias("model"),
        F.struct(
            "pipeline_duration_seconds",
            "stage_duration_seconds",
            "initialization_overhead_seconds",
            "processing_metrics_available",
            F.when(
                metrics.isNotNull(),
                F.struct(
                    metrics["duration_seconds"].alias("duration_seconds"),
                    F.struct(*[metrics[n].alias(n) for n in names]).alias("results"),
                ),
            ).alias("processing_metrics"),
            "processing_metrics_error",
        ).alias("performance"),
        F.coalesce(stage_list, F.array().cast(_STAGE_LIST)).alias("stages"),
    )
    return (
        closed_runs(spark, sf_dir)
        # Building a document is heavy, so the rows are spread instead of broadcast to.
        .join(lists.hint("merge"), "run_id", "left")
        .select(
            "run_id",
            F.to_json(document, {"ignoreNullFields": "false"}).alias("manifest_json"),
        )
    )


_STAGE_LIST = (
    "array<struct<name: string, status: string, duration_seconds: double, exit_code: bigint>>"
)
