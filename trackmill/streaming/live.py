"""Incremental run totals and incremental fusion as streaming aggregations.

Each stream keeps one small state row per key, aggregates every micro-batch
before it reaches the state, and writes only the keys that changed. Batches are
written under their batch id, so a batch that is repeated after a failure
replaces its own output. The newest row of a key is the running result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trackmill.operators.fusion import fuse_parts, fused
from trackmill.session import new_path
from trackmill.sources.csv_tables import exists


def file_stream(spark: SparkSession, folder: str, name: str, per_batch: int = 64) -> DataFrame:
    """Stream over the Parquet files of a folder whose names match ``name``."""
    like = spark.read.option("pathGlobFilter", name).parquet(folder)
    return (
        spark.readStream.schema(like.schema)
        .option("pathGlobFilter", name)
        .option("maxFilesPerTrigger", per_batch)
        .parquet(folder)
    )


def fold(states: DataFrame, output: str, checkpoint: str) -> None:
    """Run a streaming aggregation over all available input and keep its changes."""

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{output}/batch_id={batch_id}")

    query = (
        states.writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(save)
        .start()
    )
    query.awaitTermination()


def newest_states(spark: SparkSession, output: str, states: DataFrame, keys: list[str]) -> DataFrame:
    """Last written state of every key."""
    if not exists(spark, output):  # the stream had no input
        return spark.createDataFrame([], states.schema)
    changes = spark.read.parquet(output)
    last = W.partitionBy(*keys).orderBy(F.desc("batch_id"))
    return changes.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n", "batch_id")


_RUN_KEYS = ["run_id", "kind", "track_id"]


def run_states(frames: DataFrame, detections: DataFrame) -> DataFrame:
    """Streaming counts per run, row kind and track.

    A streaming exact distinct count per run would hold all ids of a run in one
    state value. Here every track has its own state row, so a run of any length
    spreads over all state partitions.
    """
    frame = frames.select(
        "run_id", F.lit("frame").alias("kind"), F.lit(None).cast("bigint").alias("track_id")
    )
    box = detections.select(
        "run_id", F.lit("box").alias("kind"), F.col("raw_track_id").cast("bigint").alias("track_id")
    )
    return frame.unionByName(box).groupBy(*_RUN_KEYS).agg(F.count("*").alias("n"))


def totals_from_states(states: DataFrame) -> DataFrame:
    """Run totals from the newest per-track counts."""
    is_box = F.col("kind") == "box"
    confirmed = F.col("track_id").isNotNull()
    return states.groupBy("run_id").agg(
        F.sum(F.when(is_box, 0).otherwise(F.col("n"))).alias("frames_processed"),
        F.sum(F.when(is_box, F.col("n")).otherwise(0)).alias("frame_detections"),
        F.sum(F.when(confirmed, F.col("n")).otherwise(0)).alias("tracked_observations"),
        F.count("track_id").alias("unique_tracks"),
    )


def live_run_totals(spark: SparkSession, frames: DataFrame, detections: DataFrame) -> DataFrame:
    """Drain frame and detection streams and return the run totals."""
    output = new_path(spark, "run-totals")
    states = run_states(frames, detections)
    fold(states, output, f"{output}-checkpoint")
    return totals_from_states(newest_states(spark, output, states, _RUN_KEYS))


class LateRows(RuntimeError):
    """Rows of recordings that were already closed have been left out."""


def run_counts(frames: DataFrame, detections: DataFrame, delay: str) -> DataFrame:
    """Streaming totals of a recording with state for open recordings only.

    Both streams carry ``recorded_at``, one time per recording (its start). When the slower
    stream's newest recording is ``delay`` later, a recording is closed: the watermark passes it, and its
    track ids and its totals leave the state. A track counts once because its later rows are
    duplicates within the watermark: one state row per track of an open recording, and never a set of ids.
    """
    empty = F.lit(0).cast("bigint")
    frame = frames.withWatermark("recorded_at", delay).select(
        "run_id", "recorded_at", F.lit(1).cast("bigint").alias("frames_processed"),
        *[empty.alias(c) for c in _TOTALS[1:]],
    )
    boxes = detections.withWatermark("recorded_at", delay).select("run_id", "recorded_at", "raw_track_id")
    confirmed = F.col("raw_track_id").isNotNull()
    box = boxes.select(
        "run_id", "recorded_at", empty.alias("frames_processed"), F.lit(1).cast("bigint").alias("frame_detections"),
        F.when(confirmed, 1).otherwise(0).cast("bigint").alias("tracked_observations"), empty.alias("unique_tracks"),
    )
    first = boxes.where(confirmed).dropDuplicatesWithinWatermark(["run_id", "raw_track_id"]).select(
        "run_id", "recorded_at", *[empty.alias(c) for c in _TOTALS[:3]], F.lit(1).cast("bigint").alias("unique_tracks")
    )
    rows = frame.unionByName(box).unionByName(first)
    return rows.groupBy("run_id", "recorded_at").agg(*[F.sum(c).alias(c) for c in _TOTALS])


_TOTALS = ("frames_processed", "frame_detections", "tracked_observations", "unique_tracks")
_CHANGES = "run_id string, recorded_at timestamp, " + ", ".join(f"{c} bigint" for c in _TOTALS) + ", batch_id bigint"


class RunTotals:
    """Totals of recordings kept in a folder while their streams run.

    Every micro-batch writes the totals that it changed, one row per recording, into one of
    ``slots`` places in turn. Before a place is used again the places are folded into a
    snapshot with one row per recording, so the log never holds more than ``slots`` batches. A
    repeated batch overwrites its own place. A snapshot counts from the moment its number is
    recorded, after it is complete; until then the former one and the log still hold everything.
    """

    def __init__(self, spark: SparkSession, folder: str, delay: str = "1 day", slots: int = 16):
        self.spark, self.folder, self.delay, self.slots = spark, folder, delay, slots

    def drain(self, frames: DataFrame, detections: DataFrame) -> list[dict]:
        """Take all available input; one entry per micro-batch: batch_id, state_rows, late_rows.

        Raises ``LateRows`` if rows came after their recording was closed, as the totals then lack them.
        """
        query = (
            run_counts(frames, detections, self.delay)
            .writeStream.outputMode("update")
            .option("checkpointLocation", f"{self.folder}/checkpoint")
            .trigger(availableNow=True)
            .foreachBatch(self._save)
            .start()
        )
        query.awaitTermination()
        seen = [
            {
                "batch_id": p.batchId,
                "state_rows": sum(o.numRowsTotal for o in p.stateOperators),
                "late_rows": sum(o.numRowsDroppedByWatermark for o in p.stateOperators),
            }
            for p in query.recentProgress
        ]
        late = sum(p["late_rows"] for p in seen)
        if late:
            raise LateRows(f"{late} rows belong to recordings that were closed more than {self.delay} before the newest one")
        return seen

    def totals(self) -> DataFrame:
        """Current totals per run, open recordings included."""
        sums = [F.sum(c).alias(c) for c in _TOTALS]
        return self._newest().groupBy("run_id").agg(*sums)

    def _save(self, batch: DataFrame, batch_id: int) -> None:
        if batch_id and batch_id % self.slots == 0:
            self.fold_log(batch_id - 1)
        place = f"{self.folder}/log/slot={batch_id % self.slots}"
        batch.withColumn("batch_id", F.lit(batch_id).cast("bigint")).write.mode("overwrite").parquet(place)

    def fold_log(self, last: int) -> None:
        """Write the snapshot of all batches up to ``last``."""
        number = self._folds()[-1][0] + 1 if self._folds() else 0
        rows = self._newest().where(F.col("batch_id") <= last)
        rows.write.mode("overwrite").parquet(f"{self.folder}/snapshot/number={number}")
        done = self.spark.createDataFrame([(number, last)], "number int, last bigint").coalesce(1)
        done.write.mode("append").parquet(f"{self.folder}/folds")

    def _folds(self) -> list[tuple[int, int]]:
        """Numbers of the complete snapshots, one per ``slots`` batches."""
        if not exists(self.spark, f"{self.folder}/folds"):
            return []
        return sorted(map(tuple, self.spark.read.schema("number int, last bigint").parquet(f"{self.folder}/folds").collect()))

    def _newest(self) -> DataFrame:
        parts = []
        folds = self._folds()
        if folds:
            parts.append(self.spark.read.schema(_CHANGES).parquet(f"{self.folder}/snapshot/number={folds[-1][0]}"))
        if exists(self.spark, f"{self.folder}/log"):
            log = self.spark.read.schema(_CHANGES).parquet(f"{self.folder}/log").drop("slot")
            parts.append(log.select(*_CHANGE_NAMES).where(F.col("batch_id") > (folds[-1][1] if folds else -1)))
        if not parts:
            return self.spark.createDataFrame([], _CHANGES)
        rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        last = W.partitionBy("run_id", "recorded_at").orderBy(F.desc("batch_id"))
        return rows.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")


_CHANGE_NAMES = ["run_id", "recorded_at", *_TOTALS, "batch_id"]


def live_fusion(spark: SparkSession, messages: DataFrame) -> DataFrame:
    """Drain a message stream and return the current estimates."""
    output = new_path(spark, "fusion")
    states = fuse_parts(messages, "fusion_id")
    fold(states, output, f"{output}-checkpoint")
    return fused(newest_states(spark, output, states, ["fusion_id", "name", "bin"]))
