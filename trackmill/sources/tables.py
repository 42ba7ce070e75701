"""Parquet tables of runs, stages and evaluated tracks, and their maintenance.

Runs, stages and the number of tracks of each run are small per run and lie in shards of the
run id; they change together by publishing a new list of shard versions, so a failure between
their writes leaves all of them as they were. Every import writes its tracks once, as a version of its
own in files that hold many runs, sorted by run; the version is what was checked, and it becomes current when the
table of track counts names it for its runs. A failure before that leaves the former tracks.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trackmill.functions.documents import manifest_error, stages_error, with_json
from trackmill.operators.runs import explode_stages, flatten
from trackmill.operators.tracks import quality_counts
from trackmill.operators.validation import duplicate_keys, orphans, run_track_problems
from trackmill.schemas import EVALUATED_COLUMNS, RUN_COLUMNS, STAGE_FIELDS, ddl
from trackmill.sources import published
from trackmill.sources.documents import import_report, importable, scan_manifests

RUN_TABLE = RUN_COLUMNS | {"manifest_json": "string"}
STAGE_TABLE = {"run_id": "string", "stage_index": "bigint"} | STAGE_FIELDS
TRACK_TABLE = {"run_id": "string"} | EVALUATED_COLUMNS
COUNT_TABLE = {"run_id": "string", "track_count": "bigint", "track_version": "string"}
SHARDS = 64
# Tracks of a version lie in folders of this shard of the run id, so a lookup opens one of them.
TRACK_SHARD = "run_id_shard"
TRACK_SHARDS = 16


def run_shard(run_id: Column) -> Column:
    """Shard of a run, from its id alone."""
    return F.pmod(F.xxhash64(run_id), F.lit(SHARDS))


def track_shard(run_id: Column) -> Column:
    """Shard of a run's tracks, from its id alone."""
    return F.pmod(F.xxhash64(run_id), F.lit(TRACK_SHARDS))


def scan_runs(spark: SparkSession, root: str) -> DataFrame:
    """Run table with its partition column, for lookups that name the shard."""
    return published.read(spark, root, "runs", RUN_TABLE)


def read_runs(spark: SparkSession, root: str) -> DataFrame:
    """Run table."""
    return scan_runs(spark, root).drop("run_shard")


def read_stages(spark: SparkSession, root: str) -> DataFrame:
    """Stage table."""
    return published.read(spark, root, "stages", STAGE_TABLE).drop("run_shard")


def _current_counts(spark: SparkSession, root: str) -> DataFrame:
    return published.read(spark, root, "track_counts", COUNT_TABLE).where("track_count > 0")


def read_track_counts(spark: SparkSession, root: str) -> DataFrame:
    """Runs that have stored tracks, with their number; reads no track."""
    return _current_counts(spark, root).select("run_id", "track_count")


def read_tracks(spark: SparkSession, root: str, run_id: str | None = None) -> DataFrame:
    """Evaluated-track table; with ``run_id`` one run's tracks, from its shard of the version that has them."""
    counts = _current_counts(spark, root)
    if run_id is not None:
        counts = counts.where((F.col("run_shard") == run_shard(F.lit(run_id))) & (F.col("run_id") == run_id))
    current = counts.select("run_id", "track_version")
    versions = [r[0] for r in current.select("track_version").distinct().collect()]  # imports that still have a run
    schema = ddl(TRACK_TABLE | {"track_version": "string", TRACK_SHARD: "bigint"})
    if not versions:
        return spark.createDataFrame([], ddl(TRACK_TABLE))
    base = f"{root}/evaluated_tracks"
    paths = [f"{base}/track_version={v}" for v in sorted(versions)]
    stored = spark.read.schema(schema).option("basePath", base).parquet(*paths)
    if run_id is not None:
        own = (F.col(TRACK_SHARD) == track_shard(F.lit(run_id))) & (F.col("run_id") == run_id)
        return stored.where(own).select(*TRACK_TABLE)
    return stored.join(current, ["run_id", "track_version"], "left_semi").select(*TRACK_TABLE)


def has_runs(spark: SparkSession, root: str) -> bool:
    """Whether runs were ever stored."""
    return published.current(spark, root)[0] > 0


def latest_per_run(batch: DataFrame, order: str | None = None) -> DataFrame:
    """Last version of every run in a batch; without ``order`` ids must not repeat, which ``save_manifests`` checks.

    Versions of equal rank are ordered by their other columns, so the same one is kept whatever the partitions.
    """
    if order is None:
        return batch
    ties = [F.desc(c) for c in batch.columns if c not in ("run_id", order)]
    last = W.partitionBy("run_id").orderBy(F.desc(order), *ties)
    return batch.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n", order)


def upserted(existing: DataFrame, batch: DataFrame) -> DataFrame:
    """Existing rows, replaced by and extended with the batch (one row per run)."""
    kept = existing.join(batch.select("run_id"), "run_id", "left_anti")
    return kept.unionByName(batch)


def replaced(existing: DataFrame, runs: DataFrame, rows: DataFrame) -> DataFrame:
    """Child rows after the rows of ``runs`` are replaced; a run without rows is emptied.

    Lazy; a row of any other run is an error when the result is computed.
    """
    named = runs.select("run_id").distinct().withColumn("_named", F.lit(True))
    message = F.concat(F.lit("Rows of a run that is not replaced: "), F.coalesce("run_id", F.lit("null")))
    checked = F.coalesce("_named", F.raise_error(message).cast("boolean"))
    fresh = rows.join(named, "run_id", "left").where(checked).drop("_named")
    return without_runs(existing, runs).unionByName(fresh)


def without_runs(children: DataFrame, removed: DataFrame) -> DataFrame:
    """Stage or track rows left after their runs are deleted."""
    return children.join(removed.select("run_id"), "run_id", "left_anti")


def _staged(spark: SparkSession, root: str, rows: DataFrame) -> DataFrame:
    """A written copy of ``rows``, computed once; what is checked is then what is stored."""
    path = f"{root}/staged/{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def _publish(spark: SparkSession, root: str, runs: DataFrame, changes: dict[str, tuple[dict, DataFrame]]) -> None:
    """Replace the rows of ``runs`` in several sharded tables at once."""
    shard = run_shard(F.col("run_id"))
    touched = [r[0] for r in runs.select(shard.alias("s")).distinct().collect()]  # at most SHARDS numbers
    ids = runs.select("run_id")
    replaced = {}
    for name, (columns, rows) in changes.items():
        kept = published.read(spark, root, name, columns, touched).join(ids, "run_id", "left_anti")
        fresh = rows.select(*columns, shard.alias("run_shard"))
        replaced[name] = kept.select(*columns, "run_shard").unionByName(fresh)
    published.publish(spark, root, replaced, touched, "run_id")


def save_manifests(
    spark: SparkSession, root: str, documents: DataFrame, order: str | None = None
) -> None:
    """Insert or replace runs with their stages; ``order`` ranks versions of one run.

    Nothing is stored if any document is not a JSON object, belongs to another run, or has
    ``stages`` that are no list. Runs and stages become visible together.
    """
    batch = _staged(spark, root, latest_per_run(documents, order).select("run_id", "manifest_json"))
    repeated = duplicate_keys(batch, ("run_id",)).limit(1).collect()
    if repeated:
        raise ValueError(f"A batch without order has run {repeated[0].run_id} {repeated[0].copies} times")
    json = F.col("json")
    problem = F.coalesce(manifest_error(json, F.col("manifest_json"), F.col("run_id")), stages_error(json))
    bad = with_json(batch, "manifest_json").select("run_id", problem.alias("problem")).where("problem is not null or run_id is null")
    first = bad.orderBy("run_id").limit(1).collect()
    if first:
        raise ValueError(f"Cannot save run {first[0].run_id}: {first[0].problem or 'no run id'}")
    changes = {"stages": (STAGE_TABLE, explode_stages(batch)), "runs": (RUN_TABLE, flatten(batch))}
    _publish(spark, root, batch.select("run_id"), changes)


def delete_runs(spark: SparkSession, root: str, runs: DataFrame) -> None:
    """Delete runs together with their stages and tracks."""
    ids = _staged(spark, root, runs.select("run_id").distinct())
    nothing = spark.createDataFrame([], ddl(TRACK_TABLE))
    replace_tracks(spark, root, ids, nothing, known_runs_only=False)
    tables = {"stages": STAGE_TABLE, "runs": RUN_TABLE}
    _publish(spark, root, ids, {n: (c, spark.createDataFrame([], ddl(c))) for n, c in tables.items()})


def replace_tracks(
    spark: SparkSession,
    root: str,
    runs: DataFrame,
    tracks: DataFrame,
    known_runs_only: bool = True,
) -> DataFrame:
    """Replace all tracks of ``runs``; nothing is stored if any row or run is bad.

    The tracks are computed once into a version, which is checked, made current with the table of track
    counts, and returned. A former version keeps the runs that are not replaced.
    """
    version = uuid.uuid4().hex
    path = f"{root}/evaluated_tracks/track_version={version}"
    rows = tracks.select(*TRACK_TABLE)
    # REBALANCE gathers each shard's rows and lets adaptive execution merge small partitions and split large ones.
    dealt = rows.withColumn(TRACK_SHARD, track_shard(F.col("run_id"))).hint("rebalance", TRACK_SHARD)
    dealt.sortWithinPartitions(TRACK_SHARD, "run_id", "track_id").write.partitionBy(TRACK_SHARD).parquet(path)
    staged = spark.read.schema(rows.schema).parquet(path).select(*TRACK_TABLE)
    ids = _staged(spark, root, runs.select("run_id").distinct())
    problem = run_track_problems(staged).limit(1).collect()
    if problem:
        raise ValueError(f"{problem[0].problem} (run {problem[0].run_id})")
    # One row per run before the join: a run with very many tracks does not weigh on it.
    counts = staged.groupBy("run_id").agg(F.count("*").alias("track_count"))
    first = F.min(F.struct(F.coalesce("run_id", F.lit("null")).alias("run_id"))).alias("first")
    lost = orphans(counts, ids).agg(F.sum("track_count").alias("rows"), F.count("*").alias("runs"), first).first()
    if lost.rows:
        raise ValueError(f"{lost.rows} tracks of {lost.runs} runs that are not imported, the first {lost.first.run_id}")
    if known_runs_only:
        unknown = orphans(ids, read_runs(spark, root)).limit(1).collect()
        if unknown:
            raise ValueError(f"Cannot import tracks for an unknown run: {unknown[0].run_id}")
    _publish(spark, root, ids, {"track_counts": (COUNT_TABLE, counts.withColumn("track_version", F.lit(version)))})
    return staged


def import_run_history(spark: SparkSession, root: str, folder: str) -> DataFrame:
    """Import a folder of manifests; bad files are reported, good ones stored."""
    scan = importable(scan_manifests(spark, folder))
    good = scan.where(F.col("error").isNull()).select("run_id", "manifest_json")
    save_manifests(spark, root, good)
    count = read_runs(spark, root).agg(F.count("*").alias("n"))
    return import_report(scan, count)


def import_evaluated_tracks(
    spark: SparkSession, root: str, runs: DataFrame, tracks: DataFrame
) -> DataFrame:
    """Replace the tracks of known runs and report stored and graded counts per run."""
    staged = replace_tracks(spark, root, runs, tracks)
    return import_summary(runs, staged, read_tracks(spark, root))


def import_summary(runs: DataFrame, imported: DataFrame, stored: DataFrame) -> DataFrame:
    """Imported rows, stored rows and stored level counts of every run of an import."""
    sent = imported.groupBy("run_id").agg(F.count("*").alias("imported"))
    counts = quality_counts(stored).withColumnRenamed("total", "database_track_count")
    joined = runs.select("run_id").join(sent, "run_id", "left").join(counts, "run_id", "left")
    names = ("imported", "database_track_count", "stable", "tentative", "weak")
    return joined.select("run_id", *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in names])
