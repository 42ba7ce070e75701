"""Run-manifest and metrics documents, and content fingerprints."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackmill.functions.checks import require_limit, require_run_id, valid_run_id
from trackmill.functions.documents import (
    is_json,
    is_object,
    manifest_error,
    parse_metrics,
    stages_error,
    with_json,
)
from trackmill.sources.csv_tables import exists
from trackmill.sources.fingerprints import fingerprint_folder, open_path

# Error texts of a metrics document.
METRICS_NOT_OBJECT = "Metrics root value must be an object."
METRICS_INVALID = "Invalid JSON"
METRICS_MISSING = "Metrics file not found"
# Fixed value: begins a record of a JSON text sequence.
RECORD_SEPARATOR = "\x1e"


def write_files(documents: DataFrame, folder: str) -> int:
    """A folder of documents, one ``<run_id>.json`` each, written by the tasks; returns their number.

    A repeated task writes the same files again. Ids that are not safe as names, or repeat, are an error.
    """
    rows = documents.select("run_id", "manifest_json")
    safe = F.coalesce(valid_run_id(F.col("run_id")), F.lit(False))
    bad = rows.groupBy("run_id").agg(F.count("*").alias("n")).where((F.col("n") > 1) | ~safe).limit(1).collect()
    if bad:
        raise ValueError(f"Run ids must be safe and unique file names: {bad[0].run_id}")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made = False
        for batch in batches:
            for name, text in zip(batch["run_id"], batch["manifest_json"]):
                system, path = open_path(f"{folder}/{name}.json")
                if not made:
                    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
                    made = True
                with system.open_output_stream(path) as stream:
                    stream.write((text or "").encode())
            yield batch[["run_id"]]

    return rows.mapInPandas(write, "run_id string").count()


def _names(spark: SparkSession, folder: str) -> DataFrame:
    if not exists(spark, folder):
        return spark.createDataFrame([], "file_name string")
    # The binary source lists files without reading content that is not selected.
    files = spark.read.format("binaryFile").load(folder, pathGlobFilter="*.json")
    return files.select(F.col("_metadata.file_name").alias("file_name"))


def count_manifests(spark: SparkSession, folder: str) -> DataFrame:
    """Number of manifest files, whether or not they are valid."""
    return _names(spark, folder).agg(F.count("*").alias("run_count"))


def scan_manifests(
    spark: SparkSession, folder: str, glob: str = "*.json", names: list[str] | None = None
) -> DataFrame:
    """Every manifest file with its text and, if it is bad, the reason.

    ``names`` restricts the scan to some files before they are opened. Ascending
    path order is the import order. A missing folder holds no document.
    """
    if not exists(spark, folder):
        columns = "path string, file_name string, manifest_json string, error string, stages_error string, run_id string"
        return spark.createDataFrame([], columns)
    files = spark.read.text(folder, wholetext=True, pathGlobFilter=glob)
    name = F.col("_metadata.file_name")
    if names is not None:
        files = files.where(name.isin(names))
    stem = F.regexp_replace("file_name", r"\.json$", "")
    texts = files.select(
        F.col("_metadata.file_path").alias("path"),
        name.alias("file_name"),
        F.col("value").alias("manifest_json"),
    )
    json, text = F.col("json"), F.col("manifest_json")
    return (
        with_json(texts, "manifest_json")
        .withColumn("error", manifest_error(json, text, stem))
        .withColumn("stages_error", stages_error(json))
        .withColumn("run_id", F.when(F.col("error").isNull(), stem))
        .drop("json")
    )


def _all_valid(files: DataFrame) -> DataFrame:
    """Fail when any scanned manifest is bad."""
    message = F.concat_ws(": ", F.lit("Invalid pipeline run manifest"), "path", "error")
    good = F.when(F.col("error").isNull(), True).otherwise(F.raise_error(message).cast("boolean"))
    return files.where(good).select("file_name", "run_id", "manifest_json")


def list_manifests(spark: SparkSession, folder: str, limit: int | None = None) -> DataFrame:
    """Documents by file name descending; any bad one fails the whole listing.

    With a limit the chosen file names (at most ``limit`` short texts) become a
    file-name filter, so only those files are opened.
    """
    names = None
    if limit is not None:
        require_limit(limit)
        newest = _names(spark, folder).orderBy(F.desc("file_name")).limit(limit)
        names = [row.file_name for row in newest.collect()]
    return _all_valid(scan_manifests(spark, folder, names=names)).orderBy(F.desc("file_name"))


def read_manifest(spark: SparkSession, folder: str, run_id: str) -> DataFrame:
    """Document of one run; opens only its own file."""
    return _all_valid(scan_manifests(spark, folder, glob=f"{require_run_id(run_id)}.json"))


def importable(scan: DataFrame) -> DataFrame:
    """Scan rows with the stage-list check added to their error."""
    return scan.withColumn("error", F.coalesce("error", "stages_error"))


def import_report(scan: DataFrame, run_count: DataFrame) -> DataFrame:
    """Discovered, imported and failed files and the final table size, in one row.

    The id list is ``scan`` without errors, the error list is ``scan`` with them.
    """
    return scan.agg(
        F.count("*").alias("discovered"),
        F.count_if(F.col("error").isNull()).alias("imported"),
        F.count_if(F.col("error").isNotNull()).alias("failed"),
    ).withColumn("database_run_count", run_count.scalar())


def import_rows(scan: DataFrame) -> DataFrame:
    """What an import did with every file: file_name, run_id (null for a bad one), error (null for a good one)."""
    return importable(scan).select("file_name", F.when(F.col("error").isNull(), F.col("run_id")).alias("run_id"), "error")


def write_manifests(documents: DataFrame, path: str) -> None:
    """Archive of documents as JSON text sequences: any number of runs per file, a document per record.

    A record begins with the separator character, which no JSON document holds, and ends with a line
    feed, so documents keep their own line breaks and indentation byte by byte. Null documents are left out.
    """
    text = F.concat(F.lit(RECORD_SEPARATOR), "manifest_json")
    rows = documents.where(F.col("manifest_json").isNotNull()).select(text.alias("value"))
    rows.write.mode("overwrite").text(path)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Documents of an archive with their run id; large files are split at records."""
    records = spark.read.option("lineSep", RECORD_SEPARATOR).text(path).where("value <> ''")
    text = F.regexp_replace("value", r"\n\z", "")
    run_id = F.from_json(text, "run_id string")["run_id"]
    return records.select(run_id.alias("run_id"), text.alias("manifest_json"))


def metrics_availability(runs: DataFrame, texts: DataFrame) -> DataFrame:
    """Attach metrics documents (``run_id, metrics_json``) to runs; never fails.

    An absent, broken or non-object document leaves ``available`` false with a reason.
    """
    text, json = F.col("metrics_json"), F.col("json")
    error = (
        F.when(text.isNull(), METRICS_MISSING)
        .when(~is_json(json), METRICS_INVALID)
        .when(~is_object(json, text), METRICS_NOT_OBJECT)
    )
    joined = runs.join(texts.select("run_id", "metrics_json"), "run_id", "left")
    return (
        with_json(joined, "metrics_json")
        .withColumn("processing_metrics_error", error)
        .withColumn("processing_metrics_available", F.col("processing_metrics_error").isNull())
        .withColumn(
            "processing_metrics",
            F.when(F.col("processing_metrics_available"), parse_metrics(text)),
        )
        .drop("metrics_json", "json")
    )


def read_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Metrics documents of a folder, keyed by file stem."""
    files = spark.read.text(folder, wholetext=True, pathGlobFilter="*.json")
    return files.select(
        F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", "").alias("run_id"),
        F.col("value").alias("metrics_json"),
    )


def content_fingerprint(content: Column) -> list[Column]:
    """Size in bytes and SHA-256 of a text or binary column."""
    return [
        F.octet_length(content).cast("bigint").alias("size_bytes"),
        F.sha2(content.cast("binary"), 256).alias("sha256"),
    ]


def fingerprint_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Path, size and SHA-256 of the files of a folder, of any size."""
    return fingerprint_folder(spark, path, glob)
