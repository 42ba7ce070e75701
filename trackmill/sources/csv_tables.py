"""CSV scans by column name with strict cell typing, and CSV sinks."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from trackmill.schemas import EVALUATED_COLUMNS, OBSERVATION_COLUMNS, SUMMARY_COLUMNS
from trackmill.sources.split_csv import scan_records

# What an integer or a float cell may look like.
INTEGER_CELL = r"\A\s*[+-]?\d+(_\d+)*\s*\z"
FLOAT_CELL = (
    r"(?i)\A\s*[+-]?((\d+(_\d+)*)(\.(\d+(_\d+)*)?)?(e[+-]?\d+(_\d+)*)?"
    r"|\.\d+(_\d+)*(e[+-]?\d+(_\d+)*)?|nan|inf|infinity)\s*\z"
)

# Cells of these characters only, as nearly all are: there a cast alone accepts what the patterns above accept.
PLAIN_CELLS = r"\A[-+.,0-9eE]*\z"


def _typed(name: str, kind: str, plain: Column) -> Column:
    cell = F.col(name)
    if kind == "string":
        return F.coalesce(cell, F.lit(""))  # the reader turns empty text into null
    pattern = INTEGER_CELL if kind == "bigint" else FLOAT_CELL
    # In an array function, which no generated code holds: one large method of it would run uncompiled.
    odd = F.transform(F.array(cell), lambda c: F.when(c.rlike(pattern), F.regexp_replace(F.trim(c), "_", "")))
    return F.when(plain, cell).otherwise(F.get(odd, F.lit(0))).try_cast(kind)


def scan_text(
    spark: SparkSession, path: str, columns: dict[str, str], multiline: bool | str = True
) -> DataFrame:
    """All wanted cells as text, picked by header name, in file order (``seq``).

    ``run_id`` comes from a column or from ``run_id=...`` folders when there are any. ``multiline``
    keeps quoted line breaks intact but reads each file in one task; switch it
    off for very large files without such breaks and they are split. ``"split"`` does both,
    at the price of counting quotes in a first pass over the files.
    """
    if multiline == "split":
        return scan_records(spark, path, columns)
    inference = "spark.sql.sources.partitionColumnTypeInference.enabled"
    before = spark.conf.get(inference)
    spark.conf.set(inference, "false")
    try:
        raw = spark.read.csv(
            path,
            header=True,
            inferSchema=False,
            enforceSchema=False,
            multiLine=multiline,
            quote='"',
            escape='"',
        )
    finally:
        spark.conf.set(inference, before)
    if not raw.columns:
        raise ValueError(f"CSV has no header: {path}")
    missing = [c for c in columns if c not in raw.columns]
    if missing:
        raise ValueError(f"CSV lacks columns {missing}: {path}")
    key = ["run_id"] if "run_id" in raw.columns else []
    return raw.select(*key, *columns, F.monotonically_increasing_id().alias("seq"))


def typed(cells: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Convert text cells; ``bad_cells`` lists the columns that could not be read."""
    plain = F.concat_ws(",", *[name for name, kind in columns.items() if kind != "string"]).rlike(PLAIN_CELLS)
    values = F.struct(*[_typed(name, kind, plain).alias(name) for name, kind in columns.items()])
    others = [c for c in cells.columns if c not in columns]
    # A generator of one row: a filter on the values is not pushed below it, where it would cast every cell again.
    rows = cells.select(*others, values.alias("_values")).select(*others, F.inline(F.array("_values")))
    missing = [F.col(name).isNull() for name in columns]
    names = F.array(*[F.when(none, F.lit(name)) for name, none in zip(columns, missing)])
    bad = F.when(F.greatest(F.lit(False), *missing), F.array_compact(names)).otherwise(F.array().cast("array<string>"))
    return rows.select("*", bad.alias("bad_cells"))


def all_good(rows: DataFrame) -> DataFrame:
    """Fail the whole load on the first unreadable row."""
    message = F.concat(F.lit("unreadable CSV cells: "), F.concat_ws(", ", "bad_cells"))
    good = F.when(F.size("bad_cells") == 0, True).otherwise(
        F.raise_error(message).cast("boolean")
    )
    return rows.where(good).drop("bad_cells")


def quarantine(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Readable rows and unreadable rows."""
    return rows.where(F.size("bad_cells") == 0).drop("bad_cells"), rows.where(
        F.size("bad_cells") > 0
    )


def _read(spark, path, columns, run_id, multiline) -> DataFrame:
    rows = all_good(typed(scan_text(spark, path, columns, multiline), columns))
    return rows if run_id is None else rows.withColumn("run_id", F.lit(run_id))


def read_observations(
    spark: SparkSession, path: str, run_id: str | None = None, multiline: bool | str = True
) -> DataFrame:
    """Observation CSV; ``seq`` keeps the file order for ties."""
    return _read(spark, path, OBSERVATION_COLUMNS, run_id, multiline)


def read_summaries(
    spark: SparkSession, path: str, run_id: str | None = None, multiline: bool | str = True
) -> DataFrame:
    """Track-summary CSV."""
    return _read(spark, path, SUMMARY_COLUMNS, run_id, multiline).drop("seq")


def read_evaluated(
    spark: SparkSession, path: str, run_id: str | None = None, multiline: bool | str = True
) -> DataFrame:
    """Evaluated-track CSV."""
    return _read(spark, path, EVALUATED_COLUMNS, run_id, multiline).drop("seq")


def _write(rows: DataFrame, path: str, columns: dict[str, str], order: str, ties: list[str], folders: bool) -> int:
    counted = Observation()
    keys = ["run_id"] if "run_id" in rows.columns else []
    # Range partitions cut through a very large run and keep each run's rows in order;
    # rows of one frame or track stay together, so their order survives in one file.
    placed = rows.repartitionByRange(*keys, order).sortWithinPartitions(*keys, order, *ties)
    counting = placed.select(*keys, *columns).observe(counted, F.count(F.lit(1)).alias("rows"))
    writer = counting.write
    if keys and folders:
        writer = writer.partitionBy(*keys)
    writer.csv(path, header=True, mode="overwrite", quote='"', escape='"', emptyValue="")
    return counted.get["rows"]


def write_observations(rows: DataFrame, path: str, folders: bool = False) -> int:
    """Observation CSV in run and frame order; returns the number of rows.

    Boxes of a frame follow ``seq``, and equal ones the order the summary uses. Files hold many runs, with
    ``run_id`` as their first column, so their number follows the bytes. ``folders`` writes a
    ``run_id=...`` folder per run instead, for a few runs: each costs a folder and a file.
    """
    ties = [c for c in ("seq", "timestamp_seconds", "center_x", "center_y") if c in rows.columns]
    return _write(rows, path, OBSERVATION_COLUMNS, "frame_number", ties, folders)


def write_summaries(rows: DataFrame, path: str, folders: bool = False) -> int:
    """Track-summary CSV in run and track order, with files as ``write_observations``; returns the number of rows."""
    return _write(rows, path, SUMMARY_COLUMNS, "track_id", [], folders)


def write_evaluated(rows: DataFrame, path: str, folders: bool = False) -> int:
    """Evaluated-track CSV in run and track order, with files as ``write_observations``; returns the number of rows."""
    return _write(rows, path, EVALUATED_COLUMNS, "track_id", [], folders)


def is_missing(error: AnalysisException) -> bool:
    """Whether a scan failed because its path does not exist."""
    return "PATH_NOT_FOUND" in str(error)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path can be scanned."""
    try:
        spark.read.format("binaryFile").load(path)
    except AnalysisException as error:
        if is_missing(error):
            return False
        raise
    return True
