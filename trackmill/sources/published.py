"""Sharded tables that change together: versions are written first, one small file then makes them current.

Every change writes the shards it touches, whole, below a new version folder. What is current is a
list of (table, shard, version), and a change of any number of tables becomes visible when the
one file with the next list appears, which a file system does wholly or not at all. A failure
before that leaves the former list, and with it all tables as they were; what was written is never
read. Readers keep the list they began with. One writer at a time: a list that another
writer has published meanwhile is an error and not overwritten.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackmill.schemas import ddl
from trackmill.sources.csv_tables import exists

SHARD = "run_shard"
_LIST = "sequence bigint, name string, shard bigint, version string"
Current = dict[tuple[str, int], str]


def current(spark: SparkSession, root: str) -> tuple[int, Current]:
    """Number of the newest list (0 before the first) and the version of every shard that has rows."""
    if not exists(spark, f"{root}/published"):
        return 0, {}
    lists = spark.read.schema(_LIST).parquet(f"{root}/published")
    newest = lists.agg(F.max("sequence").alias("sequence")).first().sequence
    if newest is None:
        return 0, {}
    rows = lists.where(F.col("sequence") == newest).collect()  # a row for each table and shard
    return newest, {(r.name, r.shard): r.version for r in rows if r.version is not None}


def read(spark: SparkSession, root: str, name: str, columns: dict[str, str], shards: list[int] | None = None) -> DataFrame:
    """Current rows of a table with their shard; ``shards`` restricts the folders that are opened."""
    _, versions = current(spark, root)
    wanted = sorted((s, v) for (n, s), v in versions.items() if n == name and (shards is None or s in shards))
    schema = ddl(columns | {SHARD: "bigint"})
    if not wanted:
        return spark.createDataFrame([], schema)
    paths = [f"{root}/{name}/version={version}/{SHARD}={shard}" for shard, version in wanted]
    found = spark.read.schema(schema + ", version string").option("basePath", f"{root}/{name}").parquet(*paths)
    return found.drop("version")


def publish(spark: SparkSession, root: str, changes: dict[str, DataFrame], touched: list[int], sort: str) -> None:
    """Replace the touched shards of several tables at once.

    ``changes``: all rows of the touched shards of each table, with their shard; a shard without
    rows becomes empty. Large shards are split over tasks.
    """
    before, versions = current(spark, root)
    version = uuid.uuid4().hex
    fresh = {(n, s): v for (n, s), v in versions.items() if n not in changes or s not in touched}
    for name, rows in changes.items():
        for shard in _write(spark, rows, f"{root}/{name}/version={version}", sort):
            fresh[name, shard] = version
    now, _ = current(spark, root)
    if now != before:
        raise RuntimeError(f"{root} was changed by another writer (list {now} after {before})")
    lines = [(before + 1, n, s, v) for (n, s), v in sorted(fresh.items())] or [(before + 1, "", 0, None)]
    spark.createDataFrame(lines, _LIST).coalesce(1).write.mode("append").parquet(f"{root}/published")


def _write(spark: SparkSession, rows: DataFrame, path: str, sort: str) -> list[int]:
    """Write one table's shards; the shards that have rows."""
    ordered = rows.hint("rebalance", SHARD).sortWithinPartitions(SHARD, sort)
    ordered.write.partitionBy(SHARD).parquet(path)
    written = spark.read.schema(f"{sort} string, {SHARD} bigint").parquet(path)
    return [r[0] for r in written.select(SHARD).distinct().collect()]
