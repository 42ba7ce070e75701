"""Joins whose hot keys are found by counting and dealt over many tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is hot from this part of one shuffle partition's fair share of the rows.
SHARE = 16


def hot_keys(rows: DataFrame, key: str, partitions: int | None = None) -> DataFrame:
    """Keys that hold more than 1 / (SHARE * partitions) of all rows: key, salts.

    Fewer than SHARE * partitions keys can do so, whatever the size of the data, so the result
    may be broadcast. ``salts`` tasks of a hot key get about that many rows each. Rows
    are counted map-side; a null key joins nothing and is never hot.
    """
    partitions = partitions or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
    total = F.coalesce(counts.agg(F.sum("n").alias("total")).scalar(), F.lit(0))
    fair = F.greatest(F.ceil(total / (SHARE * partitions)), F.lit(1))
    return counts.where(F.col("n") > fair).select(key, F.ceil(F.col("n") / fair).cast("int").alias("salts"))


def salted_join(
    rows: DataFrame, facts: DataFrame, key: str, *spread: str | Column, counted: DataFrame | None = None
) -> DataFrame:
    """Inner join of many rows with one row of facts per key; hot keys are split.

    A row of a hot key gets a number below the key's ``salts`` from a hash of the ``spread``
    columns, which should tell its rows apart; the facts of hot keys, and of no others, are
    repeated once for each number. Other keys join as they are. The result has the
    columns of ``rows`` and those of ``facts`` without the key. ``counted``: rows to count
    instead, where the same keys stand without what ``rows`` has gathered on the way.
    """
    hot = F.broadcast(hot_keys(rows if counted is None else counted, key).withColumnRenamed(key, "_hot"))
    salts = F.coalesce("salts", F.lit(1))
    marked = rows.join(hot, F.col(key) == F.col("_hot"), "left")
    salted = marked.withColumn("_salt", F.pmod(F.xxhash64(*spread), salts).cast("int")).drop("_hot", "salts")
    known = facts.join(hot, F.col(key) == F.col("_hot"), "left")
    numbers = F.explode(F.sequence(F.lit(0), salts - 1)).alias("_salt")
    repeated = known.select(*facts.columns, numbers)
    return salted.join(repeated, [key, "_salt"]).select(*rows.columns, *[c for c in facts.columns if c != key])
