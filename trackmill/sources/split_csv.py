"""CSV with line breaks in quotes, one large file read by many tasks.

Whether a line begins inside quotes depends on every quote before it in the file. Each split counts its own
quotes and says what it would hold if it began outside, and if it began inside; a prefix over the splits of a file, one
row each, tells which is true. Lines that are whole records stay where they were read; only the
lines of records with breaks meet to be joined.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_MARKS = "index long, odd int, inside int, opens_out long, opens_in long"
INFERENCE = "spark.sql.sources.partitionColumnTypeInference.enabled"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their file, the first byte of their split and, in ``run_id=...`` folders, the run."""
    before = spark.conf.get(INFERENCE)
    spark.conf.set(INFERENCE, "false")
    try:
        lines = spark.read.option("lineSep", "\n").text(path)
    finally:
        spark.conf.set(INFERENCE, before)
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")]
    run = F.col("run_id") if "run_id" in lines.columns else F.lit(None).cast("string").alias("run_id")
    return lines.select(*place, run, "value")


def _marked(lines: DataFrame) -> DataFrame:
    """Lines with their number in the split and, were the split to begin outside quotes, whether they begin inside.

    ``opens_out`` and ``opens_in``: records with breaks that begin in the split up to this line, if
    the split begins outside or inside.
    """

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, state = None, [0, 0, 0, 0]
        for batch in batches:
            odd = np.asarray(pc.count_substring(batch.column("value"), '"')) % 2
            files, blocks = batch.column("file").to_pylist(), batch.column("block").to_pylist()
            edges = [i for i in range(1, len(files)) if files[i] != files[i - 1] or blocks[i] != blocks[i - 1]]
            out: list[list[np.ndarray]] = []
            for first, end in zip([0, *edges], [*edges, len(files)]):
                if first == end:
                    continue
                if place != (files[first], blocks[first]):
                    place, state = (files[first], blocks[first]), [0, 0, 0, 0]
                mine = odd[first:end]
                inside = (np.cumsum(mine) - mine + state[1]) % 2
                outs = state[2] + np.cumsum((inside == 0) & (mine == 1))
                ins = state[3] + np.cumsum((inside == 1) & (mine == 1))
                out.append([state[0] + np.arange(end - first), mine, inside, outs, ins])
                state = [state[0] + end - first, int(inside[-1] + mine[-1]) % 2, int(outs[-1]), int(ins[-1])]
            if out:
                marks = [pa.array(np.concatenate(x), t) for x, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()))]
                yield pa.RecordBatch.from_arrays([*batch.columns, *marks], [*batch.schema.names, *[f.split()[0] for f in _MARKS.split(", ")]])

    return lines.mapInArrow(mark, f"file string, block long, run_id string, value string, {_MARKS}")


def records(spark: SparkSession, path: str) -> DataFrame:
    """All records as text: file, run_id, seq (rises with the place in the file), record.

    Lines end in a line feed, with or without a carriage return before it. A quote that is
    never closed makes one record of the rest of its file. Empty lines are no records.
    """
    marked = _marked(_lines(spark, path))
    splits = marked.groupBy("file", "block").agg(
        F.sum("odd").alias("quotes"), F.max("opens_out").alias("outs"), F.max("opens_in").alias("ins")
    )
    earlier = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    splits = splits.withColumn("begins", F.coalesce(F.sum("quotes").over(earlier), F.lit(0)) % 2)
    opened = F.sum(F.when(F.col("begins") == 0, F.col("outs")).otherwise(F.col("ins"))).over(earlier)
    splits = splits.select("file", "block", "begins", F.coalesce(opened, F.lit(0)).alias("before"))
    placed = marked.join(splits, ["file", "block"])
    inside = (F.col("inside") + F.col("begins")) % 2
    number = F.col("before") + F.when(F.col("begins") == 0, F.col("opens_out")).otherwise(F.col("opens_in"))
    placed = placed.select("file", "run_id", (F.col("block") + F.col("index")).alias("seq"), "value", inside.alias("inside"), "odd", number.alias("number"))
    alone = (F.col("inside") == 0) & (F.col("odd") == 0)
    whole = placed.where(alone).select("file", "run_id", "seq", F.col("value").alias("record"))
    parts = placed.where(~alone).groupBy("file", "run_id", "number").agg(F.array_sort(F.collect_list(F.struct("seq", "value"))).alias("parts"))
    text = F.array_join(F.transform("parts", lambda p: p["value"]), "\n")
    joined = parts.select("file", "run_id", F.get("parts", F.lit(0))["seq"].alias("seq"), text.alias("record"))
    found = whole.unionByName(joined)
    return found.withColumn("record", F.regexp_replace("record", r"\r\z", "")).where("record <> ''")


def scan_records(spark: SparkSession, path: str, columns: dict[str, str]) -> DataFrame:
    """Wanted cells as text, by header name, with run_id (a column or ``run_id=...`` folders) and seq.

    Every file must have the header of the first one.
    """
    head = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', enforceSchema=False)
    names = [c for c in head.columns if c != "run_id" or "run_id=" not in head.inputFiles()[0]]
    if not names:
        raise ValueError(f"CSV has no header: {path}")
    missing = [c for c in columns if c not in names]
    if missing:
        raise ValueError(f"CSV lacks columns {missing}: {path}")
    schema = ", ".join(f"_{i} string" for i in range(len(names)))
    # Every file's first record has number 0: its first split begins the file.
    cells = F.from_csv("record", F.lit(schema), {"quote": '"', "escape": '"', "multiLine": "true"})
    rows = records(spark, path).withColumn("c", cells)
    first = F.array(*[F.regexp_replace(F.col(f"c._{i}"), r"^\x{FEFF}", "") for i in range(len(names))])
    same = first == F.array(*[F.lit(n) for n in names])
    wrong = F.raise_error(F.concat(F.lit("CSV header differs: "), "file")).cast("boolean")
    kept = F.when(F.col("seq") > 0, True).when(same, False).otherwise(wrong)
    picked = [F.col(f"c._{names.index(c)}").alias(c) for c in columns]
    run = ["run_id"] if "run_id" in head.columns else []
    if "run_id" in names:
        run = [F.col(f"c._{names.index('run_id')}").alias("run_id")] if "run_id" not in columns else []
    return rows.where(kept).select(*run, *picked, "seq")
