"""SHA-256 fingerprints of files of any size, read in blocks where Spark runs.

``fingerprint_paths`` fingerprints the files that a table names, absent ones included; ``FileFingerprints`` is a
data source over a folder. Either holds one block of a file at a time, so there is no limit on
its size. A digest is sequential: one file is one task's work, many files spread over all.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fnmatch import fnmatch

import pandas as pd
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes read at a time.
BLOCK = 1 << 20
#: Bytes of small files that one task of the data source reads; a larger file is a task of its own.
TASK_BYTES = 1 << 28
SCHEMA = "path string, exists boolean, size_bytes bigint, sha256 string"

FileSystem = pyarrow.fs.FileSystem
Opener = Callable[[str], tuple[FileSystem, str]]


def open_path(path: str) -> tuple[FileSystem, str]:
    """File system and path of a location: a local path, ``file:``, or any scheme that Arrow knows (s3, gs, hdfs, abfs)."""
    scheme, colon, rest = path.partition(":")
    if colon and scheme == "file":
        return pyarrow.fs.LocalFileSystem(), "/" + rest.lstrip("/")
    if colon and "/" not in scheme:
        return FileSystem.from_uri(path)
    return pyarrow.fs.LocalFileSystem(), path


def digest(system: FileSystem, path: str) -> tuple[int, str]:
    """Size and SHA-256 of a file, block by block."""
    found, size = hashlib.sha256(), 0
    with system.open_input_stream(path, buffer_size=0) as stream:
        while block := stream.read(BLOCK):
            found.update(block)
            size += len(block)
    return size, found.hexdigest()


def fingerprint(path: str | None, opener: Opener = open_path) -> tuple[bool, int | None, str | None]:
    """Whether a regular file stands at a path, its size and SHA-256; a folder or nothing is no file."""
    if not path:
        return False, None, None
    system, inner = opener(path)
    if system.get_file_info(inner).type != pyarrow.fs.FileType.File:
        return False, None, None
    return (True, *digest(system, inner))


def fingerprint_paths(rows: DataFrame, path: str = "path", opener: Opener = open_path) -> DataFrame:
    """``rows`` with exists, size_bytes and sha256 of the file that each row's ``path`` names.

    A path that several rows name is read once. Paths are dealt evenly over the shuffle
    partitions, whatever their rows' order. Null, an empty path, a folder and an absent file give exists
    false and nulls, as a run's record has them; a file that cannot be read fails the query.
    ``opener`` gives the file system of a path, for stores that Arrow does not know by name.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            facts = [(p, *fingerprint(p, opener)) for p in batch["path"]]
            frame = pd.DataFrame(facts, columns=["path", "exists", "size_bytes", "sha256"])
            yield frame.astype({"size_bytes": "Int64"})

    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    named = rows.select(F.col(path).alias("path")).where(F.col("path").isNotNull()).distinct()
    found = named.repartition(partitions, "path").mapInPandas(read, SCHEMA).withColumnRenamed("path", "_path")
    joined = rows.join(found, F.col(path) == F.col("_path"), "left")
    return joined.select(*rows.columns, F.coalesce("exists", F.lit(False)).alias("exists"), "size_bytes", "sha256")


@dataclass
class Files(InputPartition):
    """Files of one task."""

    paths: list[str]


class FileFingerprints(DataSource):
    """``spark.read.format("file_fingerprints").load(folder)``: path, exists, size_bytes, sha256.

    Options: ``glob`` for file names, ``recursive``. Every large file is a partition, small ones
    are packed up to TASK_BYTES. The folder is listed once, sizes only; a missing one is empty.
    """

    @classmethod
    def name(cls) -> str:
        return "file_fingerprints"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return FingerprintReader(self.options)


class FingerprintReader(DataSourceReader):
    def __init__(self, options):
        self.folder = options["path"]
        self.glob = options.get("glob", "*")
        self.recursive = str(options.get("recursive", "false")).lower() == "true"

    def partitions(self) -> list[Files]:
        system, inner = open_path(self.folder)
        selector = pyarrow.fs.FileSelector(inner, allow_not_found=True, recursive=self.recursive)
        prefix = self.folder.removesuffix(inner)
        files = [f for f in system.get_file_info(selector) if f.type == pyarrow.fs.FileType.File and fnmatch(f.base_name, self.glob)]
        packed: list[Files] = []
        room = 0
        for info in sorted(files, key=lambda f: (-f.size, f.path)):
            if info.size > room:
                packed.append(Files([]))
                room = max(TASK_BYTES, info.size)
            packed[-1].paths.append(f"{prefix}{info.path}")
            room -= info.size
        return packed or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        for path in partition.paths:
            yield (path, *fingerprint(path))


def fingerprint_folder(spark: SparkSession, folder: str, glob: str = "*", recursive: bool = False) -> DataFrame:
    """Fingerprints of the files of a folder."""
    spark.dataSource.register(FileFingerprints)
    reader = spark.read.format(FileFingerprints.name()).option("glob", glob).option("recursive", str(recursive))
    return reader.load(folder)
