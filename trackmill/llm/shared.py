"""What several operators need: cut points of the plan, reading tables, byte-level numpy helpers."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..session import new_path, shared_folder

#: ASCII white space: blank and \t \n \v \f \r.
BLANKS = (9, 10, 11, 12, 13, 32)
#: Hashes are pairs of polynomials modulo this prime, in these two bases.
PRIME = (1 << 31) - 1
BASES = (1_183_477_331, 1_774_099_057)
#: A fixed random 64-bit value for each byte.
BYTE_VALUES = np.random.default_rng(20_240_601).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Rows of texts that are handed to Python at once: the buffers for 10,000, Spark's default, weigh on an executor's memory.
BATCH_ROWS = 1_000
#: Values that are hashed at once, so that what lies between stays in the cache.
STEP = 1 << 14
_LOW, _HALF = np.uint64(PRIME), np.uint64(31)
_powers: dict[int, np.ndarray] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def settle(frame: DataFrame) -> DataFrame:
    """Compute once and cut the lineage with a reliable checkpoint in the shared folder."""
    context = frame.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(frame.sparkSession))
    return frame.checkpoint()


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Hand rows to Python in batches of BATCH_ROWS at most while jobs run inside. Results don't depend on it."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    if not 0 < int(before) <= BATCH_ROWS:  # zero or less: no bound
        spark.conf.set(name, str(BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def stored(frame: DataFrame, purpose: str) -> DataFrame:
    """Compute once, write Parquet to the shared folder and read it back: compressed, and Spark knows its size."""
    path = new_path(frame.sparkSession, purpose)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def pieces(batch: pa.RecordBatch, column: str = "text", limit: int = 1 << 18) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices of a batch with about ``limit`` text bytes each: first row, end row, bytes, row offsets. Null is empty."""
    texts = batch.column(column)
    texts = texts.cast(pa.large_binary()) if not pa.types.is_large_binary(texts.type) else texts
    n = len(texts)
    if n == 0:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64, n + 1, texts.offset * 8)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1)
        end = min(end, n)
        yield first, end, raw[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def powers(base: int, n: int) -> np.ndarray:
    """base^i modulo PRIME for i below n."""
    known = _powers.get(base, np.ones(1, np.uint32))
    while len(known) < n:
        step = np.uint64(pow(base, len(known), PRIME))
        known = np.concatenate((known, _reduced(known * step).astype(np.uint32)))
    _powers[base] = known
    return known[:n]


def _fold(x: np.ndarray, spare: np.ndarray) -> None:
    """x to a smaller value that is equal modulo PRIME: from 64 bits to 34, from 62 to 32, from 34 to PRIME + 8 at most."""
    np.right_shift(x, _HALF, out=spare)
    np.bitwise_and(x, _LOW, out=x)
    np.add(x, spare, out=x)


def _reduced(x: np.ndarray) -> np.ndarray:
    """x modulo PRIME, for any 64-bit x, which is overwritten."""
    spare = np.empty_like(x)
    _fold(x, spare)
    _fold(x, spare)
    np.subtract(x, _LOW, out=x, where=x >= _LOW)
    return x


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """Prefix sums of values times base^i modulo PRIME, starting with 0: a row for each base, which sees its half of the values' bits."""
    out = np.zeros((len(BASES), len(values) + 1), np.uint32)
    for row, base in enumerate(BASES):
        power, carry = powers(base, len(values)), np.uint64(0)
        for at in range(0, len(values), STEP):
            x = values[at : at + STEP] >> np.uint64(32 * row)
            spare = np.empty_like(x)
            np.bitwise_and(x, _LOW, out=x)
            np.multiply(x, power[at : at + STEP], out=x)
            _fold(x, spare)
            x[0] += carry
            np.cumsum(x, out=x)
            _fold(x, spare)
            _fold(x, spare)
            out[row, at + 1 : at + 1 + len(x)] = x
            carry = x[-1]
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each span [start, end): equal content gives equal values, wherever it stands.

    A prime modulus, as modulo 2^64 some words collide in every base (Thue and Morse's and its complement).
    """
    out = np.empty(len(starts), np.uint64)
    inverse = [powers(pow(base, -1, PRIME), prefix.shape[1]) for base in BASES]
    for at in range(0, len(starts), STEP):
        first, end = starts[at : at + STEP], ends[at : at + STEP]
        found = []
        for row, power in enumerate(inverse):
            x = prefix[row][end].astype(np.uint64)
            x += np.uint64(2 * PRIME)
            x -= prefix[row][first]
            spare = np.empty_like(x)
            _fold(x, spare)
            x *= power[first]
            found.append(_reduced(x))
        out[at : at + STEP] = mix(mix(found[0] | found[1] << _HALF) + (end - first).astype(np.uint64))
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over the 64 output bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_IS_BLANK = np.zeros(256, bool)
_IS_BLANK[list(BLANKS)] = True


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words `[^\\x20\\x09-\\x0D]+` and the number of words before each row."""
    if len(raw) == 0:
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(len(offsets), np.int64)
    solid = ~_IS_BLANK[raw]
    before = np.empty(len(raw), bool)
    before[0] = False
    before[1:] = solid[:-1]
    edge = offsets[:-1][offsets[:-1] < len(raw)]
    before[edge] = False
    starts = np.flatnonzero(solid & ~before)
    after = np.empty(len(raw), bool)
    after[-1] = False
    after[:-1] = solid[1:]
    after[edge[edge > 0] - 1] = False
    ends = np.flatnonzero(solid & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def shingles(word_hashes: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word windows of each row, and the row bounds. A shorter row is one window of all its words.

    ``counts``: number of words before each row, as ``words`` returns them.
    """
    n = np.diff(counts)
    sizes = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    at = np.arange(bounds[-1]) - np.repeat(bounds[:-1], sizes) + np.repeat(counts[:-1], sizes)
    width = np.repeat(np.minimum(n, k), sizes)
    return span_hash(prefix_hash(word_hashes), at, at + width), bounds


def lowered(raw: np.ndarray) -> np.ndarray:
    """A-Z as a-z, other bytes as they are."""
    return _LOWER[raw]


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
