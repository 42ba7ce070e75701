"""Operator 7: repeated passages by content-defined chunks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import BYTE_VALUES, pieces, prefix_hash, span_hash, stored

#: A cut follows a byte at which so many bits of the gear hash are zero, SMALLEST bytes after the last cut at the earliest.
BITS = 5
SMALLEST, LARGEST = 16, 256
#: Repeated passages below so many bytes stay, but for copies of whole documents.
LEAST_RUN = 96
#: Bytes around a run that are compared at first; where all are equal, WIDER times as many are next.
CONTEXT = 256
WIDER = 64
#: The hash sees this many bytes.
REACH = 16

_GEAR = np.random.default_rng(7).integers(0, 1 << 16, 256, dtype=np.uint16)
_SECOND = BYTE_VALUES[::-1].copy()


def gear(raw: np.ndarray) -> np.ndarray:
    """Rolling gear hash: h = 2h + gear[byte] modulo 2^16, by doubling the window four times."""
    h = _GEAR[raw]
    for width in (1, 2, 4, 8):
        shifted = np.zeros_like(h)
        shifted[width:] = h[:-width] << np.uint16(width) if width < len(h) else 0
        h = h + shifted
    return h


def cuts(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends of all chunks and the number of chunks before each row. A row without bytes has no chunk."""
    candidates = np.flatnonzero(gear(raw) >> np.uint16(16 - BITS) == 0) + 1
    at = np.searchsorted(candidates, offsets)
    ends: list[int] = []
    counts = [0]
    for i in range(len(offsets) - 1):
        last, stop = int(offsets[i]), int(offsets[i + 1])
        for c in candidates[at[i] : at[i + 1]].tolist():
            while c - last > LARGEST:
                last += LARGEST
                ends.append(last)
            if c - last >= SMALLEST:
                last = c
                ends.append(c)
        while stop > last:
            last = min(stop, last + LARGEST)
            ends.append(last)
        counts.append(len(ends))
    return np.array(ends, np.int64), np.array(counts)


def chunk(documents: DataFrame) -> DataFrame:
    """doc_id, start, length and a 128-bit digest of every chunk."""
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, raw, offsets in pieces(batch):
                ends, counts = cuts(raw, offsets)
                row = np.repeat(np.arange(end - first), np.diff(counts))
                starts = np.concatenate(([0], ends[:-1])) if len(ends) else ends
                one = span_hash(prefix_hash(BYTE_VALUES[raw]), starts, ends)
                two = span_hash(prefix_hash(_SECOND[raw]), starts, ends)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(first, end - first).take(pa.array(row)),
                        pa.array((starts - offsets[row]).astype(np.int32)),
                        pa.array((ends - starts).astype(np.int32)),
                        pa.array(one.view(np.int64)),
                        pa.array(two.view(np.int64)),
                    ],
                    ["doc_id", "start", "length", "digest_a", "digest_b"],
                )

    schema = f"doc_id {kind}, start int, length int, digest_a long, digest_b long"
    return documents.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def repeated_spans(documents: DataFrame, least_run: int = LEAST_RUN, short_copies: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and spans of every document.

    A chunk is repeated if an equal one stands before it, in the same document or in one with a
    smaller id; the first of all stays. Runs of adjacent repeated chunks grow byte by byte at both
    ends as far as the text around the kept chunk is the same. ``spans``: such passages of
    ``least_run`` bytes or more, as (start, length) in UTF-8 bytes; with ``short_copies``, as in
    query op7, also shorter documents whole that equal one with a smaller id.

    Counts are combined before the shuffle, so a chunk that a third of all documents share is one
    row per task; only digests found twice are joined back. Null and empty texts have zero bytes
    and no spans. Rows with the same id are one document: equal rows repeat nothing. Null ids sort first.
    Other columns are not read.
    """
    rows = chunk(documents)
    digest = ["digest_a", "digest_b"]
    firsts = rows.groupBy(*digest).agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "start")).alias("kept")
    )
    firsts = firsts.filter("n > 1").select(*digest, "kept")
    later = rows.join(firsts, digest).filter(
        ~(F.col("doc_id").eqNullSafe(F.col("kept.doc_id")) & (F.col("start") == F.col("kept.start")))
    )
    kept = (F.col("kept.doc_id").alias("kept_id"), F.col("kept.start").alias("kept_at"))
    found = later.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("start", "length", *kept))).alias("found"))
    runs = stored(found.select("doc_id", _runs(F.col("found")).alias("runs")), "runs")
    ends = _grown(documents, runs).groupBy("doc_id", "left", "at").agg(F.min("grown").alias("grown"))
    sides = [F.collect_list(F.when(c, F.struct("at", "grown"))).alias(n) for n, c in (("lefts", F.col("left")), ("rights", ~F.col("left")))]
    ends = ends.groupBy(F.col("doc_id").alias("grown_id")).agg(*sides)
    wide = runs.join(ends, runs["doc_id"].eqNullSafe(ends["grown_id"]), "left")
    lefts, rights = (F.coalesce(F.map_from_entries(n), F.create_map().cast("map<int,int>")) for n in ("lefts", "rights"))
    wide = wide.select("doc_id", "runs", lefts.alias("lefts"), rights.alias("rights"))

    def passage(x: Column) -> Column:
        end = x["start"] + x["length"]
        before, after = (F.coalesce(F.try_element_at(F.col(n), at), F.lit(0)) for n, at in (("lefts", x["start"]), ("rights", end)))
        return F.struct((x["start"] - before).alias("start"), (x["length"] + before + after).alias("length"))

    passages = F.filter(F.transform("runs", passage), lambda x: x["length"] >= least_run)
    long = wide.select("doc_id", _apart(F.array_sort(passages), least_run).alias("spans"))
    whole = F.array(F.struct(F.lit(0).alias("start"), F.col("size").alias("length")))
    spans = long.unionByName(_short_copies(documents, least_run).select("doc_id", whole.alias("spans"))) if short_copies else long
    runs = spans.groupBy("doc_id").agg(_apart(F.array_sort(F.flatten(F.collect_list("spans"))), least_run).alias("spans"))
    sizes = documents.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    named = runs.select(F.col("doc_id").alias("own_id"), "spans")
    joined = sizes.join(named, sizes["doc_id"].eqNullSafe(named["own_id"]), "left")
    spans = F.coalesce("spans", F.array().cast("array<struct<start:int,length:int>>"))
    zero = F.lit(0).cast("long")
    return joined.withColumn("spans", spans).select(
        "doc_id",
        "n_bytes",
        F.aggregate("spans", zero, lambda s, x: s + x["length"]).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        "spans",
    )


def _runs(found: Column) -> Column:
    """Adjacent chunks merged to runs, with the kept places of their two ends. At most one document's chunks."""
    names = ("start", "length", "left_id", "left_at", "right_id", "right_at")

    def run(*values: Column) -> Column:
        return F.struct(*[v.alias(n) for n, v in zip(names, values, strict=True)])

    def step(runs: Column, x: Column) -> Column:
        last = F.get(runs, F.size(runs) - 1)
        end = x["kept_at"] + x["length"]
        begun = F.array(run(x["start"], x["length"], x["kept_id"], x["kept_at"], x["kept_id"], end))
        longer = run(last["start"], last["length"] + x["length"], last["left_id"], last["left_at"], x["kept_id"], end)
        joins = F.coalesce(last["start"] + last["length"] == x["start"], F.lit(False))
        return F.when(joins, F.concat(F.slice(runs, 1, F.size(runs) - 1), F.array(longer))).otherwise(F.concat(runs, begun))

    first = F.get(found, 0)
    none = F.slice(F.array(run(first["start"], first["length"], first["kept_id"], first["kept_at"], first["kept_id"], first["kept_at"])), 1, 0)
    return F.aggregate(found, none, step)


def _apart(found: Column, least: int) -> Column:
    """Sorted spans without common bytes: the later one is cut, or one with the former if too little of it is left. At most one document's."""

    def span(start: Column, end: Column) -> Column:
        return F.array(F.struct(start.alias("start"), (end - start).alias("length")))

    def step(spans: Column, x: Column) -> Column:
        last = F.get(spans, F.size(spans) - 1)
        last_end, end = F.coalesce(last["start"] + last["length"], F.lit(0)), x["start"] + x["length"]
        start = F.greatest(last_end, x["start"])
        one = (x["start"] < last_end) & (end - start < least)
        longer = F.concat(F.slice(spans, 1, F.size(spans) - 1), span(last["start"], F.greatest(last_end, end)))
        return F.when(one, longer).otherwise(F.concat(spans, span(start, end)))

    return F.aggregate(found, F.array().cast("array<struct<start:int,length:int>>"), step)


def _short_copies(documents: DataFrame, least: int) -> DataFrame:
    """doc_id and size of documents below ``least`` bytes whose text a smaller id has too."""
    text = F.col("text").cast("string").alias("text")
    short = documents.select("doc_id", text).filter((F.octet_length("text") > 0) & (F.octet_length("text") < least))
    first = short.groupBy("text").agg(F.min(F.struct("doc_id")).alias("kept"), F.count(F.lit(1)).alias("n"))
    copies = short.join(first.filter("n > 1"), "text").filter(~F.col("doc_id").eqNullSafe(F.col("kept.doc_id")))
    return copies.select("doc_id", F.octet_length("text").alias("size")).distinct()


def _grown(documents: DataFrame, runs: DataFrame) -> DataFrame:
    """doc_id, left, at and grown: by how many bytes each run grows at its ends, up to its neighbours.

    Only the bytes around the ends and around their kept places leave the documents. Of several texts with one
    id, all are compared and the least growth counts.
    """
    rest = runs.select("doc_id", F.posexplode("runs").alias("i", "run"), "runs")
    before, after = F.get("runs", F.col("i") - 1), F.get("runs", F.col("i") + 1)
    end = F.col("run.start") + F.col("run.length")
    most = F.lit(2**31 - 1)
    left = F.struct(
        F.lit(True).alias("left"),
        F.col("run.start").alias("at"),
        F.least(F.col("run.start") - F.coalesce(before["start"] + before["length"], F.lit(0)), F.col("run.left_at")).alias("room"),
        F.col("run.left_id").alias("kept_id"),
        F.col("run.left_at").alias("kept_at"),
    )
    right = F.struct(
        F.lit(False).alias("left"),
        end.alias("at"),
        F.coalesce(after["start"] - end, most).alias("room"),
        F.col("run.right_id").alias("kept_id"),
        F.col("run.right_at").alias("kept_at"),
    )
    edges = rest.select("doc_id", F.explode(F.array(left, right)).alias("edge")).select("doc_id", "edge.*").filter("room > 0")
    kind = documents.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, left boolean, at int, room int, kept_id {kind}, kept_at int, grown int"
    names = ["doc_id", "left", "at", "room", "kept_id", "kept_at"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(n).to_pylist() for n in ("left", "room", "own", "kept")]
            grown = [min(common(a, b, x, room) for a in own for b in kept) for x, room, own, kept in zip(*columns, strict=True)]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(grown, pa.int32())], [*names, "grown"])

    done, reach = None, CONTEXT
    while True:
        places = edges.select("doc_id", "at", "left").unionByName(edges.select(F.col("kept_id").alias("doc_id"), F.col("kept_at").alias("at"), "left"))
        places = places.groupBy("doc_id").agg(F.collect_set(F.struct("at", "left")).alias("places")).withColumnRenamed("doc_id", "place_id")
        data = documents.select("doc_id", F.col("text").cast("string").cast("binary").alias("data"))
        cut = F.expr(
            f"transform(places, p -> struct(p.at, p.left, substring(data, if(p.left, greatest(p.at - {reach}, 0), p.at) + 1, "
            f"if(p.left, least(p.at, {reach}), {reach})) as bytes))"
        )
        joined = data.join(places, data["doc_id"].eqNullSafe(places["place_id"]))
        bytes_at = joined.select("place_id", F.explode(cut).alias("p")).groupBy("place_id", F.col("p.at").alias("place_at"), F.col("p.left").alias("place_left"))
        bytes_at = stored(bytes_at.agg(F.collect_set("p.bytes").alias("bytes")), "ends")
        own = bytes_at.withColumnRenamed("bytes", "own")
        near = edges.join(own, edges["doc_id"].eqNullSafe(own["place_id"]) & (edges["at"] == own["place_at"]) & (edges["left"] == own["place_left"]))
        near = near.select(*[edges[n] for n in names], "own").filter("exists(own, x -> octet_length(x) > 0)")
        kept = bytes_at.withColumnRenamed("bytes", "kept")
        near = near.join(kept, near["kept_id"].eqNullSafe(kept["place_id"]) & (near["kept_at"] == kept["place_at"]) & (near["left"] == kept["place_left"]))
        found = stored(near.select(*names, "own", "kept").mapInArrow(compare, schema), "grown")
        more = (F.col("grown") >= reach) & (F.col("room") > reach)
        part = found.filter(~more & (F.col("grown") > 0))
        done = part if done is None else done.unionByName(part)
        if reach == 2**31 - 1 or not found.filter(more).limit(1).count():
            break
        edges = found.filter(more).drop("grown")
        reach = min(reach * WIDER, 2**31 - 1)
    return done.select("doc_id", "left", "at", "grown")


def common(a: bytes, b: bytes, left: bool, room: int) -> int:
    """Equal bytes at the ends (``left``) or beginnings of a and b, at most ``room``."""
    n = min(len(a), len(b), room)
    if n == 0:
        return 0
    x, y = (np.frombuffer(t[len(t) - n :] if left else t[:n], np.uint8) for t in (a, b))
    other = np.flatnonzero(x != y)
    return n if not len(other) else int(n - 1 - other[-1] if left else other[0])


def documents_to_repeats(documents: DataFrame) -> DataFrame:
    """Query op7."""
    return repeated_spans(documents, short_copies=True)
