"""Operator 2: exact Jaccard join of documents on word shingles by pivots and regions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import BYTE_VALUES, lowered, pieces, prefix_hash, shingles, small_batches, span_hash, stored, words

#: Counters of the sketch that orders shingles, and parts in which tasks hand them over.
COUNTERS, PARTS = 1 << 19, 64
#: Members of a block of a region in the second round, and members that are compared with their windows at once.
BLOCK, STEP = 4_096, 256
#: Regions up to this size are compared pair by pair at once.
SMALL = 8
#: Parts of the shingle universe that act as fixed pivots: a set's distances to them are its counts there.
#: COARSE sums of them are compared first.
FACETS, COARSE = 256, 32
#: Rounds of pivots before the rest of a region is compared in blocks.
ROUNDS = 2
#: Up to so many candidate pairs, the ids of their texts (about 60 bytes a row) are broadcast to the scan.
BROADCAST_PAIRS = 40_000


def _shingle_sets(raw: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, and the row bounds."""
    plain = lowered(raw)
    starts, ends, counts = words(plain, offsets)
    hashes, bounds = shingles(span_hash(prefix_hash(BYTE_VALUES[plain]), starts, ends), counts, k)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
    order = np.lexsort((hashes, row))
    hashes, row = hashes[order], row[order]
    new = np.ones(len(order), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])
    hashes, row = hashes[new], row[new]
    return hashes, np.searchsorted(row, np.arange(len(offsets)))


def _set_keys(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return span_hash(prefix_hash(hashes), bounds[:-1], bounds[1:]).view(np.int64)


def _identify(rows: DataFrame, k: int) -> DataFrame:
    """text_key, set_key, set size and counts by facet (a byte each, 255 for more) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, raw, offsets in pieces(batch):
                hashes, bounds = _shingle_sets(raw, offsets, k)
                kept = [batch.column(c).slice(first, end - first) for c in ("doc_id", "text_key")]
                n = np.diff(bounds)
                yield pa.RecordBatch.from_arrays(
                    [
                        *kept,
                        pa.array(_set_keys(hashes, bounds)),
                        pa.array(n.astype(np.int64)),
                        pa.array([c.tobytes() for c in _facets(hashes, n)], pa.binary()),
                    ],
                    ["doc_id", "text_key", "set_key", "n_shingles", "facets"],
                )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, text_key binary, set_key long, n_shingles long, facets binary")


def _facets(hashes: np.ndarray, n: np.ndarray) -> np.ndarray:
    facet = (hashes >> np.uint64(40)) % np.uint64(FACETS)
    cell = np.repeat(np.arange(len(n)), n) * FACETS + facet.astype(np.int64)
    return np.minimum(np.bincount(cell, minlength=len(n) * FACETS), 255).astype(np.uint8).reshape(-1, FACETS)


def _sketch(rows: DataFrame, k: int) -> np.ndarray:
    """How often shingles occur in all rows, in COUNTERS hashed counters: a table of fixed size."""
    width = COUNTERS // PARTS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for _, _, raw, offsets in pieces(batch):
                hashes, _ = _shingle_sets(raw, offsets, k)
                total += np.bincount((hashes % np.uint64(COUNTERS)).astype(np.int64), minlength=COUNTERS)
        parts = [total[i * width : (i + 1) * width].tobytes() for i in range(PARTS)]
        yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array(parts, pa.binary())], ["part", "counts"])

    def add(group: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(c, np.int64) for c in group["counts"])
        return pd.DataFrame({"part": group["part"].iloc[:1], "counts": [total.tobytes()]})

    counted = rows.select("text").mapInArrow(count, "part int, counts binary")
    # Two steps, so that no task adds up more than a share of all tasks' sketches.
    salted = counted.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(32)))
    first = salted.groupBy("part", "salt").applyInPandas(lambda g: add(g[["part", "counts"]]), "part int, counts binary")
    found = first.groupBy("part").applyInPandas(add, "part int, counts binary").collect()
    total = np.zeros(COUNTERS, np.int64)
    for r in found:
        total[r["part"] * width : (r["part"] + 1) * width] = np.frombuffer(r["counts"], np.int64)
    mean = max(1.0, total.mean())
    return np.floor(np.log2(np.maximum(total / mean, 1))).astype(np.uint8)


def _regions(rows: DataFrame, levels: np.ndarray, k: int, num: int, den: int) -> DataFrame:
    """region, set_key, n_shingles: the regions that a document's set falls in."""
    shared = rows.sparkSession.sparkContext.broadcast(levels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = shared.value
        for batch in batches:
            for _, _, raw, offsets in pieces(batch):
                hashes, bounds = _shingle_sets(raw, offsets, k)
                n = np.diff(bounds)
                row = np.repeat(np.arange(len(n)), n)
                order = np.lexsort((hashes, levels[(hashes % np.uint64(COUNTERS)).astype(np.int64)], row))
                place = np.arange(len(row)) - np.repeat(bounds[:-1], n)
                window = n - -(-num * n // den) + 1
                inside = place < window[row]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(hashes[order][inside].view(np.int64)),
                        pa.array(_set_keys(hashes, bounds)[row[inside]]),
                        pa.array(n[row[inside]].astype(np.int32)),
                    ],
                    ["region", "set_key", "n"],
                )

    return rows.select("text").mapInArrow(run, "region long, set_key long, n int")


def _sets(rows: DataFrame, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, raw, offsets in pieces(batch):
                hashes, bounds = _shingle_sets(raw, offsets, k)
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(hashes.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column("set_key").slice(first, end - first), lists], ["set_key", "items"])

    return rows.select("set_key", "text").mapInArrow(run, "set_key long, items array<long>")


def _possible(pairs: DataFrame, known: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs that the facets don't rule out.

    By the triangle inequality the symmetric difference of two sets is at least the sum of
    the differences of their counts in all facets; linked sets differ in
    (den - num) / (den + num) of their summed sizes at most.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("sizes").to_numpy()
            x, p = (_counts(batch.column(c).to_pylist()) for c in ("x_facets", "p_facets"))
            apart = np.abs(x - p).sum(axis=1, dtype=np.int64)
            yield batch.select(["x", "p"]).filter(pa.array((den + num) * apart <= (den - num) * sizes))

    facets = known.groupBy("set_key").agg(F.min(F.struct("n_shingles", "facets")).alias("f"))
    one = facets.select(F.col("set_key").alias("x"), F.col("f.facets").alias("x_facets"), F.col("f.n_shingles").alias("x_n"))
    two = facets.select(F.col("set_key").alias("p"), F.col("f.facets").alias("p_facets"), F.col("f.n_shingles").alias("p_n"))
    wide = pairs.join(one, "x").join(two, "p").select("x", "p", "x_facets", "p_facets", (F.col("x_n") + F.col("p_n")).alias("sizes"))
    return wide.mapInArrow(run, "x long, p long")


def _counts(facets: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(facets), np.uint8).reshape(-1, FACETS).astype(np.int16)


def _windows(members: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs x, p of one region and different classes within all windows of the triangle inequality.

    The windows: sizes, distances ``d`` to the region's pivot (null: unknown), and distances
    to the facets. A region of several blocks is dealt as pairs of blocks, so no task holds more than two.
    """
    limit = 1 - num / den + 1e-9

    def join(group: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        key, label, block = (group[c].to_numpy() for c in ("set_key", "label", "block"))
        n, d = group["n"].to_numpy(np.int64), group["d"].to_numpy(float)
        fine = _counts(group["facets"])
        counts = fine.reshape(len(fine), -1, COARSE).sum(axis=1, dtype=np.int32)
        columns = np.ascontiguousarray(counts.T)
        ends = np.searchsorted(n, den * n // num, side="right")
        xs, ps = [], []
        for at in range(0, len(group), STEP):
            a = slice(at, min(at + STEP, len(group)))
            b = slice(at, ends[a.stop - 1])
            if b.stop - at <= STEP // 4:
                apart = np.abs(counts[a, None] - counts[None, b]).sum(axis=2)
            else:
                apart = np.zeros((a.stop - at, b.stop - at), np.int32)
                for c in columns:
                    apart += np.abs(c[a, None] - c[None, b])
            i, j = np.nonzero((den + num) * apart.astype(np.int64) <= (den - num) * (n[a, None] + n[None, b]))
            i, j = i + at, j + at
            inside = (j > i) & (j < ends[i]) & (label[i] != label[j]) & ~(np.abs(d[i] - d[j]) > limit)
            if block[0] != block.min() or block[0] != block.max():
                inside &= block[i] != block[j]
            i, j = i[inside], j[inside]
            for part in range(0, len(i), BLOCK):
                one, two = i[part : part + BLOCK], j[part : part + BLOCK]
                apart = np.abs(fine[one] - fine[two]).sum(axis=1, dtype=np.int64)
                near = (den + num) * apart <= (den - num) * (n[one] + n[two])
                one, two = key[one[near]], key[two[near]]
                xs.append(np.maximum(one, two))
                ps.append(np.minimum(one, two))
        return np.concatenate([np.zeros(0, np.int64), *xs]), np.concatenate([np.zeros(0, np.int64), *ps])

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["region", "lo", "hi", "n", "set_key"])
        names = group[["region", "lo", "hi"]].to_numpy()
        begins = np.flatnonzero(np.concatenate(([True], (names[1:] != names[:-1]).any(axis=1))))
        found = [join(group.iloc[i:j]) for i, j in zip(begins, [*begins[1:], len(group)], strict=True)]
        x, p = (np.concatenate(c) for c in zip(*found, strict=True))
        return pd.DataFrame({"x": x, "p": p}).drop_duplicates()

    block = members.withColumn("block", F.pmod(F.xxhash64("set_key"), F.col("blocks")).cast("int"))
    dealt = block.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("region", "set_key", "n", "d", "label", "facets", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
    tasks = 1 + (members.agg(F.sum("blocks")).first()[0] or 0) // BLOCK
    dealt = dealt.withColumn("task", F.pmod(F.xxhash64("region", "lo", "hi"), F.lit(tasks)))
    return dealt.groupBy("task").applyInPandas(run, "x long, p long").distinct()


def _measure(pairs: DataFrame, rows: DataFrame, known: DataFrame, k: int) -> DataFrame:
    """The pairs x, p with the size of their intersection and union, from one text of each set."""
    needed = pairs.select(F.col("x").alias("set_key")).union(pairs.select(F.col("p"))).distinct()
    chosen = known.groupBy("set_key").agg(F.min("text_key").alias("text_key")).join(needed, "set_key", "left_semi")
    chosen = F.broadcast(chosen) if pairs.count() <= BROADCAST_PAIRS else chosen
    sets = _sets(rows.select("text_key", "text").join(chosen, "text_key"), k).dropDuplicates(["set_key"])
    one = sets.select(F.col("set_key").alias("x"), F.col("items").alias("x_items"))
    two = sets.select(F.col("set_key").alias("p"), F.col("items").alias("p_items"))
    both = F.size(F.array_intersect("x_items", "p_items"))
    return pairs.join(one, "x").join(two, "p").select(
        "x", "p", both.alias("both"), (F.size("x_items") + F.size("p_items") - both).alias("either")
    )


def classes(links: DataFrame) -> DataFrame:
    """node, label: the smallest node that can be reached over links (x, p).

    Every round gives each node the smallest label around it and then the label of its
    label, so long chains shorten as well.
    """
    both = stored(links.select("x", "p").union(links.select("p", "x")).distinct(), "jaccard")
    labels = stored(both.groupBy("x").agg(F.least(F.min("p"), F.col("x")).alias("label")).select(F.col("x").alias("node"), "label"), "jaccard")
    while True:
        near = both.join(labels, both["p"] == labels["node"]).groupBy("x").agg(F.min("label").alias("near"))
        stepped = labels.join(near, labels["node"] == near["x"]).select("node", F.least("label", "near").alias("new"), F.col("label").alias("old"))
        above = stepped.select(F.col("node").alias("parent"), F.col("new").alias("jump"))
        moved = stored(
            stepped.join(above, stepped["new"] == above["parent"], "left").select(
                "node", F.coalesce("jump", "new").alias("label"), (F.coalesce("jump", "new") != F.col("old")).alias("changed")
            ),
            "jaccard",
        )
        labels = moved.select("node", "label")
        if moved.filter("changed").isEmpty():
            return labels


def components(documents: DataFrame, k: int, num: int, den: int, name: str = "component_id") -> DataFrame:
    """doc_id, n_shingles and ``name`` (smallest doc_id reachable by links) of every row.

    Two documents link when ``den`` * intersection >= ``num`` * union of their sets of
    ``k``-word shingles (A-Z lower-cased); shorter texts are one shingle. No shingle, no link.

    *Regions.* Nearly all pairs of documents have distance 1, so regions around whole
    documents would all overlap. The pivots of the first level are therefore single shingles in a
    fixed order, rare ones first. A document lies in the region of its first shingle, and by the
    triangle inequality for the symmetric difference a linked document can begin
    with a shingle only if at most ``n - ceil(num / den * n)`` shingles stand before it: into
    so many more regions each document is replicated. Linked documents thus meet in a region.
    The order uses a sketch of counts over all documents; any order is exact.

    *Inside.* Equal sets are one member. Members of small regions are compared pair by pair. The pivot of a larger one is its most central member; each set is
    measured against one pivot, the most central of those of its regions. What links is one class with it and needs no comparison with each
    other. A region that still holds several classes gets a second pivot, out of another class than the first. Those that are mixed
    even then are joined in blocks: of members of
    different classes only those meet whose sizes, distances to the pivot and distances to FACETS
    fixed pivots allow a link (triangle inequality). A group of near copies
    costs about one comparison a copy, not one a pair. The number of rounds does not grow with the data.

    Null and empty texts have no shingles and are their own class, as are null ids among
    themselves. Repeated rows and copies share a class. Other columns are not read.
    """
    with small_batches(documents.sparkSession):
        return _components(documents, k, num, den, name)


def _components(documents: DataFrame, k: int, num: int, den: int, name: str) -> DataFrame:
    data = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = documents.select("doc_id", data.alias("text"), F.substring(F.unhex(F.sha2(data, 256)), 1, 16).alias("text_key"))
    known = stored(_identify(rows, k), "jaccard")
    with_words = rows.filter(F.octet_length("text") > 0)
    found = _regions(with_words, _sketch(with_words, k), k, num, den)
    member = F.struct("set_key", "n")
    shared = found.groupBy("region").agg(F.min(member).alias("a"), F.max(member).alias("b"), F.count(F.lit(1)).alias("m"))
    shared = shared.filter("a.set_key <> b.set_key").select("region", "m")
    members = stored(found.join(shared, "region").distinct(), "jaccard")
    close = lambda a, b: den * F.least(a, b) >= num * F.greatest(a, b)
    # First round: small regions pair by pair, the others against their most central member.
    small, large = members.filter(F.col("m") <= SMALL), members.filter(F.col("m") > SMALL)
    other = small.select("region", F.col("set_key").alias("p"), F.col("n").alias("pn"))
    met = small.join(other, "region").filter(F.col("set_key") > F.col("p")).filter(close(F.col("n"), F.col("pn"))).select("set_key", "p")
    score = large.groupBy("set_key").agg(F.sum("m").alias("score"))
    open_rows = stored(large.join(score, "set_key").select("region", "set_key", "n", "score"), "jaccard")
    linked = lambda m: m.filter(den * F.col("both") >= num * F.col("either")).select("x", "p")
    label = F.coalesce("label", "set_key")
    # The pivots' rounds: each set meets one pivot, the best of those of its regions. Later ones only serve regions that still hold several classes.
    best = open_rows.groupBy("region").agg(F.max(F.struct("score", "set_key", "n")).alias("best"))
    pivots = stored(best.select("region", F.col("best.set_key").alias("p"), F.col("best.n").alias("pn"), F.col("best.score").alias("ps")), "jaccard")
    star = open_rows.join(pivots, "region").filter(F.col("set_key") != F.col("p"))
    measured = None
    for turn in range(ROUNDS):
        star = star.filter(close(F.col("n"), F.col("pn"))).groupBy("set_key").agg(F.max(F.struct("ps", "p")).alias("own")).select("set_key", "own.p")
        pairs = star.select(F.col("set_key").alias("x"), "p")
        pairs = pairs if turn else pairs.union(met).distinct()
        step = stored(_measure(stored(_possible(pairs, known, num, den), "jaccard"), with_words, known, k), "jaccard")
        measured = step if measured is None else measured.union(step)
        labels = classes(linked(measured))
        left = open_rows.join(pivots.select("region", "p"), "region").join(labels, F.col("set_key") == F.col("node"), "left").withColumn("label", label)
        if turn + 1 < ROUNDS:
            main = labels.select(F.col("node").alias("p"), F.col("label").alias("main"))
            apart = stored(left.drop("node").join(main, "p", "left").filter(F.col("label") != F.coalesce("main", "p")), "jaccard")
            second = apart.groupBy("region").agg(F.max(F.struct("score", "set_key", "n", "label")).alias("best"))
            second = second.select("region", *[F.col(f"best.{c}").alias(a) for c, a in (("set_key", "p"), ("n", "pn"), ("score", "ps"), ("label", "other"))])
            star = left.select("region", "set_key", "n", "label").join(second, "region").filter(F.col("label") != F.col("other"))
    # What is still in several classes, by the distances to the region's pivot and to the facets.
    far = measured.select(F.col("x").alias("set_key"), "p", (1 - F.col("both") / F.col("either")).alias("far")).distinct()
    left = left.join(far, ["set_key", "p"], "left").withColumn("d", F.when(F.col("set_key") == F.col("p"), 0.0).otherwise(F.col("far")))
    mixed = left.groupBy("region").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("m"))
    mixed = mixed.filter("lo <> hi").select("region", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks"))
    facets = known.groupBy("set_key").agg(F.min("facets").alias("facets"))
    left = left.select("region", "set_key", "n", "d", "label").join(mixed, "region").join(facets, "set_key")
    near = stored(_windows(stored(left, "jaccard"), num, den), "jaccard")
    rest = stored(_measure(near, with_words, known, k), "jaccard")
    labels = classes(linked(measured).union(linked(rest)))
    class_key = F.when(F.col("n_shingles") > 0, F.coalesce("label", "set_key"))
    named = known.join(labels, known["set_key"] == labels["node"], "left").select("doc_id", "n_shingles", class_key.alias("class_key"))
    smallest = named.filter("class_key is not null").groupBy("class_key").agg(F.min("doc_id").alias("smallest"))
    return named.join(smallest, "class_key", "left").select("doc_id", "n_shingles", F.coalesce("smallest", "doc_id").alias(name))


def documents_to_components(documents: DataFrame) -> DataFrame:
    """The contract of query op2: four words, 0.85."""
    return components(documents, 4, 85, 100)
