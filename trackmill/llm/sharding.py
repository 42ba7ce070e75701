"""Operator 6: k-d tree partitioning of documents into shards of nearly equal bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import settle

#: Values of a dimension are scaled to so many bits; as many hash bits below them order equal values.
BITS = 31
BINS = 1024
LAW = "bytes"


def shard(
    documents: DataFrame,
    size: Column,
    dimensions: dict[str, Column],
    keep: dict[str, Column],
    shards: int | None = None,
    target_bytes: int | None = None,
    tolerance: float = 0.001,
) -> DataFrame:
    """Columns of ``keep``, size, shard (int) and slot (long).

    The box of all rows is split again and again at a weighted median of its widest
    dimension until every leaf stands for one shard, either ``shards`` of them or as
    many as ``target_bytes`` asks for. A cut lies where the running weight in the order
    of (dimension, row hash) reaches the share of the left side, found by
    refining histograms: only ``BINS`` sums per node come to the driver. Equal values,
    equal texts and repeated rows are ordered by the row hash, so a group with a third
    of all rows is split like any other. Null dimensions count as 0. An empty table
    gives no rows. Slots number the rows of a shard from 0 without gaps: the rows of a
    shard within one input partition are numbered there and shifted by the counts before.
    """
    if (shards is None) == (target_bytes is None):
        raise ValueError("give shards or target_bytes")
    names = list(dimensions)
    rows = documents.select(
        *[c.alias(f"keep_{k}") for k, c in keep.items()],
        size.cast("long").alias("size"),
        *[F.coalesce(c.cast("double"), F.lit(0.0)).alias(f"raw_{i}") for i, c in enumerate(dimensions.values())],
        F.monotonically_increasing_id().alias("uid"),
    )
    rows = settle(rows)
    facts = rows.agg(
        F.sum("size").alias("size"),
        *[f(f"raw_{i}").alias(f"{f.__name__}_{i}") for i in range(len(names)) for f in (F.min, F.max)],
    ).first()
    total = facts["size"] or 0
    leaves = shards or max(1, -(-total // target_bytes))
    scaled = [_scaled(F.col(f"raw_{i}"), facts[f"min_{i}"], facts[f"max_{i}"]) for i in range(len(names))]
    tie = F.shiftrightunsigned(F.xxhash64("uid"), 64 - BITS)
    rows = rows.select(
        *[f"keep_{k}" for k in keep],
        "size",
        "uid",
        *[(F.shiftleft(v, BITS) + tie).alias(f"key_{i}") for i, v in enumerate(scaled)],
        F.lit(0).alias("node"),
    )
    # first shard of each node -> number of its shards
    nodes = {0: leaves}
    while total and any(n > 1 for n in nodes.values()):
        cuts = _cuts(rows, {k: n for k, n in nodes.items() if n > 1}, len(names), tolerance * total / leaves)
        rows = settle(_apply(rows, cuts))
        for node, (_, _, left) in cuts.items():
            nodes[node + left], nodes[node] = nodes[node] - left, left
    part = F.shiftright("uid", 33)
    rows = rows.withColumns({"part": part, "shard": F.col("node").cast("int")})
    counts = rows.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    earlier = W.partitionBy("shard").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("shard", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    inside = W.partitionBy("shard", "part").orderBy("uid")
    numbered = rows.withColumn("row", F.row_number().over(inside)).join(offsets, ["shard", "part"])
    return numbered.select(
        *[F.col(f"keep_{k}").alias(k) for k in keep],
        "size",
        "shard",
        (F.col("offset") + F.col("row") - 1).cast("long").alias("slot"),
    )


def _scaled(value: Column, low: float | None, high: float | None) -> Column:
    """0 to 2^BITS - 1, in the order of the values."""
    if low is None or not high > low:
        return F.lit(0).cast("long")
    top = (1 << BITS) - 1
    return F.greatest(F.lit(0), F.least(F.lit(top), F.floor((value - low) * (top / (high - low))))).cast("long")


def _cuts(rows: DataFrame, nodes: dict[int, int], dimensions: int, tolerance: float) -> dict[int, tuple[int, int, int]]:
    """For each node its widest dimension, the key that begins its right side, and the shards of its left side."""
    box = rows.filter(F.col("node").isin(*nodes)).groupBy("node").agg(
        F.sum("size").alias("size"),
        *[f(f"key_{i}").alias(f"{f.__name__}_{i}") for i in range(dimensions) for f in (F.min, F.max)],
    )
    state = {}
    for r in box.collect():
        widths = [(r[f"max_{i}"] >> BITS) - (r[f"min_{i}"] >> BITS) for i in range(dimensions)]
        axis = widths.index(max(widths))
        left = nodes[r["node"]] // 2
        low, high = r[f"min_{axis}"], r[f"max_{axis}"] + 1
        state[r["node"]] = {"axis": axis, "left": left, "low": low, "high": high, "want": r["size"] * left / nodes[r["node"]]}
    result = {k: (0, 0, n // 2) for k, n in nodes.items() if k not in state}
    open_nodes = dict(state)
    while open_nodes:
        sums: dict[int, list] = {k: [] for k in open_nodes}
        for r in _histogram(rows, open_nodes).collect():
            sums[r["node"]].append((r["bin"], r["size"]))
        for node, s in list(open_nodes.items()):
            width = _width(s)
            below = 0
            for at, weight in sorted(sums[node]):
                if below + weight >= s["want"]:
                    break
                below += weight
            s["want"] -= below
            s["low"], s["high"] = s["low"] + at * width, min(s["high"], s["low"] + (at + 1) * width)
            if width == 1 or weight <= tolerance:
                cut = s["low"] if s["want"] < weight / 2 else s["high"]
                result[node] = (s["axis"], cut, s["left"])
                del open_nodes[node]
    return result


def _width(s: dict) -> int:
    return max(1, -(-(s["high"] - s["low"]) // BINS))


def _lookup(nodes: dict[int, dict], names: list[str]) -> Column:
    """The facts of a row's node as a struct; null for other nodes. Fewer entries than shards."""
    entries = [(F.lit(k), F.struct(*[F.lit(s[n]).cast("long").alias(n) for n in names])) for k, s in nodes.items()]
    return F.try_element_at(F.create_map(*[c for entry in entries for c in entry]), F.col("node"))


def _key(rows: DataFrame) -> Column:
    """The key along the axis in ``plan``."""
    keys = F.array(*[F.col(c) for c in rows.columns if c.startswith("key_")])
    return F.element_at(keys, F.col("plan.axis").cast("int") + 1)


def _histogram(rows: DataFrame, nodes: dict[int, dict]) -> DataFrame:
    """Bytes by node and bin of the range that still holds the cut; at most BINS rows a node."""
    plans = {k: s | {"width": _width(s)} for k, s in nodes.items()}
    near = rows.withColumn("plan", _lookup(plans, ["axis", "low", "high", "width"])).filter("plan is not null")
    near = near.withColumn("key", _key(rows)).filter("key >= plan.low and key < plan.high")
    return near.groupBy("node", F.expr("(key - plan.low) div plan.width").alias("bin")).agg(F.sum("size").alias("size"))


def _apply(rows: DataFrame, cuts: dict[int, tuple[int, int, int]]) -> DataFrame:
    """Move the right side of each cut to its own node."""
    plans = {k: dict(zip(("axis", "cut", "left"), c, strict=True)) for k, c in cuts.items()}
    planned = rows.withColumn("plan", _lookup(plans, ["axis", "cut", "left"]))
    moved = F.when(_key(rows) >= F.col("plan.cut"), F.col("plan.left").cast("int")).otherwise(F.lit(0))
    return planned.withColumn("node", F.col("node") + F.coalesce(moved, F.lit(0))).drop("plan")


def documents_to_shards(documents: DataFrame, shards: int = 40) -> DataFrame:
    """The contract of query op6: documents by bytes of text plus 16, over size, source, language and id."""
    text = F.coalesce(F.col("text"), F.lit(""))
    size = F.octet_length(text) + F.lit(16)
    code = lambda name: F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")))
    dimensions = {"source": code("source"), "lang": code("lang"), "size": F.log(size.cast("double")), "doc_id": F.col("doc_id")}
    rows = shard(
        documents, size, dimensions, {"doc_id": F.col("doc_id"), "text_crc32": F.crc32(text)}, shards=shards
    )
    return rows.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit(LAW).alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
