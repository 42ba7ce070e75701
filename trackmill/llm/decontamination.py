"""Operator 8: benchmark passages in documents by spaced seeds that no overlap can avoid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import settle

#: Masks: the places of a seed's words, all between them are ignored. Fixed by the item's length from the first number on.
#: Ten words with three substitutions, in five blocks of two: two blocks hold none, whose distance is one of four.
#: Six to nine words have one substitution at most, as have five; fewer have none.
MASKS = {
    10: ((0, 1, 2, 3), (0, 1, 4, 5), (0, 1, 6, 7), (0, 1, 8, 9)),
    6: ((0, 1, 2, 3), (0, 1, 3, 4)),
    5: ((0, 1, 2, 3), (0, 1, 3, 4), (0, 2, 3, 4), (0, 1, 2, 4)),
    4: ((0, 1, 2, 3),),
    3: ((0, 1, 2),),
    2: ((0, 1),),
    1: ((0,),),
}
#: A match counts 1, a substitution counts this.
SUBSTITUTION = -2
#: Best stretch on a diagonal that makes an overlap, and the share of a whole item that does as well.
SCORE = 15
SHARE = 0.8
#: Seeds of a benchmark up to so many text bytes are broadcast: four rows of about 60 bytes a word.
BROADCAST_BYTES = 1 << 19


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def mask_group(n: Column) -> Column:
    """Key in MASKS of an item of ``n`` words.

    Ten words with four substitutions or more score below zero, so a stretch that reaches SCORE
    has ten words with three at most. So has an item of ten words or more with SHARE of its words matched:
    of its n // 10 parts of ten words, one has a share of the n // 5 substitutions.
    """
    first, *rest = sorted(MASKS, reverse=True)
    found = F.when(n >= first, first)
    for least in rest:
        found = found.when(n >= least, least)
    return found


def overlaps(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document and item that overlap: doc_id, item_id, score, n_matched, n_item_words, doc_start.

    Seeds are hashes of the words under a mask (MASKS), at every place of the items, and of the
    documents under all masks in use, and joined. A joined seed fixes a diagonal, on which the whole item is
    compared with the document word by word: the overlap stands if its best stretch (matches
    less penalties for substitutions) reaches SCORE, or SHARE of the item's words match; items below
    five words stand whole. No such overlap is without a joined seed, also where the item hangs over an end of the document.
    ``doc_start``: first word of the item's place, negative if the document begins inside the item.

    The seeds of a small benchmark, by its measured size, are broadcast; those of a large
    one are joined by shuffle. Only joined seeds leave the scan. Null and empty texts and
    items match nothing. Rows with the same id count as one document
    or item with several texts; null ids are ids. Copies are each reported. Other
    columns are not read.
    """
    items = benchmark.select("item_id", tokens(F.col("text")).alias("item_words")).filter(F.size("item_words") > 0)
    items = items.distinct().withColumns(
        {"n_item_words": F.size("item_words"), "item_key": F.xxhash64("item_words", F.lit(7))}
    )
    items = items.withColumn("masks", mask_group(F.col("n_item_words")))
    facts = benchmark.agg(F.sum(F.octet_length("text")).alias("size")).first()
    groups = [r[0] for r in items.select("masks").distinct().collect()]  # at most as many as MASKS has
    own = {m: F.col("masks").isin([g for g in groups if m in MASKS[g]]) for g in groups for m in MASKS[g]}
    seeds = _seeds(items.withColumnRenamed("item_words", "words"), own).select(
        "seed", "item_id", "item_key", F.col("at").alias("item_at"), "n_item_words"
    )
    seeds = seeds.distinct()
    seeds = F.broadcast(seeds) if (facts["size"] or 0) <= BROADCAST_BYTES else seeds
    read = documents.select("doc_id", tokens(F.col("text")).alias("words"))
    hits = _seeds(read, dict.fromkeys(own, F.lit(True))).join(seeds, "seed")
    diagonal = (F.col("at") - F.col("item_at")).alias("doc_start")
    hits = hits.select(
        "doc_id",
        "item_id",
        "item_key",
        diagonal,
        F.slice("words", F.greatest(F.lit(0), F.col("at") - F.col("item_at")) + 1, F.col("n_item_words") + F.least(F.lit(0), F.col("at") - F.col("item_at"))).alias("doc_words"),
    ).distinct()
    # Settled: Spark would move the comparison into the seed join, which then leaves generated code and copies words per window.
    hits = settle(hits)
    named = items.select(F.col("item_id").alias("own_id"), F.col("item_key").alias("own_key"), "item_words")
    same_item = hits["item_id"].eqNullSafe(named["own_id"]) & (hits["item_key"] == named["own_key"])
    return _verified(hits.join(named, same_item))


def _seeds(rows: DataFrame, masks: dict[tuple[int, ...], Column]) -> DataFrame:
    """Seeds under each mask whose condition a row meets, at every place where the mask fits."""
    n, at = F.size("words"), F.col("at")
    placed = rows.withColumn("at", F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1))))
    found = []
    for mask, fits in sorted(masks.items()):
        seed = F.xxhash64(F.lit("".join(str(int(i in mask)) for i in range(mask[-1] + 1))), *[F.get("words", at + i) for i in mask])
        found.append(F.when(fits & (at + mask[-1] < n), seed))
    seed = F.explode(F.array(*found)) if found else F.lit(None).cast("long")
    return placed.withColumn("seed", seed).filter("seed is not null")


def _verified(hits: DataFrame) -> DataFrame:
    same = F.zip_with(
        "doc_words",
        F.slice("item_words", F.greatest(F.lit(0), -F.col("doc_start")) + 1, F.greatest(F.size("doc_words"), F.lit(0))),
        lambda a, b: F.when(a == b, 1).otherwise(SUBSTITUTION),
    )
    start = F.struct(F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(seen, x):
        run = F.greatest(F.lit(0), seen["run"] + x)
        return F.struct(run.alias("run"), F.greatest(seen["best"], run).alias("best"))

    aligned = hits.withColumn("same", same).select(
        "doc_id",
        "item_id",
        "doc_start",
        F.size("item_words").alias("n_item_words"),
        F.aggregate("same", start, step, lambda s: s["best"]).alias("score"),
        F.size(F.filter("same", lambda x: x == 1)).alias("n_matched"),
    )
    kept = aligned.filter((F.col("score") >= SCORE) | (F.col("n_matched") >= SHARE * F.col("n_item_words")))
    best = F.max(F.struct("score", "n_matched", (-F.col("doc_start")).alias("late"), "n_item_words")).alias("best")
    return kept.groupBy("doc_id", "item_id").agg(best).select(
        "doc_id",
        "item_id",
        "best.score",
        "best.n_matched",
        "best.n_item_words",
        (-F.col("best.late")).alias("doc_start"),
    )


def clean(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without an overlap, all columns kept."""
    leaked = overlaps(documents, benchmark).select(F.col("doc_id").alias("leaked_id")).distinct()
    return documents.join(leaked, documents["doc_id"].eqNullSafe(leaked["leaked_id"]), "left_anti")
