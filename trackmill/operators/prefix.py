"""Running totals that do not put a whole run into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

DEFAULT_WIDTH = 50_000


def running_totals(
    rows: DataFrame,
    key: str,
    position: str,
    values: list[str],
    width: int = DEFAULT_WIDTH,
) -> DataFrame:
    """Cumulative sums of ``values`` per ``key`` in ``position`` order.

    ``rows`` holds at most one row per key and position. A single window per key
    would sort a whole recording in one task; here each key is cut into position
    blocks of ``width``. Block totals are summed first (one row per block), the
    running block offsets are joined back, and the window runs inside a block,
    which has at most ``width`` rows.
    """
    # Without a null block both uses of the rows get the same plan and share one shuffle.
    block = F.coalesce(F.expr(f"`{position}` div {int(width)}"), F.lit(0))
    blocked = rows.withColumn("_block", block)
    offsets = blocked.groupBy(key, "_block").agg(*[F.sum(v).alias(f"_{v}") for v in values])
    before = W.partitionBy(key).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    offsets = offsets.select(
        key,
        "_block",
        *[F.coalesce(F.sum(f"_{v}").over(before), F.lit(0)).alias(f"_{v}") for v in values],
    )
    inside = W.partitionBy(key, "_block").orderBy(position).rowsBetween(W.unboundedPreceding, 0)
    running = blocked.withColumns({f"running_{v}": F.sum(v).over(inside) for v in values})
    return running.join(offsets, [key, "_block"]).select(
        *rows.columns, *[(F.col(f"running_{v}") + F.col(f"_{v}")).alias(f"running_{v}") for v in values]
    )
