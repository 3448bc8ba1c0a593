"""Places and average ranks of rows in a global order, without a task that sees them all.

A sort by range gives every partition a stretch of the order. Sums within a stretch and the
totals of the stretches before it add up to places; only the totals, one row for each
partition, ever meet in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from precinct.sources.shared import staged


def rows_before(df: DataFrame, order: Sequence[str | Column], *, weight: str | None = None, output: str) -> DataFrame:
    """Add ``output``: how many rows, or how much ``weight``, come before each row in the order.

    The order must be total for reruns to agree. The sorted rows are written to the shared
    folder, so that both readings of them find the same partitions.
    """
    each = F.col(weight) if weight else F.lit(1).cast("long")
    ordered = staged(df.orderBy(*order).withColumn("_row", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("_row", 33).alias("_part")
    totals = ordered.groupBy(part).agg(F.sum(each).alias("_total"))
    before = totals.select("_part", (F.sum("_total").over(Window.orderBy("_part")) - F.col("_total")).alias("_before"))
    if weight:
        inside = Window.partitionBy("_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, 0)
        within = F.sum(weight).over(inside) - F.col(weight)
    else:
        within = F.col("_row").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        ordered.withColumn("_part", part)
        .join(before, "_part")
        .withColumn(output, F.col("_before") + within)
        .drop("_part", "_row", "_before")
    )


def double_ranks(values: DataFrame, value: str, count: str) -> DataFrame:
    """Add ``double_rank``, twice the average rank of each value, to counted values.

    ``values`` has each value once and says how often it occurs. Equal values share the mean
    of their ranks, which is a whole or a half; twice that is an integer, and exact.
    """
    placed = rows_before(values, [value], weight=count, output="before")
    return placed.withColumn("double_rank", 2 * F.col("before") + F.col(count) + 1).drop("before")
