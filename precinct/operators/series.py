"""Operators on ordered series of periods."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def previous_value(
    series: DataFrame, *, period: str, value: str, output: str, by: Sequence[str] = ()
) -> DataFrame:
    """Add the value of the preceding row in period order, within each ``by`` series.

    Use on counted series only. Each window then holds one row per period, which the
    calendar bounds (12 a year), however many incidents were counted. Without ``by``
    there is a single series and so a single window.
    """
    window = Window.partitionBy(*by).orderBy(period)
    return series.withColumn(output, F.lag(value, 1).over(window))


def fill_missing_months(
    series: DataFrame, *, period: str, value: str, by: Sequence[str] = ()
) -> DataFrame:
    """Add a 0 row for every ``yyyy-MM`` period a series lacks between its ends.

    Each row is stretched up to the month before its successor, so no calendar has to
    be joined. A null period has no place on the calendar and is left out.
    """
    window = Window.partitionBy(*by).orderBy("month")
    last = F.coalesce(F.add_months(F.lead("month").over(window), -1), F.col("month"))
    return (
        series.where(F.col(period).isNotNull())
        .withColumn("month", F.to_date(period, "yyyy-MM"))
        .withColumn("last", last)
        .select(
            *by,
            value,
            F.posexplode(F.sequence("month", "last", F.expr("interval 1 month"))).alias("gap", "month"),
        )
        .select(
            *by,
            F.date_format("month", "yyyy-MM").alias(period),
            F.when(F.col("gap") == 0, F.col(value)).otherwise(F.lit(0)).alias(value),
        )
    )
