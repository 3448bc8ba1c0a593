"""Trend: is the number of incidents rising from one period to the next?"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from precinct.functions.measures import percentage_change
from precinct.operators.fanout import in_categories, incidents_in
from precinct.operators.series import fill_missing_months, previous_value


def period_counts(
    incidents: DataFrame, *, categories: Sequence[str] | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """Incidents per period (and series ``by``), of the given categories or all."""
    kept = incidents if categories is None else incidents.where(in_categories(categories))
    return kept.groupBy(*by, "period").agg(F.sum(incidents_in(incidents)).alias("count"))


def period_change(
    counts: DataFrame,
    *,
    period: str = "period",
    value: str = "count",
    base: str = "current",
    by: Sequence[str] = (),
    digits: int | None = 2,
    fill_gaps: bool = False,
) -> DataFrame:
    """Percentage change of each period against the one before it.

    The first period of a series has no predecessor and is dropped. A missing month is
    skipped over, so that its neighbours are compared, unless ``fill_gaps`` puts a 0
    there; the change is null where that makes the divisor 0.
    """
    series = fill_missing_months(counts, period=period, value=value, by=by) if fill_gaps else counts
    previous = f"prev_{value}"
    change = percentage_change(F.col(value), F.col(previous), base=base, digits=digits)
    return (
        previous_value(series, period=period, value=value, output=previous, by=by)
        .where(F.col(previous).isNotNull())
        .withColumn("percentage_change", change)
    )


def average_change(changes: DataFrame, *, by: Sequence[str] = ()) -> DataFrame:
    """Average percentage change; ``increasing`` says whether it is positive."""
    average = F.avg("percentage_change")
    return changes.groupBy(*by).agg(
        average.alias("avg_percentage_change"), (average > 0).alias("increasing")
    )


def trend(
    incidents: DataFrame,
    *,
    categories: Sequence[str] | None = None,
    base: str = "current",
    by: Sequence[str] = (),
    fill_gaps: bool = False,
) -> DataFrame:
    """Period counts with their changes, sorted for display."""
    counts = period_counts(incidents, categories=categories, by=by)
    return period_change(counts, base=base, by=by, fill_gaps=fill_gaps).orderBy(*by, "period")
