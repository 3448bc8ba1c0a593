"""Rates: incidents per head of population, by district."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from precinct.functions.measures import ratio
from precinct.operators.fanout import (
    AREA,
    in_categories,
    incident_counts,
    lookup_counts,
    lookup_districts,
)
from precinct.sources.shared import staged


def joined_totals(incidents: DataFrame, lookup: DataFrame) -> DataFrame:
    """Population sum and row count per district over the joined table.

    An incident counts once per lookup row of its area, and so does that row's
    population once per incident.
    """
    cases = incident_counts(incidents)
    areas = lookup_counts(lookup, "district")
    return (
        cases.join(areas, AREA, "inner")
        .groupBy("district")
        .agg(
            F.sum(F.col("n_incidents") * F.col("population")).alias("tot_population"),
            F.sum(F.col("n_incidents") * F.col("n_lookup")).alias("tot_cases"),
        )
    )


def joined_rate(
    incidents: DataFrame, lookup: DataFrame, *, categories: Sequence[str], digits: int | None = 3
) -> DataFrame:
    """Cases per head as cases over population, both summed over the joined table.

    Mind what it measures: numerator and denominator come from the same joined rows,
    so it equals 1 / (mean population of those rows), and the number of incidents only
    weights that mean. Use ``per_head_rate`` for a rate in the usual sense.
    """
    totals = joined_totals(incidents.where(in_categories(categories)), lookup)
    return totals.withColumn(
        "cases_per_head", ratio(F.col("tot_cases"), F.col("tot_population"), digits)
    )


def per_head_rate(
    incidents: DataFrame, lookup: DataFrame, *, categories: Sequence[str], digits: int | None = 3
) -> DataFrame:
    """Cases per head with every incident and every lookup row counted once.

    Incidents go to the main district of their area. Districts without a case keep
    their population and get rate 0.
    """
    cases = incident_counts(incidents.where(in_categories(categories)))
    own_cases = F.when(F.col("is_main"), F.col("n_incidents"))
    return (
        lookup_districts(lookup)
        .join(cases, AREA, "left")
        .groupBy("district")
        .agg(
            F.sum("population").alias("tot_population"),
            F.coalesce(F.sum(own_cases), F.lit(0)).alias("tot_cases"),
        )
        .withColumn("cases_per_head", ratio(F.col("tot_cases"), F.col("tot_population"), digits))
    )


COMPARISON = (
    "district string, rank bigint, rate double, top_district string, top_rate double, factor double"
)


def compare_with_top(
    rates: DataFrame, district: str, *, rate: str = "cases_per_head"
) -> DataFrame:
    """How a named district stands against the one with the highest rate, as one row.

    ``rank`` is one more than the number of districts with a higher rate, so equal rates
    share a rank; of several top districts the first by name is given. ``factor`` is the top
    rate over the district's own, null where that is 0. ``rates`` has one row per district. A
    district that is not there, or has no rate, gives nulls beside the top.

    The rates are computed once, and written to the shared folder: the named rate and its
    rank are read from there.
    """
    rates = staged(rates.select("district", rate), "rates")
    named = rates.where((F.col("district") == district) & F.col(rate).isNotNull()).select(rate).first()
    own = F.lit(named[0] if named else None).cast("double")
    known = rates.where(F.col(rate).isNotNull())
    top = known.agg(
        F.min(F.struct((-F.col(rate)).alias("lowest"), F.col("district").alias("name"))).alias("top"),
        F.count_if(F.col(rate) > own).alias("higher"),
    )
    top_rate = (-F.col("top.lowest")).cast("double")
    return top.select(
        F.lit(district).alias("district"),
        F.when(own.isNotNull(), F.col("higher") + 1).alias("rank"),
        own.alias("rate"),
        F.col("top.name").alias("top_district"),
        top_rate.alias("top_rate"),
        F.try_divide(top_rate, own).alias("factor"),
    )
