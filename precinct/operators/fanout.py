"""Counts over the many-to-many join of incidents and lookup, without its rows.

An incident joins every lookup row of its area, so the joined table has
``incidents x lookup rows`` rows per area, and one busy area can dominate it. Both
sides are therefore counted down to the grain a query needs first, and the counts
are multiplied after the join. ``sum(n_incidents * n_lookup)`` is the row count of
the plain join, and ``sum(n_incidents * population)`` its population sum.

The map-side partial aggregates absorb a hot area before anything is shuffled.
No broadcast is forced: AQE picks one when the counted side it has measured stays
below ``spark.sql.autoBroadcastJoinThreshold``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

AREA = "area_name"
COUNT = "n_incidents"
# Tasks a hot key is spread over where AQE cannot split it.
SALTS = 32


def in_categories(categories: Sequence[str]) -> Column:
    """Whether a row is of one of the categories. One name alone must be in a sequence too."""
    if isinstance(categories, str):
        raise TypeError(f"categories must be a sequence of names, not the string {categories!r}")
    return F.col("category").isin(list(categories))


def incidents_in(rows: DataFrame) -> Column:
    """How many incidents a row stands for: 1, or its count in a rolled-up table."""
    return F.col(COUNT) if COUNT in rows.columns else F.lit(1)


def roll_up(incidents: DataFrame) -> DataFrame:
    """Incidents per period, area and category: all that the analyses look at.

    They accept this table in place of the incidents, so that one pass over the raw
    rows serves all of them. Its size is bounded by the values of the four columns.
    """
    return incidents.groupBy("period", "area_code", AREA, "category").agg(
        F.sum(incidents_in(incidents)).alias(COUNT)
    )


def incident_counts(incidents: DataFrame, *grain: str) -> DataFrame:
    """Incidents per area and ``grain``. A null area can never join, so it goes first."""
    return (
        incidents.where(F.col(AREA).isNotNull())
        .groupBy(AREA, *grain)
        .agg(F.sum(incidents_in(incidents)).alias(COUNT))
    )


def lookup_counts(lookup: DataFrame, *grain: str) -> DataFrame:
    """Lookup rows and their population per area and ``grain``."""
    return (
        lookup.where(F.col("population").isNotNull())
        .groupBy(AREA, *grain)
        .agg(F.count(F.lit(1)).alias("n_lookup"), F.sum("population").alias("population"))
    )


def lookup_districts(lookup: DataFrame) -> DataFrame:
    """``lookup_counts`` per area and district, marking one main district per area.

    The main district has the most lookup rows of the area, and comes first by name on
    a tie. The window holds counted rows only: one per district of an area.
    """
    window = Window.partitionBy(AREA).orderBy(F.desc("n_lookup"), F.asc("district"))
    return (
        lookup_counts(lookup, "district")
        .where(F.col("district").isNotNull())
        .withColumn("is_main", F.row_number().over(window) == 1)
    )


def joined_counts(
    incidents: DataFrame,
    lookup: DataFrame,
    *,
    incident_columns: Sequence[str] = ("period",),
    lookup_columns: Sequence[str] = ("district", "population"),
    salts: int = SALTS,
) -> DataFrame:
    """The joined table as a bag: its distinct rows, with ``n_rows`` for how often.

    Holds exactly what ``incidents JOIN lookup USING (area_name)`` projected to the
    given columns holds. Repeats are counted, not written out, so an area adds at most
    as many rows as it has distinct values on both sides. ``salts`` spreads an area with
    very many values over that many tasks.
    """
    left = incident_counts(incidents, *incident_columns)
    right = (
        lookup.where(F.col("population").isNotNull())
        .groupBy(AREA, *lookup_columns)
        .agg(F.count(F.lit(1)).alias("n_lookup"))
    )
    return (
        salted_join(left, right, AREA, spread_by=incident_columns, salts=salts)
        .groupBy(*incident_columns, *lookup_columns)
        .agg(F.sum(F.col(COUNT) * F.col("n_lookup")).alias("n_rows"))
    )


def salted_join(
    hot: DataFrame, other: DataFrame, on: str, *, spread_by: Sequence[str], salts: int
) -> DataFrame:
    """Inner join of counted tables where ``hot`` may repeat a key very often.

    The rows of a key are spread over ``salts`` tasks by the hash of ``spread_by``, and
    ``other`` is repeated once per salt. AQE cannot do this for counted tables: it splits
    a join partition only if both inputs come straight from a shuffle, and these come
    from an aggregate.
    """
    if salts < 1:
        raise ValueError("salts must be at least 1")
    if salts == 1:
        return hot.join(other, on, "inner")
    left = hot.withColumn("salt", F.pmod(F.hash(*spread_by), F.lit(salts)))
    right = other.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [on, "salt"], "inner").drop("salt")
