"""Data profile: rows, distinct values and how many there are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from precinct.operators.fanout import incidents_in


def count_rows(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows"))


def count_incidents(incidents: DataFrame) -> DataFrame:
    """How many incidents there are, in a rolled-up table too."""
    total = F.coalesce(F.sum(incidents_in(incidents)), F.lit(0))
    return incidents.agg(total.alias("n_incidents"))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """The values of a column, null included."""
    return df.select(column).distinct()


def count_distinct_values(df: DataFrame, column: str) -> DataFrame:
    """How many values a column has, counting null as one."""
    return distinct_values(df, column).agg(F.count(F.lit(1)).alias("n_distinct"))
