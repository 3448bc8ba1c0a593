"""Parquet staging, so that analyses do not start again from gzip files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from precinct import schemas
from precinct.operators.fanout import roll_up


def stage_incidents(incidents: DataFrame, path: str, *, mode: str = "errorifexists") -> None:
    """Write incidents as Parquet partitioned by period.

    The rebalance shuffle spreads what a single gzip task read, keeps each period in
    few files, and lets AQE cut a period that holds most of the rows into several
    writers instead of sending it to one.
    """
    rebalanced = incidents.hint("rebalance", "period")
    rebalanced.write.mode(mode).partitionBy("period").parquet(path)


def stage_incident_counts(incidents: DataFrame, path: str, *, mode: str = "errorifexists") -> None:
    """Write ``roll_up(incidents)`` as Parquet.

    The raw rows are read once, and only their counts are shuffled and written. Each
    file holds few categories, so that the category filter of an analysis skips the
    row groups of the others; AQE cuts a large category into several files.
    """
    roll_up(incidents).hint("rebalance", "category").write.mode(mode).parquet(path)


def stage_months(incidents: DataFrame, path: str) -> None:
    """Write ``roll_up(incidents)`` as Parquet by period, replacing the periods it has.

    For files that come month by month: a month staged again takes the place of its first
    version, and the files of other months are not touched. Incidents of one month must come
    in one call. ``read_staged_incident_counts`` reads the folder. Rows without a period make
    a partition of their own and come back with a null one.
    """
    counts = roll_up(incidents).hint("rebalance", "period", "category")
    writer = counts.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("period").parquet(path)


def stage_area_lookup(lookup: DataFrame, path: str, *, mode: str = "errorifexists") -> None:
    """Write the area lookup as Parquet in evenly sized files."""
    lookup.hint("rebalance").write.mode(mode).parquet(path)


def read_staged_incidents(spark: SparkSession, path: str) -> DataFrame:
    """Read staged incidents; a filter on ``period`` prunes whole directories.

    The explicit schema keeps ``2018-01`` a string in the partition column.
    """
    return spark.read.schema(schemas.INCIDENTS).parquet(path)


def read_staged_incident_counts(spark: SparkSession, path: str) -> DataFrame:
    """Read a staged roll-up, which every analysis takes in place of the incidents."""
    return spark.read.schema(schemas.INCIDENT_COUNTS).parquet(path)


def read_staged_area_lookup(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.AREA_LOOKUP).parquet(path)
