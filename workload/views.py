"""The canonical tables derived from the star-schema tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SET1 = ("1-URGENT", "2-HIGH")
SET2 = ("5-LOW",)
NAMED_DISTRICT = "ASIA"


# The columns used, so that no read starts with a job to look at the file footers.
TABLES = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": (
        "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
    ),
    "supplier": "s_suppkey bigint, s_nationkey int, s_acctbal double",
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_orderdate timestamp_ntz, "
        "o_orderpriority string"
    ),
    "lineitem": "l_orderkey bigint, l_quantity double",
    "events": "event_id bigint, ts timestamp_ntz, event_type string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{sf_dir}/{name}.parquet")


def incidents(spark: SparkSession, sf_dir: str, condition: Column | None = None) -> DataFrame:
    """Orders as incidents. Pending ones lose their ID, so that there are nulls."""
    orders = table(spark, sf_dir, "orders")
    if condition is not None:
        orders = orders.where(condition)
    customer = table(spark, sf_dir, "customer")
    return orders.join(customer, orders.o_custkey == customer.c_custkey).select(
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderkey")).alias("incident_id"),
        F.date_format("o_orderdate", "yyyy-MM").alias("period"),
        F.col("o_custkey").alias("area_code"),
        F.col("c_nationkey").alias("area_name"),
        F.col("o_orderpriority").alias("category"),
    )


def identified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incidents with an ID. The filter stands below the projection, as a scan can use it."""
    return incidents(spark, sf_dir, (F.col("o_orderstatus") != "P") & F.col("o_orderkey").isNotNull())


def dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identified orders as incidents without an area name, which the trend never asks for."""
    return (
        table(spark, sf_dir, "orders")
        .where((F.col("o_orderstatus") != "P") & F.col("o_orderkey").isNotNull())
        .select(
            F.col("o_orderkey").alias("incident_id"),
            F.date_format("o_orderdate", "yyyy-MM").alias("period"),
            F.col("o_custkey").alias("area_code"),
            F.col("o_orderpriority").alias("category"),
        )
    )


def area_lookup(spark: SparkSession, sf_dir: str, district: str = "r_name") -> DataFrame:
    """Suppliers as lookup rows: many per nation, each nation in one district."""
    supplier = table(spark, sf_dir, "supplier")
    nation = table(spark, sf_dir, "nation")
    region = table(spark, sf_dir, "region")
    return (
        supplier.join(nation, supplier.s_nationkey == nation.n_nationkey)
        .join(region, nation.n_regionkey == region.r_regionkey)
        .select(
            F.col(district).alias("district"),
            F.col("s_nationkey").alias("area_name"),
            F.when(
                F.col("s_acctbal") >= 0, F.floor(F.col("s_acctbal") / 1000).cast("int")
            ).alias("population"),
        )
    )


def shared_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as lookup rows: every nation lies in several districts."""
    return table(spark, sf_dir, "customer").select(
        F.col("c_mktsegment").alias("district"),
        F.col("c_nationkey").alias("area_name"),
        F.when(F.col("c_acctbal") >= 0, F.floor(F.col("c_acctbal") / 1000).cast("int")).alias(
            "population"
        ),
    )


def daily_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as incidents with days as periods."""
    return table(spark, sf_dir, "events").select(
        F.date_format("ts", "yyyy-MM-dd").alias("period"),
        F.col("event_type").alias("category"),
    )


INCIDENTS_SQL = """
incidents AS (
  SELECT CASE WHEN o_orderstatus <> 'P' THEN o_orderkey END AS incident_id,
         strftime(o_orderdate, '%Y-%m') AS period,
         o_custkey AS area_code, c_nationkey AS area_name, o_orderpriority AS category
  FROM orders JOIN customer ON o_custkey = c_custkey
), identified AS (
  SELECT * FROM incidents WHERE incident_id IS NOT NULL
)"""

AREA_LOOKUP_SQL = """
area_lookup AS (
  SELECT {district} AS district, s_nationkey AS area_name,
         CASE WHEN s_acctbal >= 0 THEN CAST(floor(s_acctbal / 1000) AS INTEGER) END AS population
  FROM supplier JOIN nation ON s_nationkey = n_nationkey
                JOIN region ON n_regionkey = r_regionkey
)"""

SHARED_LOOKUP_SQL = """
area_lookup AS (
  SELECT c_mktsegment AS district, c_nationkey AS area_name,
         CASE WHEN c_acctbal >= 0 THEN CAST(floor(c_acctbal / 1000) AS INTEGER) END AS population
  FROM customer
)"""

DATED_SQL = """
identified AS (
  SELECT o_orderkey AS incident_id, strftime(o_orderdate, '%Y-%m') AS period,
         o_custkey AS area_code, o_orderpriority AS category
  FROM orders WHERE o_orderstatus <> 'P' AND o_orderkey IS NOT NULL
)"""

SET1_SQL = "('1-URGENT', '2-HIGH')"
SET2_SQL = "('5-LOW')"


def with_views(body: str, lookup: str = AREA_LOOKUP_SQL, district: str = "r_name") -> str:
    """Prefix ``body`` (further CTEs and a SELECT) with the views and the plain join."""
    return (
        f"WITH {INCIDENTS_SQL.strip()}, {lookup.strip().format(district=district)}, "
        "joined AS (SELECT * FROM identified JOIN area_lookup USING (area_name) "
        f"WHERE population IS NOT NULL) {body.strip()}"
    )


def with_dated(body: str) -> str:
    """Prefix ``body`` with the orders as incidents without an area, as ``dated`` has them."""
    return f"WITH {DATED_SQL.strip()} {body.strip()}"
