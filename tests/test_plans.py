"""The shape of the physical plans, and what happens to a hot key."""

from __future__ import annotations

import contextlib
import re

import pytest
from pyspark.sql import functions as F

from helpers import A, B, cases, final_plan, lookup_of
from precinct.operators.contingency import contingency_statistic
from precinct.operators.fanout import joined_counts, salted_join
from precinct.operators.points import translate_points
from precinct.plans.association import paired_counts
from workload.catalog import QUERIES


@contextlib.contextmanager
def conf(spark, **settings):
    names = {f"spark.sql.{key.replace('__', '.')}": value for key, value in settings.items()}
    for name, value in names.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name in names:
            spark.conf.unset(name)


NO_BROADCAST = {"autoBroadcastJoinThreshold": "-1", "adaptive__autoBroadcastJoinThreshold": "-1"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cross_join_anywhere(spark, sf_dir, name):
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


@pytest.mark.parametrize(
    "name",
    ["rate_joined", "rate_per_head", "join_group_counts_area", "contingency_statistic", "topk"],
)
def test_each_table_is_scanned_once(spark, sf_dir, name):
    with conf(spark, **NO_BROADCAST):
        plan = final_plan(QUERIES[name](spark, sf_dir))
    assert plan.count("orders.parquet") == 1
    assert plan.count("supplier.parquet") == 1


def test_contingency_scans_once_and_has_no_window(spark, sf_dir):
    plan = final_plan(QUERIES["contingency_statistic"](spark, sf_dir))
    scans = [line for line in plan.splitlines() if "FileScan" in line and "orders.parquet" in line]
    assert len(scans) == 1 and "Window" not in plan


@pytest.mark.parametrize("name", ["rate_joined", "join_group_counts_district"])
def test_both_sides_are_counted_before_the_join(spark, sf_dir, name):
    with conf(spark, **NO_BROADCAST):
        plan = final_plan(QUERIES[name](spark, sf_dir))
    lines = plan.splitlines()
    join = next(i for i, line in enumerate(lines) if re.search(r"Join \[area_name", line))
    indent = lines[join].index("*(")
    children = [
        i for i, line in enumerate(lines) if i > join and line[indent : indent + 2] in (":-", "+-")
    ]
    assert len(children) == 2
    for child in children:
        below = (re.search(r"HashAggregate|Join|FileScan", line) for line in lines[child:])
        assert next(found for found in below if found).group() == "HashAggregate"


def test_trend_shuffles_counts_only(spark, sf_dir):
    plan = final_plan(QUERIES["trend_series"](spark, sf_dir))
    assert "Join" not in plan and plan.count("FileScan") == 1
    scan = next(line for line in plan.splitlines() if "FileScan" in line)
    assert "In(o_orderpriority" in scan and "Not(EqualTo(o_orderstatus,P))" in scan
    lines = plan.splitlines()
    for i, line in enumerate(lines):
        if "Exchange hashpartitioning" in line:
            assert "HashAggregate" in next(x for x in lines[i + 1 :] if "Stage" not in x)


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    plan = QUERIES["rate_joined"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    orders = next(line for line in plan.splitlines() if "orders.parquet" in line)
    assert "In(o_orderpriority" in orders
    schema = orders.split("ReadSchema: ")[1]
    assert "o_totalprice" not in schema and "o_orderdate" not in schema


@pytest.mark.parametrize("name", ["rate_joined", "join_group_counts_area"])
def test_status_filter_is_pushed(spark, sf_dir, name):
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    orders = next(line for line in plan.splitlines() if "orders.parquet" in line)
    assert "Not(EqualTo(o_orderstatus,P))" in orders.split("PushedFilters: ")[1]


def test_top_k_does_not_sort_everything(spark, sf_dir):
    plan = QUERIES["topk"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def partitions_of(df, condition: str) -> int:
    return df.where(condition).select(F.spark_partition_id()).distinct().count()


def test_salting_spreads_a_hot_area(spark):
    many = spark.range(3_000).selectExpr(
        "if(id % 3 = 0, 'hot', concat('n', id % 50)) AS area_name", "id AS area_code"
    )
    one = many.select("area_name").distinct().withColumn("n_lookup", F.lit(2))
    with conf(spark, **NO_BROADCAST, adaptive__enabled="false", shuffle__partitions="16"):
        plain = salted_join(many, one, "area_name", spread_by=["area_code"], salts=1)
        salted = salted_join(many, one, "area_name", spread_by=["area_code"], salts=32)
        assert partitions_of(plain, "area_name = 'hot'") == 1
        assert partitions_of(salted, "area_name = 'hot'") > 8
        assert sorted(plain.collect()) == sorted(salted.select(plain.columns).collect())


def tasks_joining(df, hot: str) -> int:
    """Tasks of the salted join that hold rows of a hot key, from the plan's own join."""
    return df.where(f"{hot}").select(F.spark_partition_id()).distinct().count()


def test_hot_label_of_a_table_is_spread(spark):
    cells = spark.range(4_000).selectExpr("id AS f", "if(id % 100 = 0, id % 7 + 1, 0) AS l", "1L AS o")
    labels = cells.groupBy("l").agg(F.sum("o").alias("c"))
    with conf(spark, **NO_BROADCAST, adaptive__enabled="false", shuffle__partitions="16"):
        joined = salted_join(cells, labels, "l", spread_by=["f"], salts=32)
        assert tasks_joining(joined, "l = 0") > 8
        pairs = cells.withColumnsRenamed({"f": "right_count", "l": "left_count"})
        statistic = contingency_statistic(pairs, feature="right_count", label="left_count")
        plan = statistic._jdf.queryExecution().executedPlan().toString()
        assert re.search(r"SortMergeJoin \[l#\d+L?, salt#\d+\]", plan)


def test_joined_counts_spread_a_hot_area(spark):
    incidents = spark.range(3_000).selectExpr(
        "cast(id AS string) AS incident_id", "concat('p', id) AS period", "'c' AS area_code",
        "if(id % 3 > 0, 'hot', concat('n', id % 50)) AS area_name", "'a1' AS category",
    )
    lookup = lookup_of(spark, [("d", "hot", 1), ("d", "n1", 2)])
    with conf(spark, **NO_BROADCAST, adaptive__enabled="false", shuffle__partitions="16"):
        joined = joined_counts(incidents, lookup)
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert re.search(r"SortMergeJoin \[area_name#\d+, salt#\d+\]", plan)
        spread = incidents.groupBy("area_name", "period").count().withColumn(
            "salt", F.pmod(F.hash("period"), F.lit(32))
        ).repartition(16, "area_name", "salt")
        assert tasks_joining(spread, "area_name = 'hot'") > 8
        assert joined.agg(F.sum("n_rows")).first()[0] == 2_000 + incidents.where("area_name = 'n1'").count()


def test_area_pairs_use_the_salted_join(spark):
    lookup = lookup_of(spark, [("d", "x", 1)])
    with conf(spark, **NO_BROADCAST):
        pairs = paired_counts(cases(spark, "x"), lookup, left=A, right=B, key="area_code")
        plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"SortMergeJoin \[area_name#\d+, salt#\d+\]", plan)


def test_salts_must_be_positive(spark):
    one = spark.createDataFrame([("x", 1)], "area_name string, n int")
    with pytest.raises(ValueError, match="salts"):
        salted_join(one, one, "area_name", spread_by=["n"], salts=0)


POINTS = "longitude string, latitude string, postcode string"


def test_points_keep_every_incident_and_compare_text(spark):
    rows = [("1", "-1.50", "53.1"), ("2", "-1.5", "53.1"), ("3", None, None), ("4", "9", "9")]
    incidents = spark.createDataFrame(rows, "incident_id string, longitude string, latitude string")
    points = spark.createDataFrame([("-1.50", "53.1", "LS1"), (None, None, "XX")], POINTS)
    found = {r.incident_id: r.postcode for r in translate_points(incidents, points).collect()}
    assert found == {"1": "LS1", "2": None, "3": None, "4": None}


def test_repeated_point_keeps_one_row_per_incident(spark):
    incidents = spark.createDataFrame(
        [("1", "a", "b")], "incident_id string, longitude string, latitude string"
    )
    points = spark.createDataFrame([("a", "b", "Z9"), ("a", "b", "A1"), ("a", "b", None)], POINTS)
    assert [r.postcode for r in translate_points(incidents, points).collect()] == ["A1"]


def test_hot_point_is_split_by_aqe(spark):
    incidents = spark.range(200_000).selectExpr(
        "uuid() AS incident_id",
        "if(id % 3 = 0, 'hot', cast(id % 900 AS string)) AS longitude",
        "'0' AS latitude",
    )
    points = spark.range(900).selectExpr(
        "if(id = 0, 'hot', cast(id AS string)) AS longitude",
        "'0' AS latitude",
        "concat('P', id) AS postcode",
    )
    settings = {
        "adaptive__skewJoin__skewedPartitionThresholdInBytes": "100KB",
        "adaptive__skewJoin__skewedPartitionFactor": "1.5",
        "adaptive__advisoryPartitionSizeInBytes": "200KB",
        "shuffle__partitions": "16",
    }
    with conf(spark, **NO_BROADCAST, **settings):
        joined = translate_points(incidents.repartition(8), points)
        plan = final_plan(joined)
        assert "isSkew=true" in plan or "skew=true" in plan
        assert joined.count() == 200_000
