"""Time the headline queries and print one JSON line.

    python bench.py              the registered queries at $BENCH_SF_DIR
    python bench.py --compare N  counted against plain joins, on N copies of the incidents,
                                 each with area codes of its own and a third of the rows
                                 in one area; and a table whose label is one value in nine
                                 cells of ten

All queries run once to warm up the JVM, then each ``BENCH_RUNS`` times (default 3); the
median counts. Results go to the noop sink, so every row is computed.
"""

from __future__ import annotations

import argparse
import json
import os
import statistics
import sys
import time
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from precinct.operators.contingency import contingency_statistic
from precinct.operators.fanout import joined_counts
from precinct.plans.association import chi_square, paired_counts
from precinct.plans.rates import joined_rate
from precinct.session import get_session
from precinct.sources.shared import remove_scratch, scratch_path
from workload.catalog import QUERIES
from workload.views import SET1, SET1_SQL, SET2, SET2_SQL, area_lookup, identified

HEADLINE = (
    "trend_series",
    "trend_average",
    "trend_gap_filled",
    "trend_daily_by_category",
    "join_inner_fanout",
    "rate_joined",
    "rate_joined_shared_areas",
    "rate_per_head",
    "topk",
    "join_group_counts_area",
    "join_group_counts_district",
    "contingency_statistic",
    "association_area",
    "association_district",
    "rate_joined_from_files",
    "stage_rollup",
    "point_postcodes",
)

JOINED = """
WITH joined AS (SELECT * FROM incidents JOIN area_lookup USING (area_name)
                WHERE population IS NOT NULL)"""

PLAIN_SQL = {
    "rate_joined": f"""{JOINED}
        SELECT district, sum(population) AS tot_population, count(*) AS tot_cases,
               round(try_divide(count(*), sum(population)), 3) AS cases_per_head
        FROM joined WHERE category IN {SET1_SQL} GROUP BY district""",
    "pairs_area": f"""{JOINED}
        SELECT * FROM (SELECT area_code AS key, count(*) AS left_count FROM joined
                       WHERE category IN {SET1_SQL} GROUP BY area_code)
        JOIN (SELECT area_code AS key, count(*) AS right_count FROM joined
              WHERE category IN {SET2_SQL} GROUP BY area_code) USING (key)""",
    "pairs_district": f"""{JOINED}
        SELECT * FROM (SELECT district AS key, count(*) AS left_count FROM joined
                       WHERE category IN {SET1_SQL} GROUP BY district)
        JOIN (SELECT district AS key, count(*) AS right_count FROM joined
              WHERE category IN {SET2_SQL} GROUP BY district) USING (key)""",
    "joined_counts": """WITH joined AS (SELECT * FROM incidents JOIN area_lookup USING (area_name)
                WHERE population IS NOT NULL)
        SELECT period, district, population, count(*) AS n_rows FROM joined
        GROUP BY period, district, population""",
    "contingency": """
        WITH cells AS (SELECT f, l, count(*) AS o FROM hot_pairs GROUP BY f, l),
             totals AS (SELECT f, l, o, sum(o) OVER (PARTITION BY f) AS r,
                               sum(o) OVER (PARTITION BY l) AS c FROM cells)
        SELECT sum(o) * (sum(o * o / (CAST(r AS DOUBLE) * c)) - 1) AS statistic,
               (count(DISTINCT f) - 1) * (count(DISTINCT l) - 1) AS degrees_of_freedom FROM totals""",
}


def run(make: Callable[[], DataFrame]) -> float:
    start = time.perf_counter()
    make().write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def medians(queries: dict[str, Callable[[], DataFrame]], runs: int) -> dict[str, float]:
    for make in queries.values():
        run(make)
    return {
        name: round(statistics.median(run(make) for _ in range(runs)), 3)
        for name, make in queries.items()
    }


def headline(spark: SparkSession, sf_dir: str, runs: int) -> dict:
    times = medians({name: partial(QUERIES[name], spark, sf_dir) for name in HEADLINE}, runs)
    return {
        "metric": "headline_queries_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }


def compare(spark: SparkSession, sf_dir: str, runs: int, copies: int) -> dict:
    path = scratch_path(spark, "copies")
    hot = F.pmod(F.hash("incident_id"), F.lit(3)) == 0
    copied = (
        identified(spark, sf_dir)
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(copies))))
        .withColumn("area_code", F.concat_ws("-", "copy", "area_code"))
        .withColumn("area_name", F.when(hot, 0).otherwise(F.col("area_name")))
    )
    copied.repartition(32).write.parquet(path)
    incidents = spark.read.parquet(path)
    lookup = area_lookup(spark, sf_dir)
    incidents.createOrReplaceTempView("incidents")
    lookup.createOrReplaceTempView("area_lookup")
    sets = {"left": SET1, "right": SET2}
    forms = {
        "rate_joined_counted": lambda: joined_rate(incidents, lookup, categories=SET1),
        "rate_joined_plain": lambda: spark.sql(PLAIN_SQL["rate_joined"]),
        "pairs_area_counted": lambda: paired_counts(incidents, lookup, **sets, key="area_code"),
        "pairs_area_plain": lambda: spark.sql(PLAIN_SQL["pairs_area"]),
        "pairs_district_counted": lambda: paired_counts(incidents, lookup, **sets, key="district"),
        "pairs_district_plain": lambda: spark.sql(PLAIN_SQL["pairs_district"]),
    }
    pairs = scratch_path(spark, "hot-pairs")
    label = F.when(F.col("id") % 10 > 0, 0).otherwise(F.col("id") % 97)
    spark.range(incidents.count()).select(
        (F.xxhash64("id") % 2_000_000).alias("f"), label.alias("l")
    ).write.parquet(pairs)
    hot_pairs = spark.read.parquet(pairs)
    hot_pairs.createOrReplaceTempView("hot_pairs")
    named = {"feature": "f", "label": "l"}
    forms |= {
        "joined_counts_counted": lambda: joined_counts(incidents, lookup),
        "joined_counts_plain": lambda: spark.sql(PLAIN_SQL["joined_counts"]),
        "contingency_salted": lambda: contingency_statistic(hot_pairs, **named),
        "contingency_windows": lambda: spark.sql(PLAIN_SQL["contingency"]),
        "chi_square_salted": lambda: chi_square(hot_pairs, **named),
    }
    times = medians(forms, runs)
    return {
        "metric": "counted_against_plain_join",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "incidents": incidents.count(),
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("--compare", type=int, metavar="N", default=0)
    options = parser.parse_args()
    cpus = os.environ.get("BENCH_CPUS", "8")
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = get_session(
        "precinct-bench",
        master=f"local[{cpus}]",
        conf={
            "spark.sql.shuffle.partitions": cpus if cpus.isdigit() else "8",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "12g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    if options.compare:
        result = compare(spark, sf_dir, runs, options.compare)
    else:
        result = headline(spark, sf_dir, runs)
    remove_scratch(spark)
    spark.stop()
    print(json.dumps(result))


if __name__ == "__main__":
    sys.exit(main())
