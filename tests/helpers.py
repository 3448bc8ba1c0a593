"""Small frames for the tests, and the plain joined forms they are checked against."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame

from precinct import schemas

A, B, OTHER = ("a1", "a2"), ("b1",), ("c1",)


def incidents_of(spark, rows) -> DataFrame:
    """Rows are (incident_id, period, area_code, area_name, category)."""
    return spark.createDataFrame(rows, schemas.INCIDENTS)


def lookup_of(spark, rows) -> DataFrame:
    """Rows are (district, area_name, population)."""
    return spark.createDataFrame(rows, schemas.AREA_LOOKUP)


def cases(spark, *areas: str, category: str = "a1") -> DataFrame:
    """One incident per named area."""
    return incidents_of(
        spark, [(str(i), "2020-01", f"code {area}", area, category) for i, area in enumerate(areas)]
    )


def random_tables(spark, seed: int):
    """Incidents and lookup rows with nulls, unmatched areas, shared areas and a hot area."""
    rng = random.Random(seed)
    names = [f"n{i}" for i in range(8)] + [None]
    incident_rows = []
    for i in range(400):
        name = "n0" if rng.random() < 0.35 else rng.choice(names)
        code = None if rng.random() < 0.05 else f"c{rng.randrange(25)}"
        period = f"20{rng.randrange(18, 21)}-{rng.randrange(1, 13):02d}"
        category = rng.choice([*A, *B, *OTHER, None])
        incident_rows.append((str(i), period, code, name, category))
    lookup_names = [*names[:6], "only here", None]
    lookup_rows = [
        (
            rng.choice(["d1", "d2", "d3", None]),
            "n0" if rng.random() < 0.35 else rng.choice(lookup_names),
            None if rng.random() < 0.1 else rng.randrange(0, 90),
        )
        for _ in range(60)
    ]
    return incidents_of(spark, incident_rows), lookup_of(spark, lookup_rows)


def bag(df: DataFrame, *columns: str):
    """Rows as a sorted list, comparable whatever the order."""
    picked = df.select(*columns) if columns else df.select(*sorted(df.columns))
    return sorted((tuple(row) for row in picked.collect()), key=repr)


def plain_join(spark, incidents: DataFrame, lookup: DataFrame) -> None:
    """Publish the row-by-row join as the view ``joined``."""
    incidents.createOrReplaceTempView("test_incidents")
    lookup.createOrReplaceTempView("test_lookup")
    spark.sql(
        "CREATE OR REPLACE TEMP VIEW joined AS SELECT * FROM test_incidents "
        "JOIN test_lookup USING (area_name) WHERE population IS NOT NULL"
    )


def sql_set(categories) -> str:
    return "(" + ", ".join(f"'{name}'" for name in categories) + ")"


def final_plan(df: DataFrame) -> str:
    """The physical plan AQE ended with, after running the query."""
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString()
    return text.split("+- == Initial Plan ==")[0]
