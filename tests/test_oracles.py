"""Every registered query against its SQL on the same Parquet files."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as contract
from workload.catalog import ORACLES, QUERIES


def rows(columns, records):
    """Rows with columns in name order, as a sorted bag of exact values."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def plain(value):
        if isinstance(value, float):
            return "nan" if math.isnan(value) else repr(value)
        return repr(value)

    return sorted(tuple(plain(record[i]) for i in order) for record in records)


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    for file in Path(sf_dir).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{file}')")
    yield connection
    connection.close()


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(contract.queries()) and set(ORACLES) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, duck, sf_dir, name):
    frame = QUERIES[name](spark, sf_dir)
    expected = duck.execute(ORACLES[name])
    columns = [column[0] for column in expected.description]
    assert sorted(frame.columns) == sorted(columns)
    expected_rows = rows(columns, expected.fetchall())
    assert expected_rows, "an empty result proves nothing"
    assert rows(frame.columns, [tuple(row) for row in frame.collect()]) == expected_rows


def test_entry_ranks_districts_and_breaks_ties_by_name(spark):
    top = [(row.district, row.cases_per_head) for row in contract.entry(spark).collect()]
    assert top == [
        ("ASIA", 1.0),
        ("AFRICA", 0.654),
        ("AMERICA", 0.333),
        ("MIDDLE EAST", 0.333),
        ("EUROPE", 0.248),
    ]
