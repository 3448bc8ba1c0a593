from __future__ import annotations

import pytest

from helpers import incidents_of
from precinct.operators.series import fill_missing_months
from precinct.plans.profile import count_distinct_values, count_rows, distinct_values
from precinct.plans.trend import average_change, period_change, period_counts, trend


def series_of(spark, values: dict[str, int]):
    return spark.createDataFrame(list(values.items()), "period string, count bigint")


def changes(df):
    return [(r.period, r["count"], r.prev_count, r.percentage_change) for r in df.collect()]


def test_counts_keep_only_the_categories_and_the_null_period(spark):
    rows = [
        ("1", "2020-01", "c", "n", "x"),
        ("2", "2020-01", "c", "n", "y"),
        ("3", "2020-01", "c", "n", None),
        ("4", None, "c", "n", "x"),
    ]
    incidents = incidents_of(spark, rows)
    assert {(r.period, r["count"]) for r in period_counts(incidents).collect()} == {
        ("2020-01", 3),
        (None, 1),
    }
    kept = period_counts(incidents, categories=["x"])
    assert {(r.period, r["count"]) for r in kept.collect()} == {("2020-01", 1), (None, 1)}


def test_change_divides_by_the_current_count(spark):
    result = period_change(series_of(spark, {"2020-01": 2, "2020-02": 3, "2020-03": 1}))
    assert changes(result.orderBy("period")) == [
        ("2020-02", 3, 2, 33.33),
        ("2020-03", 1, 3, -200.0),
    ]


def test_change_against_the_previous_count(spark):
    result = period_change(series_of(spark, {"2020-01": 3, "2020-02": 4}), base="previous")
    assert changes(result) == [("2020-02", 4, 3, 33.33)]


def test_unknown_base_is_refused(spark):
    with pytest.raises(ValueError, match="base"):
        period_change(series_of(spark, {"2020-01": 1}), base="next")


def test_unrounded_change(spark):
    result = period_change(series_of(spark, {"2020-01": 2, "2020-02": 3}), digits=None)
    assert result.first().percentage_change == pytest.approx(100 / 3, abs=1e-12)


def test_single_month_has_no_change_and_no_average(spark):
    result = period_change(series_of(spark, {"2020-01": 5}))
    assert result.count() == 0
    average = average_change(result).first()
    assert average.avg_percentage_change is None and average.increasing is None


def test_missing_month_is_skipped_by_default(spark):
    result = period_change(series_of(spark, {"2019-11": 2, "2020-02": 4}))
    assert changes(result) == [("2020-02", 4, 2, 50.0)]


def test_missing_months_can_be_filled_with_zero(spark):
    result = period_change(series_of(spark, {"2019-11": 2, "2020-02": 4}), fill_gaps=True)
    assert changes(result.orderBy("period")) == [
        ("2019-12", 0, 2, None),
        ("2020-01", 0, 0, None),
        ("2020-02", 4, 0, 100.0),
    ]


def test_gaps_are_filled_per_series(spark):
    rows = [("s", "2020-01", 1), ("s", "2020-03", 2), ("t", "2020-03", 3), (None, "2020-01", 4)]
    series = spark.createDataFrame(rows, "name string, period string, count bigint")
    filled = fill_missing_months(series, period="period", value="count", by=["name"])
    assert {tuple(row) for row in filled.collect()} == {*rows, ("s", "2020-02", 0)}


def test_series_do_not_mix(spark):
    rows = [("s", "2020-01", 1), ("s", "2020-02", 2), ("t", "2020-01", 8), ("t", "2020-02", 4)]
    series = spark.createDataFrame(rows, "name string, period string, count bigint")
    result = period_change(series, by=["name"])
    assert {(r.name, r.prev_count, r.percentage_change) for r in result.collect()} == {
        ("s", 1, 50.0),
        ("t", 8, -100.0),
    }
    averages = average_change(result, by=["name"]).collect()
    assert {(r.name, r.increasing) for r in averages} == {("s", True), ("t", False)}


def test_trend_is_sorted(spark):
    rows = [(str(i), f"2020-{m:02d}", "c", "n", "x") for i, m in enumerate([3, 1, 2, 2, 3, 3])]
    result = trend(incidents_of(spark, rows))
    assert changes(result) == [("2020-02", 2, 1, 50.0), ("2020-03", 3, 2, 33.33)]


def test_profile_counts_null_as_a_value(spark):
    df = spark.createDataFrame([("x",), ("x",), (None,)], "category string")
    assert {row.category for row in distinct_values(df, "category").collect()} == {"x", None}
    assert count_distinct_values(df, "category").first().n_distinct == 2
    assert count_rows(df).first().n_rows == 3
