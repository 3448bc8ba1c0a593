from __future__ import annotations

import pytest

from helpers import A, bag, cases, lookup_of, plain_join, random_tables, sql_set
from precinct.operators.fanout import in_categories, joined_counts, lookup_districts
from precinct.operators.ranking import top_k
from precinct.plans.rates import compare_with_top, joined_rate, per_head_rate


def by_district(df):
    return {r.district: (r.tot_population, r.tot_cases, r.cases_per_head) for r in df.collect()}


@pytest.mark.parametrize("seed", range(4))
def test_joined_rate_equals_the_plain_join(spark, seed):
    incidents, lookup = random_tables(spark, seed)
    plain_join(spark, incidents, lookup)
    plain = spark.sql(
        f"""SELECT district, sum(population) AS tot_population, count(*) AS tot_cases,
                   round(try_divide(count(*), sum(population)), 3) AS cases_per_head
            FROM joined WHERE category IN {sql_set(A)} GROUP BY district"""
    )
    assert bag(joined_rate(incidents, lookup, categories=A)) == bag(plain)


@pytest.mark.parametrize("seed", range(2))
def test_joined_rate_is_one_over_the_mean_population(spark, seed):
    incidents, lookup = random_tables(spark, seed)
    plain_join(spark, incidents, lookup)
    means = spark.sql(
        f"""SELECT district, avg(population) AS mean FROM joined
            WHERE category IN {sql_set(A)} GROUP BY district"""
    )
    expected = {row.district: 1 / row.mean for row in means.collect()}
    rates = joined_rate(incidents, lookup, categories=A, digits=None)
    actual = {row.district: row.cases_per_head for row in rates.collect()}
    assert actual == pytest.approx(expected)


@pytest.mark.parametrize("seed", range(2))
@pytest.mark.parametrize(
    "incident_columns, lookup_columns",
    [(["period"], ["district", "population"]), (["area_code", "category"], ["district"])],
)
def test_joined_counts_hold_the_plain_join(spark, seed, incident_columns, lookup_columns):
    incidents, lookup = random_tables(spark, seed)
    plain_join(spark, incidents, lookup)
    columns = ", ".join([*incident_columns, *lookup_columns])
    plain = spark.sql(f"SELECT {columns}, count(*) AS n_rows FROM joined GROUP BY {columns}")
    for salts in (1, 8):
        counted = joined_counts(
            incidents,
            lookup,
            incident_columns=incident_columns,
            lookup_columns=lookup_columns,
            salts=salts,
        )
        assert bag(counted) == bag(plain)


@pytest.mark.parametrize("seed", range(3))
def test_per_head_rate_equals_a_direct_count(spark, seed):
    incidents, lookup = random_tables(spark, seed)
    rows = [r for r in lookup.collect() if r.population is not None and r.district is not None]
    districts = sorted({r.district for r in rows})
    population = {d: sum(r.population for r in rows if r.district == d) for d in districts}
    main = {}
    for area in {r.area_name for r in rows} - {None}:
        count = {d: sum(r.area_name == area and r.district == d for r in rows) for d in districts}
        main[area] = min(districts, key=lambda d: (-count[d], d))
    found = [main.get(r.area_name) for r in incidents.where(in_categories(A)).collect()]
    result = by_district(per_head_rate(incidents, lookup, categories=A))
    assert {d: v[:2] for d, v in result.items()} == {
        d: (population[d], found.count(d)) for d in districts
    }


def test_per_head_counts_each_incident_and_resident_once(spark):
    lookup = lookup_of(spark, [("d", "x", 10)] * 3 + [("e", "y", 5), ("f", "z", 7)])
    result = by_district(per_head_rate(cases(spark, "x", "x", "y"), lookup, categories=A))
    assert result == {"d": (30, 2, 0.067), "e": (5, 1, 0.2), "f": (7, 0, 0.0)}


def test_area_in_two_districts_goes_to_the_one_with_more_rows_then_by_name(spark):
    lookup = lookup_of(
        spark,
        [("z", "x", 1), ("z", "x", 1), ("a", "x", 1), ("z", "tie", 1), ("a", "tie", 1)]
        + [(None, "x", 1)] * 5,
    )
    main = {r.area_name: r.district for r in lookup_districts(lookup).where("is_main").collect()}
    assert main == {"x": "z", "tie": "a"}


def test_population_zero_gives_no_rate(spark):
    lookup = lookup_of(spark, [("d", "x", 0)])
    assert by_district(joined_rate(cases(spark, "x"), lookup, categories=A)) == {"d": (0, 1, None)}
    assert by_district(per_head_rate(cases(spark, "x"), lookup, categories=A)) == {
        "d": (0, 1, None)
    }


def test_null_and_unknown_areas_do_not_join(spark):
    lookup = lookup_of(spark, [("d", "x", 4), ("d", None, 9), ("e", "y", None)])
    incidents = cases(spark, "x", "y", "elsewhere", None)
    assert by_district(joined_rate(incidents, lookup, categories=A)) == {"d": (4, 1, 0.25)}


def test_null_district_is_a_group_of_the_joined_rate(spark):
    lookup = lookup_of(spark, [(None, "x", 4)])
    assert by_district(joined_rate(cases(spark, "x"), lookup, categories=A)) == {
        None: (4, 1, 0.25)
    }


def test_other_categories_do_not_count(spark):
    incidents = cases(spark, "x", category="c1")
    assert joined_rate(incidents, lookup_of(spark, [("d", "x", 4)]), categories=A).count() == 0


def test_top_k_breaks_ties_by_key_and_puts_nulls_last(spark):
    rows = [("c", 0.5), ("b", 0.5), ("a", None), ("d", 0.9), ("e", 0.1)]
    df = spark.createDataFrame(rows, "district string, rate double")
    top = top_k(df, by="rate", tie_break="district", k=2).collect()
    assert [row.district for row in top] == ["d", "b"]
    everything = top_k(df, by="rate", tie_break="district").collect()
    assert [row.district for row in everything] == ["d", "b", "c", "e", "a"]


RATES = "district string, cases_per_head double"


def test_comparison_with_the_top(spark):
    rates = spark.createDataFrame(
        [("B", 4.0), ("A", 4.0), ("C", 2.0), ("D", 0.0), ("E", None)], RATES
    )
    rows = {name: tuple(compare_with_top(rates, name).first()) for name in "ABCDEX"}
    assert rows["A"] == ("A", 1, 4.0, "A", 4.0, 1.0)
    assert rows["B"] == ("B", 1, 4.0, "A", 4.0, 1.0)
    assert rows["C"] == ("C", 3, 2.0, "A", 4.0, 2.0)
    assert rows["D"] == ("D", 4, 0.0, "A", 4.0, None)
    assert rows["E"] == ("E", None, None, "A", 4.0, None)
    assert rows["X"] == ("X", None, None, "A", 4.0, None)
    none = compare_with_top(spark.createDataFrame([], RATES), "A").collect()
    assert [tuple(row) for row in none] == [("A", None, None, None, None, None)]


def test_a_bare_string_is_no_category_set():
    with pytest.raises(TypeError, match="sequence"):
        in_categories("Drugs")


def test_comparison_computes_the_rates_once(spark, tmp_path):
    """Everything after the first pass is read from the staged rates."""
    path = str(tmp_path / "rates")
    spark.createDataFrame([("A", 0.5), ("B", 1.0)], RATES).write.parquet(path)
    compared = compare_with_top(spark.read.parquet(path), "A")
    assert path not in compared._jdf.queryExecution().executedPlan().toString()
    assert compared.first().rank == 2
