from __future__ import annotations

import math
import random

import pytest
from pyspark.ml.stat import ChiSquareTest

from helpers import A, B, bag, incidents_of, lookup_of, plain_join, random_tables, sql_set
from precinct.operators.contingency import assemble_vector, contingency_statistic
from precinct.operators.fanout import lookup_districts
from precinct.plans import association as module
from precinct.plans.association import association, chi_square, chi_square_tail, paired_counts


def pairs_of(spark, pairs):
    rows = [(str(i), left, right) for i, (left, right) in enumerate(pairs)]
    return spark.createDataFrame(rows, "key string, left_count bigint, right_count bigint")


def brute_statistic(pairs):
    """Sum of (observed - expected)^2 / expected over the full table."""
    n = len(pairs)
    lefts, rights = {p[0] for p in pairs}, {p[1] for p in pairs}
    total = 0.0
    for left in lefts:
        for right in rights:
            expected = (
                sum(p[0] == left for p in pairs) * sum(p[1] == right for p in pairs) / n
            )
            total += (pairs.count((left, right)) - expected) ** 2 / expected
    return total, (len(lefts) - 1) * (len(rights) - 1)


@pytest.mark.parametrize("key", ["area_code", "district"])
@pytest.mark.parametrize("seed", range(3))
def test_paired_counts_equal_two_counts_and_a_join(spark, seed, key):
    incidents, lookup = random_tables(spark, seed)
    plain_join(spark, incidents, lookup)
    plain = spark.sql(
        f"""SELECT * FROM
              (SELECT {key} AS key, count(*) AS left_count FROM joined
               WHERE category IN {sql_set(A)} GROUP BY {key})
            JOIN
              (SELECT {key} AS key, count(*) AS right_count FROM joined
               WHERE category IN {sql_set(B)} GROUP BY {key}) USING (key)"""
    )
    for salts in (1, 32):
        counted = paired_counts(incidents, lookup, left=A, right=B, key=key, salts=salts)
        assert bag(counted, "key", "left_count", "right_count") == bag(
            plain, "key", "left_count", "right_count"
        )


@pytest.mark.parametrize("key", ["area_code", "district"])
def test_paired_counts_without_fanout(spark, key):
    incidents, lookup = random_tables(spark, 5)
    place = {r.area_name: r.district for r in lookup_districts(lookup).where("is_main").collect()}
    known = {r.area_name for r in lookup.where("population is not null").collect()} - {None}
    counts: dict = {}
    for row in incidents.collect():
        group = row.area_code if key == "area_code" else place.get(row.area_name)
        if row.area_name in known and group is not None:
            entry = counts.setdefault(group, [0, 0])
            entry[0] += row.category in A
            entry[1] += row.category in B
    expected = sorted((k, a, b) for k, (a, b) in counts.items() if a and b)
    result = paired_counts(incidents, lookup, left=A, right=B, key=key, fanout=False)
    assert bag(result, "key", "left_count", "right_count") == expected


def test_key_with_only_one_of_the_categories_is_left_out(spark):
    rows = [
        ("1", "2020-01", "both", "n", "a1"),
        ("2", "2020-01", "both", "n", "b1"),
        ("3", "2020-01", "left only", "n", "a2"),
        ("4", "2020-01", None, "n", "a1"),
        ("5", "2020-01", None, "n", "b1"),
    ]
    lookup = lookup_of(spark, [("d", "n", 1)] * 3)
    result = paired_counts(incidents_of(spark, rows), lookup, left=A, right=B, key="area_code")
    assert bag(result, "key", "left_count", "right_count") == [("both", 3, 3)]


def test_category_in_both_sets_counts_on_both_sides(spark):
    rows = [("1", "2020-01", "c", "n", "a1")]
    lookup = lookup_of(spark, [("d", "n", 1)])
    result = paired_counts(incidents_of(spark, rows), lookup, left=A, right=["a1"], key="district")
    assert bag(result, "key", "left_count", "right_count") == [("d", 1, 1)]


def test_unknown_key_is_refused(spark):
    incidents, lookup = random_tables(spark, 0)
    with pytest.raises(ValueError, match="key"):
        paired_counts(incidents, lookup, left=A, right=B, key="area_name")


@pytest.mark.parametrize("seed", range(3))
def test_statistic_equals_brute_force_and_spark_ml(spark, seed):
    rng = random.Random(seed)
    pairs = [(rng.randrange(1, 5), rng.randrange(1, 7)) for _ in range(90)]
    frame = pairs_of(spark, pairs)
    ours = contingency_statistic(frame, feature="right_count", label="left_count").first()
    statistic, freedom = brute_statistic(pairs)
    assert ours.statistic == pytest.approx(statistic, abs=1e-9)
    assert ours.degrees_of_freedom == freedom
    assert (ours.n_groups, ours.n_cells) == (90, len(set(pairs)))
    vectors = assemble_vector(frame, ["right_count"])
    ml = ChiSquareTest.test(vectors, "vector", "left_count", flatten=True).first()
    assert ours.statistic == pytest.approx(ml.statistic, abs=1e-9)
    tested = chi_square(frame).first()
    assert tested.p_value == pytest.approx(ml.pValue, abs=1e-12)
    assert tested.associated == (ml.pValue < 0.05)
    assert (tested.n_left, tested.n_right) == (
        len({p[0] for p in pairs}),
        len({p[1] for p in pairs}),
    )
    assert not tested.degenerate


def test_all_distinct_counts_are_degenerate(spark):
    for order in ([5, 4, 3, 2, 1], [2, 1, 4, 3, 5]):
        row = chi_square(pairs_of(spark, list(zip(range(1, 6), order)))).first()
        assert row.statistic == pytest.approx(20.0)
        assert row.degrees_of_freedom == 16
        assert row.p_value == pytest.approx(0.2202, abs=1e-4)
        assert row.degenerate


def test_one_distinct_side_alone_fixes_the_statistic(spark):
    for rights in ([1, 1, 1, 2, 2, 3], [3, 2, 1, 1, 2, 1]):
        row = chi_square(pairs_of(spark, list(zip(range(6), rights)))).first()
        assert row.statistic == pytest.approx(6 * (3 - 1))
        assert row.degenerate


def test_constant_counts(spark):
    row = chi_square(pairs_of(spark, [(1, 1), (1, 2), (1, 2)])).first()
    assert (row.statistic, row.degrees_of_freedom, row.p_value) == (0.0, 0, 1.0)
    assert row.degenerate and not row.associated


def test_no_pairs_give_nulls(spark):
    row = chi_square(pairs_of(spark, [])).first()
    assert (row.statistic, row.degrees_of_freedom, row.p_value) == (None, None, None)
    assert row.n_groups == 0 and row.degenerate is None


def test_pairs_with_a_null_are_skipped(spark):
    pairs = [(1, 1), (1, 2), (2, 1), (2, 2), (2, 2)]
    frame = pairs_of(spark, [*pairs, (None, 3), (7, None)])
    assert chi_square(frame).first() == chi_square(pairs_of(spark, pairs)).first()


def test_assembler_skips_null_and_nan(spark):
    rows = [(1.0,), (None,), (math.nan,)]
    assembled = assemble_vector(spark.createDataFrame(rows, "x double"), ["x"])
    assert [row.vector.toArray().tolist() for row in assembled.collect()] == [[1.0]]


def test_alpha_decides_associated(spark):
    rng = random.Random(1)
    pairs = [(v, v if rng.random() < 0.4 else rng.randrange(3)) for v in [0, 1, 2] * 20]
    p_value = chi_square(pairs_of(spark, pairs)).first().p_value
    assert 0 < p_value < 1
    assert chi_square(pairs_of(spark, pairs), alpha=p_value * 1.01).first().associated
    assert not chi_square(pairs_of(spark, pairs), alpha=p_value).first().associated


def test_more_than_10000_distinct_values(spark):
    frame = spark.range(30_000).selectExpr(
        "cast(id AS string) AS key",
        "abs(hash(id)) % 12 AS left_count",
        "id % 15000 AS right_count",
    )
    row = chi_square(frame).first()
    counts: dict = {}
    for pair in frame.collect():
        counts[pair.left_count, pair.right_count] = (
            counts.get((pair.left_count, pair.right_count), 0) + 1
        )
    left_totals: dict = {}
    right_totals: dict = {}
    for (left, right), n in counts.items():
        left_totals[left] = left_totals.get(left, 0) + n
        right_totals[right] = right_totals.get(right, 0) + n
    statistic = sum(
        (counts.get((left, right), 0) - l_n * r_n / 30_000) ** 2 / (l_n * r_n / 30_000)
        for left, l_n in left_totals.items()
        for right, r_n in right_totals.items()
    )
    assert row.statistic == pytest.approx(statistic, rel=1e-9)
    assert row.degrees_of_freedom == 14_999 * 11
    assert not row.degenerate
    assert row.p_value == pytest.approx(chi_square_tail(spark, statistic, 14_999 * 11))


def test_more_than_10000_values_against_a_constant(spark):
    frame = spark.range(10_001).selectExpr(
        "cast(id AS string) AS key", "1 AS left_count", "id AS right_count"
    )
    row = chi_square(frame).first()
    assert (row.statistic, row.degrees_of_freedom, row.p_value) == (0.0, 0, 1.0)
    assert row.degenerate


@pytest.mark.parametrize("freedom", [5_000, 10_000, 40_000])
@pytest.mark.parametrize("deviations", [-3, -1, 0, 0.5, 2, 4])
def test_tail_matches_the_power_series(spark, freedom, deviations):
    statistic = freedom + deviations * math.sqrt(2 * freedom)
    a, x = freedom / 2, statistic / 2
    below = math.fsum(
        math.exp((a + i) * math.log(x) - x - math.lgamma(a + i + 1)) for i in range(20_000)
    )
    assert chi_square_tail(spark, statistic, freedom) == pytest.approx(1 - below, abs=1e-6)


def test_tail_at_the_edges(spark):
    assert chi_square_tail(spark, 0.0, 0) == 1.0
    assert chi_square_tail(spark, 0.0, 10_000) == pytest.approx(1.0)
    assert chi_square_tail(spark, 1e9, 10_000) == 0.0
    assert chi_square_tail(spark, 1e9, 10**9) == pytest.approx(0.5, abs=1e-4)


@pytest.mark.parametrize("seed", range(3))
def test_statistic_does_not_depend_on_salts(spark, seed):
    rng = random.Random(seed)
    frame = pairs_of(spark, [(0 if rng.random() < 0.9 else rng.randrange(9), rng.randrange(40)) for _ in range(300)])
    results = [
        contingency_statistic(frame, feature="right_count", label="left_count", salts=salts).first()
        for salts in (1, 7, 32)
    ]
    assert len({r.n_labels for r in results}) == 1
    assert all(r.statistic == pytest.approx(results[0].statistic, rel=1e-12) for r in results)


def test_association_runs_both_steps(spark):
    incidents, lookup = random_tables(spark, 2)
    pairs = paired_counts(incidents, lookup, left=A, right=B, key="area_code")
    combined = association(incidents, lookup, left=A, right=B, key="area_code")
    assert combined.first() == chi_square(pairs).first()
    assert combined.columns == [part.split()[0] for part in module.ASSOCIATION.split(", ")]
