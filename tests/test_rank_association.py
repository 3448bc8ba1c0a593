"""Rank correlation and permutation test against plain versions."""

from __future__ import annotations

import hashlib
import itertools
import random
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from helpers import A, B, bag, plain_join, random_tables, sql_set
from precinct.operators.ranks import double_ranks, rows_before
from precinct.operators.shuffles import shuffled_cells
from precinct.plans.rank_association import (
    permutation_test,
    rank_sums,
    ranked_association,
    shuffled_association,
    spearman,
)
from precinct.sources.shared import shared_dir
from workload.catalog import QUERIES

SCHEMA = "key string, left_count bigint, right_count bigint"


def pairs_of(spark, rows):
    return spark.createDataFrame([(f"k{i}", *row) for i, row in enumerate(rows)], SCHEMA)


def mean_ranks(values):
    order = sorted(values)
    return [order.index(v) + (order.count(v) + 1) / 2 for v in values]


def plain_rho(rows):
    x, y = (mean_ranks(side) for side in zip(*rows))
    n, mx, my = len(x), sum(x) / len(x), sum(y) / len(y)
    xy = sum((a - mx) * (b - my) for a, b in zip(x, y))
    return xy / (sum((a - mx) ** 2 for a in x) * sum((b - my) ** 2 for b in y)) ** 0.5


def share(rows):
    lefts, rights = Counter(a for a, _ in rows), Counter(b for _, b in rows)
    return sum(o * o * 10**12 // (lefts[a] * rights[b]) for (a, b), o in Counter(rows).items())


@pytest.mark.parametrize("seed", range(4))
def test_rho_with_ties_equals_the_correlation_of_mean_ranks(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.randrange(1, 9), rng.randrange(1, 30)) for _ in range(120)]
    rows += [(5, 5)] * 100  # a cell with nearly half of all pairs
    found = spearman(pairs_of(spark, rows).repartition(7)).first()
    assert found.n_groups == len(rows)
    assert found.rho == pytest.approx(plain_rho(rows), abs=1e-12)
    t = found.rho * ((len(rows) - 2) / (1 - found.rho**2)) ** 0.5
    assert found.t_statistic == pytest.approx(t) and 0 <= found.p_value <= 1


def test_p_value_of_a_known_table(spark):
    """Ten pairs with rho 0.503: t is 1.646 with 8 degrees of freedom."""
    y = next(p for p in itertools.permutations(range(10)) if sum((a - b) ** 2 for a, b in enumerate(p)) == 82)
    rows = list(enumerate(y))
    found = spearman(pairs_of(spark, rows)).first()
    assert found.rho == pytest.approx(1 - 6 * 82 / 990)
    assert found.p_value == pytest.approx(0.1376, abs=2e-3) and not found.associated


@pytest.mark.parametrize(
    ("rows", "rho", "p_value"),
    [
        ([], None, None),
        ([(1, 1)], None, None),
        ([(1, 1), (2, 2)], 1.0, None),
        ([(1, 7), (2, 7), (3, 7)], None, None),
        ([(1, 1), (2, 2), (3, 3), (4, 4)], 1.0, 0.0),
        ([(1, 4), (2, 3), (3, 2), (4, 1)], -1.0, 0.0),
        ([(None, 1), (2, None)], None, None),
    ],
)
def test_edges_of_rho(spark, rows, rho, p_value):
    found = spearman(pairs_of(spark, rows)).first()
    assert (found.rho, found.p_value) == (rho, p_value)


def test_ranks_over_many_partitions_and_one_hot_value(spark):
    rows = [(7, 10_000)] + [(v, 1 + v % 3) for v in range(50) if v != 7]
    found = double_ranks(spark.createDataFrame(rows, "v int, n bigint").repartition(9), "v", "n").collect()
    values = [v for v, n in rows for _ in range(n)]
    before = {v: sum(n for w, n in rows if w < v) for v, _ in rows}
    assert len(values) == sum(n for _, n in rows)
    assert {r.v: r.double_rank for r in found} == {v: 2 * before[v] + n + 1 for v, n in rows}


def test_places_count_up(spark):
    numbers = rows_before(spark.range(1000).repartition(11), [F.desc("id")], output="place")
    assert {r.id: r.place for r in numbers.collect()} == {k: 999 - k for k in range(1000)}


def test_plans_have_no_window_over_all_pairs(spark):
    """The only window without a partition is over one row for each partition of a sort."""
    pairs = pairs_of(spark, [(k % 13, k % 7) for k in range(500)])
    for frame in (rank_sums(pairs), rows_before(pairs, ["key"], output="place")):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan and "Python" not in plan
        assert "windowspecdefinition(left_count" not in plan and "windowspecdefinition(key" not in plan


def test_shuffles_against_full_enumeration(spark):
    """Six pairs have 720 orders; the seeded shuffles come close to all of them."""
    rows = [(1, 1), (1, 1), (2, 2), (2, 2), (3, 2), (3, 3)]
    lefts, rights = [a for a, _ in rows], [b for _, b in rows]
    orders = list(itertools.permutations(rights))
    exact = sum(share(list(zip(lefts, order))) >= share(rows) for order in orders) / len(orders)
    found = permutation_test(pairs_of(spark, rows), shuffles=1999).first()
    assert found.n_groups == 6 and found.n_shuffles == 1999
    assert found.p_value == (found.n_at_least + 1) / 2000
    assert abs(found.p_value - exact) < 4 * (exact * (1 - exact) / 1999) ** 0.5 + 1 / 2000
    again = permutation_test(pairs_of(spark, rows).repartition(5), shuffles=1999).first()
    other = permutation_test(pairs_of(spark, rows), shuffles=1999, seed="other").first()
    assert again == found and other.n_at_least != found.n_at_least


def test_shuffles_tell_tied_from_unrelated(spark):
    rng = random.Random(2)
    tied = [(k % 20, k % 20) for k in range(60)]
    free = [(rng.randrange(20), rng.randrange(20)) for _ in range(60)]
    assert permutation_test(pairs_of(spark, tied)).first().p_value == 1 / 200
    assert permutation_test(pairs_of(spark, free)).first().p_value > 0.02
    constant = permutation_test(pairs_of(spark, [(1, k) for k in range(9)]), shuffles=19).first()
    assert constant.p_value == 1.0 and not constant.associated
    for rows in ([], [(None, 3)]):
        assert tuple(permutation_test(pairs_of(spark, rows)).first()) == (0, 199, None, None, None)


def plain_cells(rows, shuffles):
    def order(b, side):
        return [row[side] for row in sorted(rows, key=lambda row: (hashlib.md5(f"{b}:{row[0]}".encode()).digest(), row[side]))]

    first = order(0, 1)
    return Counter((b, l, r) for b in range(1, shuffles + 1) for l, r in zip(first, order(b, 2)))


@pytest.mark.parametrize(("n", "keys", "stretch"), [(500, 500, 32), (500, 500, 1), (300, 20, 16), (9, 9, 1024), (1, 1, 4)])
def test_cells_of_stretches_are_those_of_whole_orders(spark, n, keys, stretch):
    """Stretches of digests and blocks of places end at different rows; equal keys keep together."""
    rng = random.Random(n + keys)
    rows = [(f"k{i % keys}", rng.randrange(min(n, 9)), rng.randrange(n)) for i in range(n)]
    pairs = spark.createDataFrame(rows, "key string, l bigint, r bigint").repartition(5)
    digest = F.unhex(F.md5(F.concat(F.col("b").cast("string"), F.lit(":"), F.col("key"))))
    found = shuffled_cells(pairs, digest, left="l", right="r", n=n, shuffles=6, stretch=stretch).collect()
    assert Counter({(c.b, c.l, c.r): c.o for c in found}) == plain_cells(rows, 6)
    assert len(found) == len({(c.b, c.l, c.r) for c in found})


def test_a_null_key_stands_first_in_each_order(spark):
    rows = [(None, 7, 9)] + [(f"k{i}", 1, i % 3) for i in range(30)]
    assert permutation_test(spark.createDataFrame(rows, SCHEMA), shuffles=19).first().p_value == 1.0


def test_shuffles_write_a_number_for_each_pair(spark):
    """Digests and keys as text, written for each pair of each shuffle, filled disks and hours."""
    rng = random.Random(5)
    pairs = pairs_of(spark, [(rng.randrange(30), rng.randrange(40)) for _ in range(2000)])
    folder = Path(shared_dir(spark).removeprefix("file:"))
    before = set(folder.rglob("*.parquet"))
    permutation_test(pairs)
    written = [file for file in set(folder.rglob("*.parquet")) - before if file.is_file()]
    assert written and sum(file.stat().st_size for file in written) < 8 * 2000 * 200


@pytest.mark.parametrize("key", ["area_code", "district"])
def test_association_from_incidents(spark, key):
    incidents, lookup = random_tables(spark, 3)
    plain_join(spark, incidents, lookup)
    counted = spark.sql(f"""
        SELECT count_if(category IN {sql_set(A)}) AS l, count_if(category IN {sql_set(B)}) AS r
        FROM joined WHERE {key} IS NOT NULL GROUP BY {key}""").where("l > 0 AND r > 0")
    rows = bag(counted, "l", "r")
    found = ranked_association(incidents, lookup, left=A, right=B, key=key).first()
    assert found.n_groups == len(rows)
    if found.rho is not None:
        assert found.rho == pytest.approx(plain_rho(rows))
    assert shuffled_association(incidents, lookup, left=A, right=B, key=key, shuffles=19).first().n_groups == len(rows)


def test_area_and_district_of_the_test_tables(spark, sf_dir):
    assert -1 <= QUERIES["association_ranked_area"](spark, sf_dir).first().rho <= 1
    assert QUERIES["association_shuffled_area"](spark, sf_dir).first().n_shuffles == 199
