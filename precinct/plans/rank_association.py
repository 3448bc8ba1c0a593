"""Association by ranks, and by shuffles, where the chi-square test has little to go by.

The chi-square test of two counts takes them as unordered labels, and its p-value needs some
pairs in every cell. Spearman's rho asks whether areas with more incidents of one kind have
more of another, ties included; the permutation test needs no full cells.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from precinct.operators.fanout import SALTS, salted_join
from precinct.operators.ranks import double_ranks, rows_before
from precinct.operators.shuffles import shuffled_cells
from precinct.plans.association import paired_counts
from precinct.sources.shared import staged

RANKED = "n_groups bigint, rho double, t_statistic double, p_value double, associated boolean"
SHUFFLED = "n_groups bigint, n_shuffles bigint, n_at_least bigint, p_value double, associated boolean"
# Shares of cells count in this unit, so that their sums are the same in any order.
UNIT = 1_000_000_000_000
SHUFFLES = 199
SEED = "precinct"


def _cells(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """How many pairs have each two values; pairs with a null on either side are left out."""
    return (
        pairs.select(F.col(left).alias("l"), F.col(right).alias("r"))
        .where(F.col("l").isNotNull() & F.col("r").isNotNull())
        .groupBy("l", "r")
        .agg(F.count(F.lit(1)).alias("o"))
    )


def rank_sums(
    pairs: DataFrame, *, left: str = "left_count", right: str = "right_count", salts: int = SALTS
) -> DataFrame:
    """Spearman's rho of two columns, with ``n_groups`` and ``t_statistic``, as one row.

    Pairs are counted by their two values first, so ranks are those of counted values, and a
    value that most pairs have is one row per partner. All sums are decimals: exact whatever
    their order, up to 1e9 pairs. Rho is null if one side is constant or there are no pairs;
    ``t_statistic`` is null as well where rho is 1 or -1.
    """
    cells = staged(_cells(pairs, left, right), "rank-cells")
    for side in ("l", "r"):
        other = "r" if side == "l" else "l"
        values = cells.groupBy(side).agg(F.sum("o").alias("n"))
        ranks = double_ranks(values, side, "n").select(side, F.col("double_rank").alias(f"{side}_rank"))
        cells = salted_join(cells, ranks, side, spread_by=[other], salts=salts)
    big = "decimal(38,0)"

    def total(*factors: str) -> Column:
        product = F.col("o").cast("decimal(10,0)")
        for factor in factors:
            product = product * F.col(factor).cast("decimal(12,0)")
        return F.coalesce(F.sum(product).cast(big), F.lit(0).cast(big))

    sums = cells.agg(
        F.coalesce(F.sum("o"), F.lit(0)).alias("n_groups"),
        total("l_rank").alias("x"), total("r_rank").alias("y"),
        total("l_rank", "l_rank").alias("xx"), total("r_rank", "r_rank").alias("yy"), total("l_rank", "r_rank").alias("xy"),
    )

    def spread(squares: str, one: str, other: str) -> Column:
        n = F.col("n_groups").cast("decimal(10,0)")
        return ((n * F.col(squares)).cast(big) - (F.col(one) * F.col(other)).cast(big)).cast("double")

    scale = F.sqrt(spread("xx", "x", "x") * spread("yy", "y", "y"))
    rho = F.when(scale > 0, spread("xy", "x", "y") / scale)
    known = F.abs("rho") < 1
    t_statistic = F.when(known, F.col("rho") * F.sqrt((F.col("n_groups") - 2) / (1 - F.col("rho") * F.col("rho"))))
    return sums.withColumn("rho", rho).select("n_groups", "rho", t_statistic.alias("t_statistic"))


def student_tails(spark: SparkSession, statistic: float, degrees_of_freedom: int) -> float:
    """P(|T| >= |statistic|), from the distribution class that ships with Spark."""
    library = spark.sparkContext._jvm.org.apache.commons.math3.distribution
    return 2.0 * library.TDistribution(float(degrees_of_freedom)).cumulativeProbability(-abs(statistic))


def spearman(
    pairs: DataFrame,
    *,
    left: str = "left_count",
    right: str = "right_count",
    alpha: float = 0.05,
    salts: int = SALTS,
) -> DataFrame:
    """Spearman's rank correlation of two columns with its two-sided p-value, as one row.

    The p-value is that of Student's t with n - 2 degrees of freedom, good for ten pairs or
    more. Under three pairs, or with a constant side, it is null; a perfect order gives 0.
    """
    spark = pairs.sparkSession
    row = rank_sums(pairs, left=left, right=right, salts=salts).first()
    p_value = None
    if row.rho is not None and row.n_groups > 2:
        p_value = 0.0 if row.t_statistic is None else student_tails(spark, row.t_statistic, row.n_groups - 2)
    associated = None if p_value is None else p_value < alpha
    return spark.createDataFrame([(row.n_groups, row.rho, row.t_statistic, p_value, associated)], RANKED)


def _shares(cells: DataFrame, by: list[str], lefts: DataFrame, rights: DataFrame, salts: int) -> DataFrame:
    """Sum of o * o / (row total * column total) over the cells of each shuffle, in units."""
    joined = salted_join(cells, lefts, "l", spread_by=["r"], salts=salts)
    joined = salted_join(joined, rights, "r", spread_by=["l"], salts=salts)
    share = F.expr(f"CAST(o AS DECIMAL(12,0)) * o * {UNIT} DIV (CAST(n_l AS DECIMAL(12,0)) * n_r)")
    return joined.groupBy(*by).agg(F.sum(share).alias("share"))


def permutation_test(
    pairs: DataFrame,
    *,
    key: str = "key",
    left: str = "left_count",
    right: str = "right_count",
    shuffles: int = SHUFFLES,
    seed: str = SEED,
    alpha: float = 0.05,
    salts: int = SALTS,
) -> DataFrame:
    """P-value of the chi-square statistic by shuffling one side of the pairs, as one row.

    Makes no assumption on how full the cells are, so it holds for sparse tables. Shuffle b
    puts the pairs in the order of the digests of ``seed:b:key``; the left values keep order 0
    and the right values take order b. The same seed gives the same shuffles everywhere. The
    statistic grows with the sum of o * o / (row total * column total) alone, which is summed
    in integers. ``n_at_least`` shuffles have at least the observed one, and the p-value is
    (n_at_least + 1) / (shuffles + 1), never 0.

    Values are numbered, and ``shuffled_cells`` puts the numbers in each order by stretches.
    Keys must be distinct. Pairs with a null on either side are left out; none give nulls.
    """
    spark = pairs.sparkSession
    known = staged(
        pairs.select(F.col(key).cast("string").alias("key"), F.col(left).alias("l"), F.col(right).alias("r"))
        .where(F.col("l").isNotNull() & F.col("r").isNotNull()),
        "shuffled-pairs",
    )
    n = known.count()
    if n == 0:
        return spark.createDataFrame([(0, shuffles, None, None, None)], SHUFFLED)
    totals, numbered = {}, known
    for side in ("l", "r"):
        values = known.groupBy(side).agg(F.count(F.lit(1)).alias(f"n_{side}"))
        numbers = staged(rows_before(values, [side], output="number"), "numbers")
        numbered = salted_join(numbered, numbers.select(side, "number"), side, spread_by=["key"], salts=salts)
        numbered = numbered.drop(side).withColumnRenamed("number", side)
        totals[side] = numbers.select(F.col("number").alias(side), f"n_{side}")
    numbered = staged(numbered, "numbered-pairs")
    observed = _shares(_cells(numbered, "l", "r"), [], totals["l"], totals["r"], salts).first().share
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col("b").cast("string"), F.lit(":"), F.col("key")))
    # A null key has no digest, and stands first in each order.
    digest = F.unhex(F.coalesce(digest, F.lit("0" * 32)))
    cells = shuffled_cells(numbered, digest, left="l", right="r", n=n, shuffles=shuffles)
    at_least = _shares(cells, ["b"], totals["l"], totals["r"], salts).where(F.col("share") >= observed).count()
    p_value = (at_least + 1) / (shuffles + 1)
    return spark.createDataFrame([(n, shuffles, at_least, p_value, p_value < alpha)], SHUFFLED)


def ranked_association(
    incidents: DataFrame, lookup: DataFrame, *, left: Sequence[str], right: Sequence[str], key: str,
    fanout: bool = True, alpha: float = 0.05, salts: int = SALTS,
) -> DataFrame:
    """Paired counts and their rank correlation in one call; see ``association``."""
    pairs = paired_counts(incidents, lookup, left=left, right=right, key=key, fanout=fanout, salts=salts)
    return spearman(pairs, alpha=alpha, salts=salts)


def shuffled_association(
    incidents: DataFrame, lookup: DataFrame, *, left: Sequence[str], right: Sequence[str], key: str,
    fanout: bool = True, shuffles: int = SHUFFLES, alpha: float = 0.05, salts: int = SALTS,
) -> DataFrame:
    """Paired counts and their permutation test in one call; see ``association``."""
    pairs = paired_counts(incidents, lookup, left=left, right=right, key=key, fanout=fanout, salts=salts)
    return permutation_test(pairs, shuffles=shuffles, alpha=alpha, salts=salts)
