"""Association: do areas with many incidents of one kind have many of another?"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from precinct.operators.contingency import contingency_statistic
from precinct.operators.fanout import (
    AREA,
    SALTS,
    in_categories,
    incidents_in,
    lookup_counts,
    lookup_districts,
    salted_join,
)

ASSOCIATION = (
    "statistic double, degrees_of_freedom bigint, p_value double, n_groups bigint, "
    "n_left bigint, n_right bigint, degenerate boolean, associated boolean"
)


def paired_counts(
    incidents: DataFrame,
    lookup: DataFrame,
    *,
    left: Sequence[str],
    right: Sequence[str],
    key: str,
    fanout: bool = True,
    salts: int = SALTS,
) -> DataFrame:
    """Incidents of two category sets per ``key``, for keys that have both.

    ``key`` is ``"area_code"`` or ``"district"``. With ``fanout`` an incident counts
    once per lookup row of its area, as in the joined table; without, once, in the
    main district of its area. Areas that are not in the lookup do not count.

    Both sets are counted in one pass by conditional aggregates. For area codes, one
    area name may hold very many codes after counting, so that join is salted.
    """
    if key not in ("area_code", "district"):
        raise ValueError(f"key must be 'area_code' or 'district', not {key!r}")
    grain = [key] if key == "area_code" else []
    each = incidents_in(incidents)
    counts = (
        incidents.where(in_categories([*left, *right]))
        .where(F.col(AREA).isNotNull())
        .groupBy(AREA, *grain)
        .agg(
            F.sum(F.when(in_categories(left), each).otherwise(0)).alias("n_left"),
            F.sum(F.when(in_categories(right), each).otherwise(0)).alias("n_right"),
        )
    )
    if key == "area_code":
        counts = counts.where(F.col("area_code").isNotNull())
        weights = lookup_counts(lookup)
        if not fanout:
            weights = weights.withColumn("n_lookup", F.lit(1))
        weights = weights.select(AREA, "n_lookup")
        joined = salted_join(counts, weights, AREA, spread_by=["area_code"], salts=salts)
    else:
        if fanout:
            weights = lookup_counts(lookup, "district").where(F.col("district").isNotNull())
        else:
            weights = lookup_districts(lookup).where("is_main").withColumn("n_lookup", F.lit(1))
        joined = counts.join(weights.select(AREA, "district", "n_lookup"), AREA, "inner")
    return (
        joined.groupBy(F.col(key).alias("key"))
        .agg(
            F.sum(F.col("n_left") * F.col("n_lookup")).alias("left_count"),
            F.sum(F.col("n_right") * F.col("n_lookup")).alias("right_count"),
        )
        .where((F.col("left_count") > 0) & (F.col("right_count") > 0))
    )


def chi_square_tail(spark: SparkSession, statistic: float, degrees_of_freedom: int) -> float:
    """P(X >= statistic), from the distribution class that Spark's own tests use.

    Takes milliseconds at any number of degrees of freedom. The absolute error is below 1e-6
    up to 1e9 of them. Without any the probability is 1.
    """
    if degrees_of_freedom == 0:
        return 1.0
    library = spark.sparkContext._jvm.org.apache.commons.math3.distribution
    distribution = library.ChiSquaredDistribution(float(degrees_of_freedom))
    return 1.0 - distribution.cumulativeProbability(statistic)


def chi_square(
    pairs: DataFrame,
    *,
    feature: str = "right_count",
    label: str = "left_count",
    alpha: float = 0.05,
    salts: int = SALTS,
) -> DataFrame:
    """Pearson chi-square independence test of two count columns, as one row.

    The test takes the counts as unordered labels. ``degenerate`` marks results that
    do not depend on how they are paired: when all values of one side differ the
    statistic is ``n_groups * (distinct values of the other side - 1)``, and when one
    side is constant it is 0. No pairs give nulls.

    Every size of table takes the same way: one pass counts the occupied cells, and only
    the summary row reaches the driver, where ``chi_square_tail`` gives the p-value.
    """
    spark = pairs.sparkSession
    table = contingency_statistic(pairs, feature=feature, label=label, salts=salts).first()
    if table.n_groups == 0:
        return spark.createDataFrame([(None, None, None, 0, 0, 0, None, None)], ASSOCIATION)
    degenerate = (
        table.n_groups in (table.n_features, table.n_labels) or table.degrees_of_freedom == 0
    )
    p_value = chi_square_tail(spark, table.statistic, table.degrees_of_freedom)
    row = (
        table.statistic,
        table.degrees_of_freedom,
        p_value,
        table.n_groups,
        table.n_labels,
        table.n_features,
        degenerate,
        p_value < alpha,
    )
    return spark.createDataFrame([row], ASSOCIATION)


def association(
    incidents: DataFrame,
    lookup: DataFrame,
    *,
    left: Sequence[str],
    right: Sequence[str],
    key: str,
    fanout: bool = True,
    alpha: float = 0.05,
    salts: int = SALTS,
) -> DataFrame:
    """Paired counts and their chi-square test in one call.

    ``right_count`` is the feature and ``left_count`` the label; ``n_right`` and
    ``n_left`` are their numbers of distinct values. ``salts`` spreads hot areas and values.
    """
    pairs = paired_counts(
        incidents, lookup, left=left, right=right, key=key, fanout=fanout, salts=salts
    )
    return chi_square(pairs, alpha=alpha, salts=salts)
