"""Contingency tables over pairs of labels."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from precinct.operators.fanout import SALTS, salted_join


def assemble_vector(df: DataFrame, columns: list[str], output: str = "vector") -> DataFrame:
    """Pack numeric columns into one vector column; rows with null or NaN are skipped."""
    return VectorAssembler(inputCols=columns, outputCol=output, handleInvalid="skip").transform(df)


def contingency_statistic(
    pairs: DataFrame, *, feature: str, label: str, salts: int = SALTS
) -> DataFrame:
    """Pearson's chi-square statistic of two label columns, as one row.

    With cell counts ``o``, row totals ``r``, column totals ``c`` and ``n`` pairs the
    statistic is ``n * (sum(o * o / (r * c)) - 1)``, so only occupied cells are needed,
    the pairs are read once and nothing but counts is shuffled. There is no limit on
    distinct values. A label that most cells have is absorbed by partial aggregates, and
    spread over ``salts`` tasks in the join with its total; a feature is absorbed the same
    way. Pairs with a null on either side are left out. No pairs give ``n_groups = 0`` and
    nulls.
    """
    cells = (
        pairs.select(F.col(feature).alias("f"), F.col(label).alias("l"))
        .where(F.col("f").isNotNull() & F.col("l").isNotNull())
        .groupBy("f", "l")
        .agg(F.count(F.lit(1)).alias("o"))
    )
    # The smallest partner marks one cell per label, which turns the distinct count of the
    # labels below into a plain conditional one.
    labels = cells.groupBy("l").agg(F.sum("o").alias("c"), F.min("f").alias("first"))
    joined = salted_join(cells, labels, "l", spread_by=["f"], salts=salts)
    features = joined.groupBy("f").agg(
        F.sum(F.col("o").cast("double") * F.col("o") / F.col("c")).alias("share"),
        F.sum("o").alias("r"),
        F.count(F.lit(1)).alias("n_cells"),
        F.count_if(F.col("f") == F.col("first")).alias("n_labels"),
    )
    zero = F.lit(0)
    totals = features.agg(
        F.coalesce(F.sum("r"), zero).alias("n_groups"),
        F.count(F.lit(1)).alias("n_features"),
        F.coalesce(F.sum("n_labels"), zero).alias("n_labels"),
        F.coalesce(F.sum("n_cells"), zero).alias("n_cells"),
        F.sum(F.col("share") / F.col("r")).alias("share"),
    )
    occupied = F.col("n_groups") > 0
    freedom = (F.col("n_features") - 1) * (F.col("n_labels") - 1)
    # A constant side makes the statistic 0, whatever rounding leaves of the sum.
    statistic = F.when(freedom == 0, 0.0).otherwise(
        F.greatest(F.col("n_groups") * (F.col("share") - 1), F.lit(0.0))
    )
    return totals.select(
        F.when(occupied, statistic).alias("statistic"),
        F.when(occupied, freedom).alias("degrees_of_freedom"),
        "n_groups",
        "n_features",
        "n_labels",
        "n_cells",
    )
