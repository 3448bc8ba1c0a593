"""Top-k."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def top_k(df: DataFrame, *, by: str, tie_break: str, k: int = 10) -> DataFrame:
    """The ``k`` rows with the highest ``by``; equal values rank by ``tie_break``.

    Runs as a bounded heap per task (TakeOrderedAndProject), not as a full sort.
    Nulls come last.
    """
    return df.orderBy(F.desc_nulls_last(by), F.asc(tie_break)).limit(k)
