"""Translate incident coordinates to postcodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def translate_points(incidents: DataFrame, points: DataFrame) -> DataFrame:
    """Add the ``postcode`` of each incident's map point; null where there is none.

    A point listed more than once counts once, with its smallest postcode, so every incident
    keeps exactly one row. Coordinates are compared as strings, as written in the files,
    never as doubles. Points are grouped by the pair of coordinates, which is not how the
    join spreads them; both its inputs therefore come straight from a shuffle, and AQE splits
    a hot point, or the incidents without coordinates, over several tasks.
    """
    keys = ["longitude", "latitude"]
    single = points.groupBy(F.struct(*keys).alias("point")).agg(F.min("postcode").alias("postcode"))
    return incidents.join(single.select("point.*", "postcode"), keys, "left")
