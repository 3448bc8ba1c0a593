"""Ratio and change measures as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(numerator: Column, denominator: Column, digits: int | None = None) -> Column:
    """``numerator / denominator``, null where the denominator is 0."""
    value = F.try_divide(numerator, denominator)
    return value if digits is None else F.round(value, digits)


def percentage_change(
    current: Column, previous: Column, *, base: str = "current", digits: int | None = 2
) -> Column:
    """Change from ``previous`` to ``current`` in percent of ``base``.

    ``base="current"`` divides by the current value and so never exceeds the usual
    definition, ``base="previous"``, for positive values.
    """
    if base not in ("current", "previous"):
        raise ValueError(f"base must be 'current' or 'previous', not {base!r}")
    divisor = current if base == "current" else previous
    change = 100 * ratio(current - previous, divisor)
    return change if digits is None else F.round(change, digits)
