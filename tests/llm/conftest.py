from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

import brute  # noqa: E402


@pytest.fixture(scope="session")
def trouble(spark):
    """Documents with nulls, empty and long texts and repeats, and columns with clashing names."""
    docs = spark.createDataFrame(brute.TROUBLE, brute.DOCUMENTS)
    clashing = ["row", "key", "digest", "size", "copy", "spans", "candidates", "words", "runs", "n_words", "target"]
    return docs.selectExpr("*", *[f"'mine' AS `{name}`" for name in clashing], "1 AS `a.b`")


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], brute.DOCUMENTS)
