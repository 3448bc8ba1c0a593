"""One local session for all tests."""

from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

from precinct.session import get_session  # noqa: E402
from precinct.sources.shared import remove_scratch  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = get_session(
        "precinct-tests",
        master="local[4]",
        conf={
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "4g",
            "spark.sql.maxMetadataStringLength": "2000",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    remove_scratch(session)
    session.stop()


@pytest.fixture(scope="session")
def sf_dir() -> str:
    return os.environ.get("PRECINCT_SF_DIR", "/root/testdata/sf0.001")

