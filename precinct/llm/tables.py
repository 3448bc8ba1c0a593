"""Helpers the operators share: word pattern, staged tables and text passed to Python."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from collections.abc import Callable, Iterator, Sequence
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

import precinct
from precinct.sources.shared import scratch_path

# Words of the n-gram operators: runs of digits, lower-case letters and everything beyond
# ASCII, in text whose A-Z have been lower-cased. In UTF-8 all bytes from 0x80 on belong to
# characters beyond ASCII, so the pattern works on bytes as well.
WORD_BYTES = rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# White space of the word counts, as listed in their contract.
SPACE = r"[\x20\x09-\x0D]+"


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application.

    The driver's file server hands it out, so it needs no folder the executors share. It
    does so as executors come, which is why the file stays until the driver ends.
    """
    application = spark.sparkContext.applicationId
    if application not in _shipped:
        package = Path(precinct.__file__).parent
        folder = tempfile.mkdtemp(prefix="precinct-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        skip = shutil.ignore_patterns("__pycache__")
        shutil.copytree(package, f"{folder}/all/{package.name}", ignore=skip)
        made = shutil.make_archive(f"{folder}/{package.name}-workers", "zip", f"{folder}/all")
        spark.sparkContext.addPyFile(made)
        _shipped.add(application)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and continue from the Parquet copy.

    Cuts lineage and survives lost executors, and the planner knows the copy's size.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def column(name: str) -> Column:
    """A column by its exact name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def text_of(docs: DataFrame) -> Column:
    return column("text").cast("string")


def space_words(text: Column) -> Column:
    """Runs of anything but the six ASCII white-space characters; null gives none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def with_row(packed: DataFrame, result: str) -> StructType:
    """The schema of ``row`` and the result columns; the row may have any names in it."""
    return StructType([packed.schema["row"], *StructType.fromDDL(result).fields])


def map_texts(
    docs: DataFrame,
    keep: Sequence[str],
    function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
    result: str,
    *extra: Column,
) -> DataFrame:
    """Run ``function`` over Arrow batches of (``row``, ``text``, extra columns).

    ``row`` packs the columns to keep into one struct, so that they come through Python
    untouched and cannot clash with the result columns, whatever their names.
    """
    ship_package(docs.sparkSession)
    packed = docs.select(
        F.struct(*[column(name) for name in keep]).alias("row"), text_of(docs).alias("text"), *extra
    )
    return packed.mapInArrow(function, with_row(packed, result))
