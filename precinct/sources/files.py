"""CSV readers (plain or gzip) for incidents and the area lookup."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, DataFrameReader, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (
    DateType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
    TimestampType,
)

from precinct import schemas


def read_incidents(
    spark: SparkSession,
    path: str | list[str],
    *,
    infer: bool = False,
    delimiter: str = ",",
    require_id: bool = True,
    mixed_headers: bool = False,
    counts: Observation | None = None,
) -> DataFrame:
    """Read raw incident files with a header row into the canonical table.

    ``infer=True`` lets Spark derive the column types, at the price of a second pass
    over the files and of IDs such as ``007`` losing their zeros. The result is
    canonical (all strings, months as ``yyyy-MM``) either way. ``require_id`` drops
    incidents without an ID.

    Columns are found by the names in the header, whatever their order, and others are left
    out; a column that is missing is an error. The files of one call share one header: Spark
    compares every file's header with the first one's and fails on a difference. With
    ``mixed_headers`` the first line of every file is read beforehand, files with equal headers
    are one scan, and the scans are united by the columns' names.

    ``counts`` is filled by the first action on the result, as a by-product of its scan, with
    ``rows_read`` and ``without_id``.

    A gzip file is read by one task however large it is; see ``stage_incidents``.
    """

    def reader() -> DataFrameReader:
        return spark.read.option("header", True).option("delimiter", delimiter).option("enforceSchema", False)

    def scan(files: str | list[str]) -> DataFrame:
        if infer:
            raw = reader().option("inferSchema", True).csv(files)
        else:
            # Reading without a schema looks at the first line only, and types all as strings.
            names = reader().csv(files).columns
            raw = reader().schema(StructType([StructField(name, StringType()) for name in names])).csv(files)
        missing = [name for name in schemas.INCIDENT_RENAMES if name not in raw.columns]
        if missing:
            raise ValueError(f"the incident files lack the columns {missing}")
        return canonical_incidents(raw, require_id=False)

    if mixed_headers:
        groups = files_by_header(spark, path, delimiter=delimiter).values()
        incidents = reduce(DataFrame.unionByName, [scan(files) for files in groups])
    else:
        incidents = scan(path)
    if counts is not None:
        no_id = F.count_if(F.col("incident_id").isNull())
        incidents = incidents.observe(counts, F.count(F.lit(1)).alias("rows_read"), no_id.alias("without_id"))
    return incidents.where(F.col("incident_id").isNotNull()) if require_id else incidents


def files_by_header(
    spark: SparkSession, path: str | list[str], *, delimiter: str = ","
) -> dict[tuple[str, ...], list[str]]:
    """The files below ``path`` by the names in their first line.

    Names come from the first line of each file alone, one small read a file. Files without a
    line are left out; no file with one is an error.
    """
    reader = spark.read.option("header", True).option("delimiter", delimiter)
    groups: dict[tuple[str, ...], list[str]] = {}
    for file in sorted(spark.read.text(path).inputFiles()):
        names = tuple(reader.csv(file).columns)
        if names:
            groups.setdefault(names, []).append(file)
    if not groups:
        raise ValueError("there is no file with a header")
    return groups


def canonical_incidents(raw: DataFrame, *, require_id: bool = True) -> DataFrame:
    """Rename, project and cast raw incident columns to the canonical table."""
    renamed = raw.withColumnsRenamed(schemas.INCIDENT_RENAMES)
    period_type = renamed.schema["period"].dataType
    period = F.col("period")
    if isinstance(period_type, (DateType, TimestampType, TimestampNTZType)):
        period = F.date_format(period, "yyyy-MM")
    incidents = renamed.select(
        F.col("incident_id").cast("string").alias("incident_id"),
        period.cast("string").alias("period"),
        F.col("area_code").cast("string").alias("area_code"),
        F.col("area_name").cast("string").alias("area_name"),
        F.col("category").cast("string").alias("category"),
    )
    return incidents.where(F.col("incident_id").isNotNull()) if require_id else incidents


def read_area_lookup(
    spark: SparkSession,
    path: str | list[str],
    *,
    header: bool = False,
    delimiter: str = ",",
    require_population: bool = True,
    counts: Observation | None = None,
) -> DataFrame:
    """Read raw lookup files, with a fixed schema, into the canonical table.

    A header line that is read as data has no integer population, so the population
    filter removes it along with the other rows that lack one. ``rejected_area_lookup``
    shows the lines that go because they cannot be read.

    ``counts`` is filled by the first action on the result, as a by-product of its scan, with
    ``rows_read`` and ``without_population``.
    """
    raw = (
        spark.read.option("header", header)
        .option("delimiter", delimiter)
        .schema(schemas.RAW_AREA_LOOKUP)
        .csv(path)
    )
    lookup = raw.select("district", F.col("lsoa_name").alias("area_name"), "population")
    if counts is not None:
        none = F.count_if(F.col("population").isNull())
        lookup = lookup.observe(counts, F.count(F.lit(1)).alias("rows_read"), none.alias("without_population"))
    return lookup.filter("population is not null") if require_population else lookup


def rejected_area_lookup(
    spark: SparkSession, path: str | list[str], *, header: bool = False, delimiter: str = ","
) -> DataFrame:
    """The lines that ``read_area_lookup`` drops because they cannot be read: (file, line, reason).

    ``line`` is the line as it stands in the file. A line is rejected if it has a population
    that is no integer, or too few fields to have one. A line whose population is empty is in
    order, and only counted (``counts``); so is one that lacks later fields. A header that is
    read as data is a rejected line.
    """
    layout = schemas.RAW_AREA_LOOKUP + ", _rejected string"
    raw = (
        spark.read.option("header", header)
        .option("delimiter", delimiter)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_rejected")
        .option("columnPruning", False)
        .schema(layout)
        .csv(path)
    )
    place = schemas.RAW_AREA_LOOKUP_COLUMNS.index("population")
    fields = F.split(F.col("_rejected"), delimiter if delimiter.isalnum() else f"[{delimiter}]", -1)
    reason = F.when(F.size(fields) <= place, "too few fields").otherwise("population is no integer")
    return raw.where(F.col("_rejected").isNotNull() & F.col("population").isNull()).where(
        # A short line, or one whose population field holds something.
        (F.size(fields) <= place) | (F.trim(F.get(fields, F.lit(place))) != "") | F.col("_rejected").contains('"')
    ).select(F.col("_metadata.file_path").alias("file"), F.col("_rejected").alias("line"), reason.alias("reason"))
