"""Every registered query next to the SQL that must give the same rows.

The SQL states the plain form: it joins incidents with the lookup row by row and then
aggregates, where the library counts before joining.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from precinct import schemas
from precinct.functions.measures import percentage_change, ratio
from precinct.operators.contingency import assemble_vector, contingency_statistic
from precinct.operators.fanout import in_categories, joined_counts, roll_up
from precinct.operators.points import translate_points
from precinct.operators.ranking import top_k
from precinct.operators.series import previous_value
from precinct.plans.association import association, chi_square, paired_counts
from precinct.plans.profile import count_distinct_values, count_rows, distinct_values
from precinct.plans.rank_association import permutation_test, rank_sums
from precinct.plans.rates import (
    compare_with_top,
    joined_rate,
    joined_totals,
    per_head_rate,
)
from precinct.plans.trend import average_change, period_change, period_counts, trend
from precinct.sources.files import (
    canonical_incidents,
    read_area_lookup,
    read_incidents,
    rejected_area_lookup,
)
from precinct.sources.shared import scratch_path
from precinct.sources.staging import (
    read_staged_area_lookup,
    read_staged_incident_counts,
    read_staged_incidents,
    stage_area_lookup,
    stage_incident_counts,
    stage_incidents,
    stage_months,
)
from workload.views import (
    AREA_LOOKUP_SQL,
    NAMED_DISTRICT,
    SET1,
    SET1_SQL,
    SET2,
    SET2_SQL,
    SHARED_LOOKUP_SQL,
    area_lookup,
    daily_events,
    dated,
    identified,
    incidents,
    shared_lookup,
    table,
    with_dated,
    with_views,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str, name: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its own or the given name, with its oracle."""

    def register(function: Query) -> Query:
        key = name or function.__name__
        QUERIES[key] = function
        ORACLES[key] = " ".join(sql.split())
        return function

    return register


def half_up(value: str, digits: int) -> str:
    """Decimal rounding, half away from zero, which is how Spark rounds doubles."""
    return f"CAST(round(CAST(CAST({value} AS VARCHAR) AS DECIMAL(38, 18)), {digits}) AS DOUBLE)"


# ---------------------------------------------------------------- sources


def raw_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The incidents view in the column layout of the raw files."""
    canonical_to_raw = {new: old for old, new in schemas.INCIDENT_RENAMES.items()}
    renamed = incidents(spark, sf_dir).withColumnsRenamed(canonical_to_raw)
    return renamed.select(
        *(
            F.col(f"`{name}`") if name in renamed.columns else F.lit(None).cast("string").alias(name)
            for name in schemas.RAW_INCIDENT_COLUMNS
        )
    )


def raw_area_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lookup view in the column layout of the raw file."""
    view = area_lookup(spark, sf_dir).withColumnRenamed("area_name", "lsoa_name")
    return view.select(
        *(
            F.col(f"`{name}`") if name in view.columns else F.lit(None).cast("string").alias(name)
            for name in schemas.RAW_AREA_LOOKUP_COLUMNS
        )
    )


def write_gzip_csv(df: DataFrame, name: str, *, header: bool) -> str:
    path = scratch_path(df.sparkSession, name)
    df.write.option("header", header).option("compression", "gzip").csv(path)
    return path


CANONICAL_SQL = with_views("""
SELECT CAST(incident_id AS VARCHAR) AS incident_id, period,
       CAST(area_code AS VARCHAR) AS area_code, CAST(area_name AS VARCHAR) AS area_name, category
FROM identified""")


@query(CANONICAL_SQL)
def scan_csv_header_infer(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = write_gzip_csv(raw_incidents(spark, sf_dir), "incidents", header=True)
    return read_incidents(spark, path, infer=True)


@query(CANONICAL_SQL)
def scan_csv_header_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = write_gzip_csv(raw_incidents(spark, sf_dir), "incidents", header=True)
    return read_incidents(spark, path)


@query(CANONICAL_SQL)
def scan_csv_reordered_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns in another order, and one more, are found by their names."""
    raw = raw_incidents(spark, sf_dir).withColumn("Notes", F.lit("x"))
    path = write_gzip_csv(raw.select(*sorted(raw.columns, reverse=True)), "incidents", header=True)
    return read_incidents(spark, path)


@query(CANONICAL_SQL)
def scan_csv_mixed_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of one call whose columns stand in two orders, one of them with a column more."""
    raw = raw_incidents(spark, sf_dir)
    early = F.col("Month") < "1995-01"
    first = write_gzip_csv(raw.where(early).coalesce(2), "incidents", header=True)
    noted = raw.where(~early).withColumn("Notes", F.lit("x"))
    other = noted.select(*sorted(noted.columns, reverse=True)).coalesce(2)
    return read_incidents(spark, [first, write_gzip_csv(other, "incidents", header=True)], mixed_headers=True)


@query(with_views("""
SELECT ',,,,,,,,' || district || ',,,,,,,,,,,n/a,,,,' || CAST(area_name AS VARCHAR) || ',,,' AS line,
       'population is no integer' AS reason, TRUE AS in_file
FROM area_lookup WHERE population % 3 = 0"""))
def scan_csv_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines whose population cannot be read, beside good ones and ones without a population."""
    raw = raw_area_lookup(spark, sf_dir)
    spoilt = F.when(F.col("population") % 3 == 0, "n/a").otherwise(F.col("population").cast("string"))
    path = write_gzip_csv(raw.withColumn("population", spoilt), "lookup", header=False)
    rejects = rejected_area_lookup(spark, path)
    return rejects.select("line", "reason", F.col("file").contains("lookup-").alias("in_file"))


@query(with_views("""
SELECT (SELECT count(*) FROM incidents) AS incident_rows,
       (SELECT count(*) FROM incidents WHERE incident_id IS NULL) AS without_id,
       (SELECT count(*) FROM area_lookup) AS lookup_rows,
       (SELECT count(*) FROM area_lookup WHERE population IS NULL) AS without_population"""))
def count_rows_observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows read and dropped, counted while the files are staged, without a scan of their own."""
    incident_files = write_gzip_csv(raw_incidents(spark, sf_dir), "incidents", header=True)
    lookup_files = write_gzip_csv(raw_area_lookup(spark, sf_dir), "lookup", header=False)
    incident_counts, lookup_counts = Observation(), Observation()
    stage_incident_counts(
        read_incidents(spark, incident_files, counts=incident_counts), scratch_path(spark, "staged-counts")
    )
    stage_area_lookup(read_area_lookup(spark, lookup_files, counts=lookup_counts), scratch_path(spark, "staged-lookup"))
    seen, found = incident_counts.get, lookup_counts.get
    return spark.createDataFrame(
        [(seen["rows_read"], seen["without_id"], found["rows_read"], found["without_population"])],
        "incident_rows bigint, without_id bigint, lookup_rows bigint, without_population bigint",
    )


@query(with_views("""
SELECT district, CAST(area_name AS VARCHAR) AS area_name, population
FROM area_lookup WHERE population IS NOT NULL"""))
def scan_csv_explicit_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = write_gzip_csv(raw_area_lookup(spark, sf_dir), "lookup", header=False)
    return read_area_lookup(spark, path)


@query(CANONICAL_SQL)
def stage_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "staged-incidents")
    stage_incidents(canonical_incidents(raw_incidents(spark, sf_dir)), path)
    return read_staged_incidents(spark, path)


@query(with_views("""
SELECT CAST(area_code AS VARCHAR) AS area_code, CAST(area_name AS VARCHAR) AS area_name, category,
       count(*) AS n_incidents, period
FROM identified GROUP BY ALL"""))
def stage_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "staged-counts")
    stage_incident_counts(canonical_incidents(raw_incidents(spark, sf_dir)), path)
    return read_staged_incident_counts(spark, path)


@query(with_views("""
SELECT CAST(area_code AS VARCHAR) AS area_code, CAST(area_name AS VARCHAR) AS area_name, category,
       count(*) AS n_incidents, period
FROM identified WHERE period <> '1995-03' OR category <> '5-LOW' GROUP BY ALL"""), name="stage_months")
def stage_months_again(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All months, and then a corrected version of one, which takes the place of the first."""
    path = scratch_path(spark, "staged-months")
    canonical = canonical_incidents(raw_incidents(spark, sf_dir))
    stage_months(canonical, path)
    month = canonical.where("period = '1995-03'")
    for _ in range(2):
        stage_months(month.where("category <> '5-LOW'"), path)
    return read_staged_incident_counts(spark, path)


@query(with_views(f"""
SELECT district, CAST(sum(population) AS BIGINT) AS tot_population, count(*) AS tot_cases,
       {half_up("count(*) / nullif(sum(population), 0)", 3)} AS cases_per_head
FROM joined WHERE category IN {SET1_SQL} GROUP BY district"""))
def rate_joined_from_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rate analysis from gzip CSV over staged Parquet to the result."""
    incident_files = write_gzip_csv(raw_incidents(spark, sf_dir), "incidents", header=True)
    lookup_files = write_gzip_csv(raw_area_lookup(spark, sf_dir), "lookup", header=False)
    staged_counts = scratch_path(spark, "staged-counts")
    staged_lookup = scratch_path(spark, "staged-lookup")
    stage_incident_counts(read_incidents(spark, incident_files), staged_counts)
    stage_area_lookup(read_area_lookup(spark, lookup_files), staged_lookup)
    return joined_rate(
        read_staged_incident_counts(spark, staged_counts),
        read_staged_area_lookup(spark, staged_lookup),
        categories=SET1,
    )


# ---------------------------------------------------------------- projections and filters


@query(with_views("""
SELECT CAST(incident_id AS VARCHAR) AS incident_id, period,
       CAST(area_code AS VARCHAR) AS area_code, CAST(area_name AS VARCHAR) AS area_name, category
FROM incidents"""))
def rename_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical_incidents(raw_incidents(spark, sf_dir), require_id=False)


@query(with_views("SELECT * FROM identified"))
def filter_not_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incidents(spark, sf_dir).where(F.col("incident_id").isNotNull())


@query(with_views("SELECT * FROM area_lookup WHERE population IS NOT NULL"))
def filter_sql_not_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return area_lookup(spark, sf_dir).filter("population is not null")


@query(with_views(f"SELECT * FROM identified WHERE category IN {SET1_SQL}"))
def filter_isin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identified(spark, sf_dir).where(in_categories(SET1))


@query(with_views(f"""
SELECT district, period, population, count(*) AS n_rows
FROM joined WHERE category IN {SET1_SQL} GROUP BY district, period, population"""))
def filter_before_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Category filter first, then the projection that no longer has the category."""
    kept = identified(spark, sf_dir).where(in_categories(SET1))
    return joined_counts(kept, area_lookup(spark, sf_dir))


# ---------------------------------------------------------------- joins


@query(with_views("""
SELECT district, period, population, category, count(*) AS n_rows
FROM joined GROUP BY district, period, population, category"""))
def join_inner_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The joined table as a bag, equal rows counted instead of repeated."""
    return joined_counts(
        identified(spark, sf_dir),
        area_lookup(spark, sf_dir),
        incident_columns=("period", "category"),
    )


def pairs_sql(key: str) -> str:
    """Both counts on the joined table, then the inner join of the two."""
    return f"""
    , first_set AS (SELECT {key} AS key, count(*) AS left_count FROM joined
                    WHERE category IN {SET1_SQL} GROUP BY {key}),
      second_set AS (SELECT {key} AS key, count(*) AS right_count FROM joined
                     WHERE category IN {SET2_SQL} GROUP BY {key}),
      pairs AS (SELECT key, left_count, right_count FROM first_set JOIN second_set USING (key))"""


def pairs_by(spark: SparkSession, sf_dir: str, key: str, *, fanout: bool = True) -> DataFrame:
    return paired_counts(
        identified(spark, sf_dir),
        area_lookup(spark, sf_dir),
        left=SET1,
        right=SET2,
        key=key,
        fanout=fanout,
    )


@query(with_views(pairs_sql("area_code") + " SELECT key, left_count, right_count FROM pairs"))
def join_group_counts_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs_by(spark, sf_dir, "area_code")


@query(with_views(pairs_sql("district") + " SELECT key, left_count, right_count FROM pairs"))
def join_group_counts_district(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs_by(spark, sf_dir, "district")


# ---------------------------------------------------------------- aggregates


@query(with_dated(f"""
SELECT period, count(*) AS "count" FROM identified
WHERE category IN {SET1_SQL} GROUP BY period"""))
def group_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return period_counts(dated(spark, sf_dir), categories=SET1)


@query(with_views(f"""
SELECT district, CAST(sum(population) AS BIGINT) AS tot_population, count(*) AS tot_cases
FROM joined WHERE category IN {SET1_SQL} GROUP BY district"""))
def group_sum_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = identified(spark, sf_dir).where(in_categories(SET1))
    return joined_totals(kept, area_lookup(spark, sf_dir))


@query(with_dated("SELECT count(*) AS n_rows FROM identified"), name="count_rows")
def count_rows_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_rows(dated(spark, sf_dir))


@query(with_views("SELECT count(*) AS n_rows FROM area_lookup WHERE population IS NOT NULL"))
def count_rows_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_rows(area_lookup(spark, sf_dir).filter("population is not null"))


@query(with_dated("SELECT DISTINCT category FROM identified"), name="distinct_values")
def distinct_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinct_values(dated(spark, sf_dir), "category")


@query(
    with_dated(
        "SELECT count(*) AS n_distinct FROM (SELECT DISTINCT period FROM identified) AS periods"
    ),
    name="count_distinct_values",
)
def count_distinct_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_distinct_values(dated(spark, sf_dir), "period")


# ---------------------------------------------------------------- windows, sorts, ratios


def changes_sql(base: str = '"count"') -> str:
    return f"""
    , counts AS (SELECT period, count(*) AS "count" FROM identified
                 WHERE category IN {SET1_SQL} GROUP BY period),
      lagged AS (SELECT *, lag("count") OVER (ORDER BY period) AS prev_count FROM counts),
      changes AS (SELECT period, "count", prev_count,
                         {half_up(f'100 * (("count" - prev_count) / {base})', 2)}
                           AS percentage_change
                  FROM lagged WHERE prev_count IS NOT NULL)"""


@query(with_dated(changes_sql() + ' SELECT period, "count", prev_count FROM lagged'))
def window_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = period_counts(dated(spark, sf_dir), categories=SET1)
    return previous_value(counts, period="period", value="count", output="prev_count")


@query(with_dated(changes_sql() + " SELECT * FROM changes"))
def pct_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    return period_change(period_counts(dated(spark, sf_dir), categories=SET1))


@query(with_dated(changes_sql() + " SELECT round(avg(percentage_change), 6) AS average FROM changes"))
def global_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = period_change(period_counts(dated(spark, sf_dir), categories=SET1))
    return changes.agg(F.round(F.avg("percentage_change"), 6).alias("average"))


@query(with_dated(changes_sql() + ' SELECT period, "count" FROM counts ORDER BY period'))
def sort_asc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return period_counts(dated(spark, sf_dir), categories=SET1).orderBy("period")


@query(with_views(f"""
SELECT district, {half_up("count(*) / nullif(sum(population), 0)", 3)} AS ratio
FROM joined WHERE category IN {SET1_SQL} GROUP BY district"""))
def rate_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = identified(spark, sf_dir).where(in_categories(SET1))
    totals = joined_totals(kept, area_lookup(spark, sf_dir))
    return totals.select(
        "district", ratio(F.col("tot_cases"), F.col("tot_population"), 3).alias("ratio")
    )


RATES_SQL = f"""
, rates AS (
  SELECT district, CAST(sum(population) AS BIGINT) AS tot_population, count(*) AS tot_cases,
         {half_up("count(*) / nullif(sum(population), 0)", 3)} AS cases_per_head
  FROM joined WHERE category IN {SET1_SQL} GROUP BY district)"""


@query(with_views(
    RATES_SQL + " SELECT * FROM rates ORDER BY cases_per_head DESC NULLS LAST, district LIMIT 10",
    district="n_name",
))
def topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nations with the highest rate, of all of them."""
    rates = joined_rate(
        identified(spark, sf_dir), area_lookup(spark, sf_dir, district="n_name"), categories=SET1
    )
    return top_k(rates, by="cases_per_head", tie_break="district", k=10)


@query(with_views(RATES_SQL + f" SELECT * FROM rates WHERE district = '{NAMED_DISTRICT}'"))
def filter_equals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = joined_rate(identified(spark, sf_dir), area_lookup(spark, sf_dir), categories=SET1)
    return rates.where(f"district == '{NAMED_DISTRICT}'")


# ---------------------------------------------------------------- statistics


@query(with_views(pairs_sql("area_code") + """
SELECT key, left_count, 1 AS vector_size, CAST(right_count AS DOUBLE) AS vector_value
FROM pairs"""))
def vector_assemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    assembled = assemble_vector(pairs_by(spark, sf_dir, "area_code"), ["right_count"])
    values = assembled.withColumn("values", vector_to_array("vector"))
    return values.select(
        "key",
        "left_count",
        F.size("values").alias("vector_size"),
        F.col("values")[0].alias("vector_value"),
    )


def contingency_sql(pairs: str) -> str:
    """The textbook sum of (observed - expected)^2 / expected over all cells, empty ones too."""
    return pairs + """
    , lefts AS (SELECT left_count, count(*) AS r FROM pairs GROUP BY left_count),
      rights AS (SELECT right_count, count(*) AS c FROM pairs GROUP BY right_count),
      cells AS (SELECT left_count, right_count, count(*) AS o FROM pairs
                GROUP BY left_count, right_count),
      total AS (SELECT count(*) AS n FROM pairs),
      summary AS (
        SELECT sum((coalesce(o, 0) - r * c / n) * (coalesce(o, 0) - r * c / n) / (r * c / n))
                 AS statistic,
               (count(DISTINCT left_count) - 1) * (count(DISTINCT right_count) - 1)
                 AS degrees_of_freedom,
               any_value(n) AS n_groups, count(DISTINCT left_count) AS n_left,
               count(DISTINCT right_count) AS n_right
        FROM lefts CROSS JOIN rights CROSS JOIN total
             LEFT JOIN cells USING (left_count, right_count))"""


def chi_square_sql(pairs: str) -> str:
    """Adds the p-value from the power series of the chi-square distribution.

    Its largest term is number (statistic - df) / 2 or so, and terms fall off from there as a
    normal density does, with half the statistic as variance. Forty deviations either side of
    the peak hold everything, whatever its place.
    """
    return contingency_sql(pairs) + """
    , peak AS (
        SELECT *, degrees_of_freedom / 2 AS a, statistic / 2 AS x,
               CAST(greatest(0, floor(statistic / 2 - degrees_of_freedom / 2)) AS BIGINT) AS top,
               CAST(40 * sqrt(greatest(statistic, degrees_of_freedom, 1)) + 100 AS BIGINT) AS width
        FROM summary WHERE degrees_of_freedom > 0 AND statistic > 0),
      terms AS (
        SELECT a, x, unnest(generate_series(greatest(0, top - width), top + width)) AS i FROM peak),
      series AS (
        SELECT sum(exp((a + i) * ln(x) - x - lgamma(a + i + 1))) AS below FROM terms),
      tested AS (
        SELECT round(statistic, 6) AS statistic, degrees_of_freedom,
               CASE WHEN degrees_of_freedom = 0 OR statistic = 0 THEN 1.0
                    ELSE round(greatest(1 - below, 0), 6) END AS p_value,
               n_groups, n_left, n_right,
               n_left = n_groups OR n_right = n_groups OR degrees_of_freedom = 0 AS degenerate
        FROM summary CROSS JOIN series)"""


def rounded(result: DataFrame) -> DataFrame:
    """Six decimals, which is more than summation order can change."""
    return result.withColumns(
        {
            name: F.round(name, 6)
            for name in ("statistic", "p_value")
            if name in result.columns
        }
    )


@query(
    with_views(contingency_sql(pairs_sql("area_code")) + """
    SELECT round(statistic, 6) AS statistic, degrees_of_freedom, n_groups,
           n_right AS n_features, n_left AS n_labels, (SELECT count(*) FROM cells) AS n_cells
    FROM summary"""),
    name="contingency_statistic",
)
def contingency_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = pairs_by(spark, sf_dir, "area_code")
    return rounded(contingency_statistic(pairs, feature="right_count", label="left_count"))


TEST_SQL = " SELECT statistic, degrees_of_freedom, p_value FROM tested"


@query(with_views(chi_square_sql(pairs_sql("area_code")) + TEST_SQL))
def chi_square_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = chi_square(pairs_by(spark, sf_dir, "area_code"))
    return rounded(result.select("statistic", "degrees_of_freedom", "p_value"))


@query(with_views(chi_square_sql(pairs_sql("district")) + TEST_SQL))
def chi_square_district(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = chi_square(pairs_by(spark, sf_dir, "district"))
    return rounded(result.select("statistic", "degrees_of_freedom", "p_value"))


MANY_VALUES_SQL = """
WITH pairs AS (SELECT l_orderkey AS right_count, CAST(l_quantity AS INTEGER) AS left_count
               FROM lineitem)"""


@query(chi_square_sql(MANY_VALUES_SQL) + """
SELECT round(statistic, 3) AS statistic, degrees_of_freedom, round(p_value, 4) AS p_value,
       n_groups, n_left, n_right, degenerate FROM tested""")
def chi_square_many_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table with a value for every order on one side."""
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("right_count"), F.col("l_quantity").cast("int").alias("left_count")
    )
    result = chi_square(lines).drop("associated")
    return result.withColumns({"statistic": F.round("statistic", 3), "p_value": F.round("p_value", 4)})


# ---------------------------------------------------------------- whole analyses


@query(with_dated(changes_sql() + " SELECT * FROM changes ORDER BY period"))
def trend_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trend(dated(spark, sf_dir), categories=SET1)


@query(with_dated(changes_sql() + """
SELECT round(avg(percentage_change), 6) AS avg_percentage_change,
       avg(percentage_change) > 0 AS increasing FROM changes"""))
def trend_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = period_change(period_counts(dated(spark, sf_dir), categories=SET1))
    average = average_change(changes)
    return average.withColumn("avg_percentage_change", F.round("avg_percentage_change", 6))


@query(with_views(changes_sql() + " SELECT * FROM changes"))
def trend_from_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trend(roll_up(identified(spark, sf_dir)), categories=SET1)


@query(with_dated(changes_sql(base="prev_count") + " SELECT * FROM changes"))
def trend_previous_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trend(dated(spark, sf_dir), categories=SET1, base="previous")


@query(with_views(f"""
, found AS (SELECT area_name, period, count(*) AS n FROM identified
            WHERE category IN {SET1_SQL} GROUP BY area_name, period),
  ends AS (SELECT area_name, min(strptime(period, '%Y-%m')) AS first_month,
                  max(strptime(period, '%Y-%m')) AS last_month FROM found GROUP BY area_name),
  calendar AS (SELECT area_name, strftime(unnest(generate_series(
                 first_month, last_month, INTERVAL 1 MONTH)), '%Y-%m') AS period FROM ends),
  counts AS (SELECT area_name, period, coalesce(n, 0) AS "count"
             FROM calendar LEFT JOIN found USING (area_name, period)),
  lagged AS (SELECT *, lag("count") OVER (PARTITION BY area_name ORDER BY period) AS prev_count
             FROM counts)
SELECT area_name, period, "count", prev_count,
       {half_up('100 * (("count" - prev_count) / nullif("count", 0))', 2)} AS percentage_change
FROM lagged WHERE prev_count IS NOT NULL"""))
def trend_gap_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One series per area, with the months it lacks put in as 0."""
    return trend(identified(spark, sf_dir), categories=SET1, by=("area_name",), fill_gaps=True)


@query(f"""
WITH counts AS (SELECT event_type AS category, strftime(ts, '%Y-%m-%d') AS period,
                       count(*) AS "count" FROM events GROUP BY ALL),
     lagged AS (SELECT *, lag("count") OVER (PARTITION BY category ORDER BY period) AS prev_count
                FROM counts)
SELECT category, period, "count", prev_count,
       {half_up('100 * (("count" - prev_count) / "count")', 2)} AS percentage_change
FROM lagged WHERE prev_count IS NOT NULL""")
def trend_daily_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trend(daily_events(spark, sf_dir), by=("category",))


@query(with_views(RATES_SQL + " SELECT * FROM rates"))
def rate_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined_rate(identified(spark, sf_dir), area_lookup(spark, sf_dir), categories=SET1)


@query(with_views(RATES_SQL + " SELECT * FROM rates"))
def rate_joined_from_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = roll_up(identified(spark, sf_dir))
    return joined_rate(counts, area_lookup(spark, sf_dir), categories=SET1)


@query(with_views(RATES_SQL + " SELECT * FROM rates", lookup=SHARED_LOOKUP_SQL))
def rate_joined_shared_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined_rate(identified(spark, sf_dir), shared_lookup(spark, sf_dir), categories=SET1)


@query(with_views(RATES_SQL + f"""
, named AS (SELECT cases_per_head AS rate FROM rates WHERE district = '{NAMED_DISTRICT}'),
  top AS (SELECT district AS top_district, cases_per_head AS top_rate FROM rates
          WHERE cases_per_head IS NOT NULL ORDER BY cases_per_head DESC, district LIMIT 1)
SELECT '{NAMED_DISTRICT}' AS district, rate, top_district, top_rate, top_rate / nullif(rate, 0) AS factor,
       1 + (SELECT count(*) FROM rates WHERE cases_per_head > (SELECT rate FROM named)) AS rank
FROM named CROSS JOIN top"""))
def rate_compared_with_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = joined_rate(identified(spark, sf_dir), area_lookup(spark, sf_dir), categories=SET1)
    return compare_with_top(rates, NAMED_DISTRICT)


MAIN_DISTRICT_SQL = """
main AS (SELECT area_name, district FROM (
  SELECT area_name, district,
         row_number() OVER (PARTITION BY area_name ORDER BY count(*) DESC, district) AS place
  FROM area_lookup WHERE population IS NOT NULL GROUP BY area_name, district) AS placed
  WHERE place = 1)"""

PER_HEAD_SQL = f"""
, {MAIN_DISTRICT_SQL},
  cases AS (SELECT district, count(*) AS n FROM identified JOIN main USING (area_name)
            WHERE category IN {SET1_SQL} GROUP BY district),
  residents AS (SELECT district, CAST(sum(population) AS BIGINT) AS tot_population
                FROM area_lookup WHERE population IS NOT NULL GROUP BY district)
SELECT district, tot_population, coalesce(n, 0) AS tot_cases,
       {half_up("coalesce(n, 0) / nullif(tot_population, 0)", 3)} AS cases_per_head
FROM residents LEFT JOIN cases USING (district)"""


@query(with_views(PER_HEAD_SQL))
def rate_per_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    return per_head_rate(identified(spark, sf_dir), area_lookup(spark, sf_dir), categories=SET1)


@query(with_views(PER_HEAD_SQL, lookup=SHARED_LOOKUP_SQL))
def rate_per_head_shared_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return per_head_rate(identified(spark, sf_dir), shared_lookup(spark, sf_dir), categories=SET1)


ASSOCIATION_SQL = " SELECT *, p_value < 0.05 AS associated FROM tested"


def association_by(spark: SparkSession, sf_dir: str, key: str, *, fanout: bool = True) -> DataFrame:
    return rounded(
        association(
            identified(spark, sf_dir),
            area_lookup(spark, sf_dir),
            left=SET1,
            right=SET2,
            key=key,
            fanout=fanout,
        )
    )


@query(with_views(chi_square_sql(pairs_sql("area_code")) + ASSOCIATION_SQL))
def association_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return association_by(spark, sf_dir, "area_code")


@query(with_views(chi_square_sql(pairs_sql("district")) + ASSOCIATION_SQL))
def association_district(spark: SparkSession, sf_dir: str) -> DataFrame:
    return association_by(spark, sf_dir, "district")


def once_pairs_sql(key: str) -> str:
    return f"""
    , {MAIN_DISTRICT_SQL},
      placed_once AS (SELECT * FROM identified JOIN main USING (area_name)),
      pairs AS (SELECT * FROM (
        SELECT {key} AS key, count(*) FILTER (WHERE category IN {SET1_SQL}) AS left_count,
               count(*) FILTER (WHERE category IN {SET2_SQL}) AS right_count
        FROM placed_once GROUP BY {key}) AS counted
        WHERE left_count > 0 AND right_count > 0)"""


@query(with_views(chi_square_sql(once_pairs_sql("area_code")) + ASSOCIATION_SQL))
def association_area_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    return association_by(spark, sf_dir, "area_code", fanout=False)


@query(with_views(chi_square_sql(once_pairs_sql("district")) + ASSOCIATION_SQL))
def association_district_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    return association_by(spark, sf_dir, "district", fanout=False)


# ---------------------------------------------------------------- coordinates


@query("""
WITH located AS (
  SELECT o_orderkey AS incident_id,
         CASE WHEN o_orderstatus <> 'P' THEN CAST(o_custkey AS VARCHAR) END AS longitude,
         CASE WHEN o_orderstatus <> 'P' THEN CAST(c_nationkey AS VARCHAR) END AS latitude
  FROM orders JOIN customer ON o_custkey = c_custkey),
points AS (
  SELECT CAST(c_custkey AS VARCHAR) AS longitude, CAST(c_nationkey AS VARCHAR) AS latitude,
         c_name AS postcode FROM customer WHERE c_acctbal >= 0)
SELECT incident_id, longitude, latitude, postcode
FROM located LEFT JOIN points USING (longitude, latitude)""")
def point_postcodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as map points; pending orders have no coordinates."""
    orders = table(spark, sf_dir, "orders")
    customer = table(spark, sf_dir, "customer")
    known = F.col("o_orderstatus") != "P"
    located = orders.join(customer, orders.o_custkey == customer.c_custkey).select(
        F.col("o_orderkey").alias("incident_id"),
        F.when(known, F.col("o_custkey").cast("string")).alias("longitude"),
        F.when(known, F.col("c_nationkey").cast("string")).alias("latitude"),
    )
    points = customer.where(F.col("c_acctbal") >= 0).select(
        F.col("c_custkey").cast("string").alias("longitude"),
        F.col("c_nationkey").cast("string").alias("latitude"),
        F.col("c_name").alias("postcode"),
    )
    return translate_points(located, points)


def ranked_sql(key: str) -> str:
    return with_views(pairs_sql(key) + """
    , ranks AS (SELECT CAST(2 * rank() OVER (ORDER BY left_count) + count(*) OVER (PARTITION BY left_count) - 1 AS HUGEINT) AS x,
                       CAST(2 * rank() OVER (ORDER BY right_count) + count(*) OVER (PARTITION BY right_count) - 1 AS HUGEINT) AS y
                FROM pairs),
      sums AS (SELECT count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS xx, sum(y * y) AS yy, sum(x * y) AS xy FROM ranks),
      found AS (SELECT n, CAST(n * xy - sx * sy AS DOUBLE)
                          / sqrt(CAST(n * xx - sx * sx AS DOUBLE) * CAST(n * yy - sy * sy AS DOUBLE)) AS rho FROM sums)
    SELECT n AS n_groups, rho, CASE WHEN abs(rho) < 1 THEN rho * sqrt((n - 2) / (1 - rho * rho)) END AS t_statistic FROM found""")


@query(ranked_sql("area_code"))
def association_ranked_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_sums(pairs_by(spark, sf_dir, "area_code"))


@query(ranked_sql("district"))
def association_ranked_district(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_sums(pairs_by(spark, sf_dir, "district"))


@query(with_views(pairs_sql("area_code") + """
    , shuffles AS (SELECT unnest(generate_series(0, 199)) AS b),
      placed AS (SELECT b, left_count AS l, right_count AS r,
                        row_number() OVER (PARTITION BY b ORDER BY md5('precinct:' || b || ':' || key), key) AS place
                 FROM pairs CROSS JOIN shuffles),
      met AS (SELECT other.b, first.l, other.r FROM placed first JOIN placed other USING (place)
              WHERE first.b = 0 AND other.b > 0
              UNION ALL SELECT -1, left_count, right_count FROM pairs),
      cells AS (SELECT b, l, r, CAST(count(*) AS HUGEINT) AS o FROM met GROUP BY b, l, r),
      lefts AS (SELECT left_count AS l, count(*) AS n_l FROM pairs GROUP BY left_count),
      rights AS (SELECT right_count AS r, count(*) AS n_r FROM pairs GROUP BY right_count),
      shares AS (SELECT b, sum(o * o * 1000000000000 // (n_l * n_r)) AS share
                 FROM cells JOIN lefts USING (l) JOIN rights USING (r) GROUP BY b),
      counted AS (SELECT (SELECT count(*) FROM pairs) AS n_groups, 199 AS n_shuffles, count(*) AS n_at_least
                  FROM shares WHERE b > 0 AND share >= (SELECT share FROM shares WHERE b = -1))
    SELECT n_groups, n_shuffles, n_at_least, (n_at_least + 1) / 200 AS p_value, (n_at_least + 1) / 200 < 0.05 AS associated
    FROM counted"""))
def association_shuffled_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return permutation_test(pairs_by(spark, sf_dir, "area_code"))
