"""Check three claims about crime from the raw incident and lookup files.

    spark-submit --conf spark.checkpoint.dir=<shared folder> \\
        precinct/jobs/crime_claims.py --incidents <csv.gz> --lookup <csv.gz> \\
        --staging <folder> --output <folder> --district <name>

1. Violent crime is increasing.
2. The named district has more firearms incidents per head than any other.
3. Firearms incidents are associated with drugs offences.

The raw incidents are read once, rolled up and staged; the claims are checked on the
counts. Every result is written in full as Parquet, in a folder of its own below the output
folder. Results that have one row or ten by definition are printed as well.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from precinct import schemas
from precinct.operators.ranking import top_k
from precinct.plans.association import association
from precinct.plans.profile import (
    count_distinct_values,
    count_incidents,
    count_rows,
    distinct_values,
)
from precinct.plans.rank_association import ranked_association, shuffled_association
from precinct.plans.rates import compare_with_top, joined_rate, per_head_rate
from precinct.plans.trend import average_change, period_change, period_counts, trend
from precinct.session import get_session
from precinct.sources.files import read_area_lookup, read_incidents, rejected_area_lookup
from precinct.sources.shared import staged
from precinct.sources.staging import (
    read_staged_area_lookup,
    read_staged_incident_counts,
    stage_area_lookup,
    stage_incident_counts,
)

# Results as long as the data: written, not printed.
LONG = ("rejected lookup lines", "categories", "violent crime by month", "joined rate", "per-head rate")


def report(incidents: DataFrame, lookup: DataFrame, *, district: str) -> dict[str, DataFrame]:
    """All results by name, in the order of the claims.

    ``incidents`` may be rolled up, which spares ten passes over the raw rows. The rates, which
    several results look at, are computed once.
    """
    counts = period_counts(incidents, categories=schemas.VIOLENT)
    joined = staged(joined_rate(incidents, lookup, categories=schemas.FIREARMS), "joined-rate")
    per_head = staged(per_head_rate(incidents, lookup, categories=schemas.FIREARMS), "per-head-rate")
    sets = {"left": schemas.FIREARMS, "right": schemas.DRUGS}
    return {
        "incidents": count_incidents(incidents),
        "lookup rows": count_rows(lookup),
        "categories": distinct_values(incidents, "category"),
        "months": count_distinct_values(incidents, "period"),
        "violent crime by month": trend(incidents, categories=schemas.VIOLENT),
        "average monthly change": average_change(period_change(counts)),
        "joined rate": joined,
        "joined rate, top 10": top_k(joined, by="cases_per_head", tie_break="district"),
        "joined rate, named district": joined.where(F.col("district") == district),
        "joined rate, named district and top": compare_with_top(joined, district),
        "per-head rate": per_head,
        "per-head rate, top 10": top_k(per_head, by="cases_per_head", tie_break="district"),
        "per-head rate, named district and top": compare_with_top(per_head, district),
        "firearms and drugs by area": association(incidents, lookup, **sets, key="area_code"),
        "firearms and drugs by district": association(incidents, lookup, **sets, key="district"),
        "firearms and drugs by area, ranked": ranked_association(incidents, lookup, **sets, key="area_code"),
        "firearms and drugs by district, ranked": ranked_association(incidents, lookup, **sets, key="district"),
        "firearms and drugs by area, shuffled": shuffled_association(incidents, lookup, **sets, key="area_code"),
    }


def rows_of_the_files(spark: SparkSession, seen: dict, found: dict) -> DataFrame:
    """What the staging of the files has counted on its way, as one row."""
    return spark.createDataFrame(
        [(seen["rows_read"], seen["without_id"], found["rows_read"], found["without_population"])],
        "incident_rows bigint, without_id bigint, lookup_rows bigint, without_population bigint",
    )


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("--incidents", required=True, help="raw incident CSV with header")
    parser.add_argument("--lookup", required=True, help="raw lookup CSV without header")
    parser.add_argument("--staging", required=True, help="new folder for the Parquet copies")
    parser.add_argument("--output", required=True, help="new folder for the results")
    parser.add_argument("--district", default="Birmingham")
    options = parser.parse_args(arguments)

    spark = get_session("precinct-crime-claims")
    incident_table = f"{options.staging}/incident_counts"
    lookup_table = f"{options.staging}/area_lookup"
    seen, found = Observation("incidents"), Observation("lookup")
    incidents = read_incidents(spark, options.incidents, mixed_headers=True, counts=seen)
    stage_incident_counts(incidents, incident_table)
    stage_area_lookup(read_area_lookup(spark, options.lookup, counts=found), lookup_table)
    results = {
        "rows of the files": rows_of_the_files(spark, seen.get, found.get),
        "rejected lookup lines": rejected_area_lookup(spark, options.lookup),
    }
    results |= report(
        read_staged_incident_counts(spark, incident_table),
        read_staged_area_lookup(spark, lookup_table),
        district=options.district,
    )
    for title, result in results.items():
        path = f"{options.output}/{title.replace(',', '').replace(' ', '_')}"
        result.write.parquet(path)
        print(f"{title}: {path}")
        if title not in LONG:
            spark.read.parquet(path).show(truncate=False)


if __name__ == "__main__":
    main()
