"""The crime job from raw gzip files to results."""

from __future__ import annotations

import random
from collections import Counter

import pytest

from helpers import bag
from precinct import schemas
from precinct.jobs.crime_claims import main, report
from precinct.sources.files import read_area_lookup, read_incidents
from test_sources import gzip_text, lookup_line

CATEGORIES = [*schemas.VIOLENT, *schemas.DRUGS, "Burglary"]


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    rng = random.Random(7)
    folder = tmp_path_factory.mktemp("raw")
    incidents = []
    for i in range(600):
        area = rng.randrange(12)
        values = {
            "Crime ID": "" if i % 10 == 0 else str(i),
            "Month": f"2018-{1 + i % 6:02d}",
            "LSOA code": f"E{area}",
            "LSOA name": f"Area {area}",
            "Crime type": rng.choice(CATEGORIES),
        }
        incidents.append([values.get(name, "") for name in schemas.RAW_INCIDENT_COLUMNS])
    lookup = [
        (rng.choice(["Birmingham", "Leeds", "York"]), f"Area {rng.randrange(12)}", str(rng.randrange(60)))
        for _ in range(40)
    ]
    incident_lines = [",".join(schemas.RAW_INCIDENT_COLUMNS), *map(",".join, incidents)]
    return {
        "incidents": gzip_text(folder / "incidents.txt.gz", incident_lines),
        "lookup": gzip_text(folder / "lookup.gz", [lookup_line(*row) for row in lookup]),
        "incident_rows": [dict(zip(schemas.RAW_INCIDENT_COLUMNS, row)) for row in incidents],
        "lookup_rows": lookup,
    }


def test_report_matches_a_count_by_hand(spark, files):
    incidents = read_incidents(spark, files["incidents"])
    lookup = read_area_lookup(spark, files["lookup"])
    results = report(incidents, lookup, district="Birmingham")
    rows = [row for row in files["incident_rows"] if row["Crime ID"]]

    assert results["incidents"].first().n_incidents == len(rows)
    assert results["lookup rows"].first().n_rows == 40
    assert {row.category for row in results["categories"].collect()} == set(CATEGORIES)
    assert results["months"].first().n_distinct == 6

    by_month = Counter(row["Month"] for row in rows if row["Crime type"] in schemas.VIOLENT)
    months = sorted(by_month)
    assert bag(results["violent crime by month"], "period", "count", "prev_count") == [
        (month, by_month[month], by_month[before]) for before, month in zip(months, months[1:])
    ]

    joined = [
        (district, row["LSOA code"], int(population), row["Crime type"])
        for row in rows
        for district, area, population in files["lookup_rows"]
        if area == row["LSOA name"]
    ]
    firearms = [row for row in joined if row[3] in schemas.FIREARMS]
    totals = {
        name: (sum(r[2] for r in firearms if r[0] == name), sum(r[0] == name for r in firearms))
        for name in {r[0] for r in firearms}
    }
    top = results["joined rate, top 10"].collect()
    assert {r.district: (r.tot_population, r.tot_cases) for r in top} == totals
    assert [r.cases_per_head for r in top] == sorted((r.cases_per_head for r in top), reverse=True)
    assert [r.district for r in results["joined rate, named district"].collect()] == ["Birmingham"]

    codes = {r[1] for r in firearms} & {r[1] for r in joined if r[3] in schemas.DRUGS}
    assert results["firearms and drugs by area"].first().n_groups == len(codes)
    assert results["firearms and drugs by district"].first().n_groups == 3


def test_job_prints_and_writes_every_result(spark, files, tmp_path, capsys):
    main(
        [
            "--incidents",
            files["incidents"],
            "--lookup",
            files["lookup"],
            "--staging",
            str(tmp_path / "staging"),
            "--output",
            str(tmp_path / "output"),
        ]
    )
    printed = capsys.readouterr().out
    assert "average monthly change" in printed
    assert "firearms and drugs by district" in printed
    assert "Birmingham" in printed
    written = {path.name for path in (tmp_path / "output").iterdir()}
    assert len(written) == 20
    rows = spark.read.parquet(str(tmp_path / "output" / "rows_of_the_files"))
    assert tuple(rows.first()) == (600, 60, 40, 0)
    assert spark.read.parquet(str(tmp_path / "output" / "rejected_lookup_lines")).count() == 0
    ranked = spark.read.parquet(str(tmp_path / "output" / "firearms_and_drugs_by_area_ranked"))
    assert ranked.first().n_groups > 5
    compared = spark.read.parquet(str(tmp_path / "output" / "joined_rate_named_district_and_top"))
    assert compared.first().district == "Birmingham"


def test_no_result_is_cut(spark, tmp_path):
    months = [f"{2000 + i // 12}-{1 + i % 12:02d}" for i in range(180)]
    header = ",".join(schemas.RAW_INCIDENT_COLUMNS)
    lines = [header]
    for i, month in enumerate(months):
        values = {
            "Crime ID": str(i),
            "Month": month,
            "LSOA code": "E1",
            "LSOA name": "Area 1",
            "Crime type": schemas.VIOLENT[0],
        }
        lines.append(",".join(values.get(name, "") for name in schemas.RAW_INCIDENT_COLUMNS))
    incidents = gzip_text(tmp_path / "incidents.txt.gz", lines)
    lookup = gzip_text(tmp_path / "lookup.gz", [lookup_line("Leeds", "Area 1", "9")])
    output = tmp_path / "output"
    main(
        ["--incidents", incidents, "--lookup", lookup, "--staging", str(tmp_path / "s")]
        + ["--output", str(output)]
    )
    assert spark.read.parquet(str(output / "violent_crime_by_month")).count() == 179
