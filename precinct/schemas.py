"""Canonical tables, raw file layouts and the crime category sets."""

from __future__ import annotations

INCIDENTS = (
    "incident_id string, period string, area_code string, area_name string, category string"
)
INCIDENT_COUNTS = (
    "period string, area_code string, area_name string, category string, n_incidents bigint"
)
AREA_LOOKUP = "district string, area_name string, population int"

# Columns of the raw incident files, in file order. All are read as
# strings: inference would turn the month into a timestamp and IDs into numbers. The
# reader goes by the names in a file's header, not by this order.
RAW_INCIDENT_COLUMNS = (
    "Crime ID",
    "Month",
    "Reported by",
    "Falls within",
    "Longitude",
    "Latitude",
    "Location",
    "LSOA code",
    "LSOA name",
    "Crime type",
    "Last outcome category",
)

# Raw incident column -> canonical column.
INCIDENT_RENAMES = {
    "Crime ID": "incident_id",
    "Month": "period",
    "LSOA code": "area_code",
    "LSOA name": "area_name",
    "Crime type": "category",
}

# Columns of the raw lookup file, in file order. It has no header.
RAW_AREA_LOOKUP_COLUMNS = (
    "postcode",
    "inUse",
    "latitude",
    "longitude",
    "easting",
    "northing",
    "gridRef",
    "county",
    "district",
    "ward",
    "districtCode",
    "wardCode",
    "country",
    "countyCode",
    "constituency",
    "introduced",
    "terminated",
    "parish",
    "nationalPark",
    "population",
    "households",
    "builtUpArea",
    "builtupsubdivision",
    "lsoa_name",
    "rural/urban",
    "region",
    "altitude",
)
RAW_AREA_LOOKUP = ", ".join(
    f"`{name}` {'int' if name == 'population' else 'string'}" for name in RAW_AREA_LOOKUP_COLUMNS
)

# Category sets of the crime data. "Firearms" is a proxy, since both
# of its categories cover weapons or disorder in general.
VIOLENT = (
    "Public disorder and weapons",
    "Criminal damage and arson",
    "Violent crime",
    "Possession of weapons",
    "Violence and sexual offences",
)
FIREARMS = ("Public disorder and weapons", "Possession of weapons")
DRUGS = ("Drugs",)
