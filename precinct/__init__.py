"""precinct: trend, rate and association analyses of incident records on Spark.

Every function takes and returns DataFrames over two canonical tables::

    incidents(incident_id, period, area_code, area_name, category)
    area_lookup(district, area_name, population)
"""

from precinct.operators.fanout import joined_counts, roll_up
from precinct.plans.association import association, chi_square, paired_counts
from precinct.plans.profile import (
    count_distinct_values,
    count_incidents,
    count_rows,
    distinct_values,
)
from precinct.plans.rank_association import (
    permutation_test,
    ranked_association,
    shuffled_association,
    spearman,
)
from precinct.plans.rates import compare_with_top, joined_rate, per_head_rate
from precinct.plans.trend import average_change, period_change, period_counts, trend
from precinct.session import get_session
from precinct.sources.files import read_area_lookup, read_incidents, rejected_area_lookup
from precinct.sources.staging import (
    read_staged_area_lookup,
    read_staged_incident_counts,
    read_staged_incidents,
    stage_area_lookup,
    stage_incident_counts,
    stage_incidents,
    stage_months,
)

__all__ = [
    "association",
    "average_change",
    "chi_square",
    "compare_with_top",
    "count_distinct_values",
    "count_incidents",
    "count_rows",
    "distinct_values",
    "get_session",
    "joined_counts",
    "joined_rate",
    "paired_counts",
    "per_head_rate",
    "permutation_test",
    "ranked_association",
    "period_change",
    "period_counts",
    "read_area_lookup",
    "read_incidents",
    "read_staged_area_lookup",
    "read_staged_incident_counts",
    "read_staged_incidents",
    "rejected_area_lookup",
    "roll_up",
    "shuffled_association",
    "spearman",
    "stage_area_lookup",
    "stage_incident_counts",
    "stage_incidents",
    "stage_months",
    "trend",
]
